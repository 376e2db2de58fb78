"""Bytes of an image file as blue-green-red samples: PNG, BMP and sequential JPEG.

Small decoders for tasks; entropy-coded parts run symbol by symbol, everything else on whole arrays.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from glintframe.functions.signal import cosines


class CodecError(ValueError):
    """Bytes that can't be decoded; the message says why."""


#: First bytes of the containers that are told apart.
MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "bmp": b"BM", "gif": b"GIF8"}


def container(content: bytes) -> str | None:
    """The container by its first bytes: png, jpeg, bmp, gif, webp, or None."""
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "webp"
    return next((name for name, magic in MAGIC.items() if content.startswith(magic)), None)


def decode(content: bytes) -> np.ndarray:
    """(height, width, 3) of blue, green, red; transparency is left out, sixteen bits become eight."""
    kind = container(content)
    if kind not in DECODERS:
        raise CodecError(f"no decoder for {kind}" if kind else "no image that can be decoded")
    try:
        return np.ascontiguousarray(DECODERS[kind](content))
    except CodecError:
        raise
    except Exception as why:  # a broken file may fail anywhere
        raise CodecError(f"broken {kind} file") from why


# ---- PNG ------------------------------------------------------------------------------------------------------------

#: Fixed values: (first row, row step, first column, column step) of the seven interlaced passes.
PASSES = ((0, 8, 0, 8), (0, 8, 4, 8), (4, 8, 0, 4), (0, 4, 2, 4), (2, 4, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1))
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(lines: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of bytes without their filters; ``bpp``: bytes between a byte and the one that it is predicted from."""
    h, n = lines.shape
    out = np.zeros((h + 1, n + bpp), np.uint8)  # a row of zeros above, a pixel of zeros to the left
    for y in range(h):
        own, up, row = lines[y], out[y], out[y + 1]
        kind = kinds[y]
        if kind == 0:
            row[bpp:] = own
        elif kind == 1:
            room = np.zeros(-n % bpp, np.uint8)
            row[bpp:] = np.cumsum(np.append(own, room).reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[:n]
        elif kind == 2:
            row[bpp:] = own + up[bpp:]
        elif kind in (3, 4):
            left, above, add = row.tolist(), up.tolist(), own.tolist()
            for i in range(n):
                a, b = left[i], above[i + bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[i]
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                left[i + bpp] = (add[i] + guess) & 255
            row[:] = left
        else:
            raise CodecError("unknown filter of a png row")
    return out[1:, bpp:]


def _png(content: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise CodecError("a png chunk is broken")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    raw, used = zlib.decompress(b"".join(data)), 0
    samples = SAMPLES[colour]
    bits, image = samples * depth, np.zeros((h, w, samples), np.uint8)
    for y0, dy, x0, dx in PASSES if interlaced else ((0, 1, 0, 1),):
        ph, pw = len(range(y0, h, dy)), len(range(x0, w, dx))
        if not ph or not pw:
            continue
        row = (pw * bits + 7) // 8
        lines = np.frombuffer(raw, np.uint8, ph * (row + 1), used).reshape(ph, row + 1)
        used += ph * (row + 1)
        plain = _unfiltered(lines[:, 1:], lines[:, 0], max(1, bits // 8))
        if depth == 16:
            values = plain[:, ::2]
        elif depth == 8:
            values = plain
        else:
            values = np.unpackbits(plain, axis=1)[:, : pw * bits].reshape(ph, -1, depth) @ (1 << np.arange(depth)[::-1])
            values = values if colour == 3 else values * (255 // (2**depth - 1))
        image[y0::dy, x0::dx] = values.reshape(ph, pw, samples)
    if colour == 3:
        return palette[image[:, :, 0]][:, :, ::-1]
    return np.repeat(image[:, :, :1], 3, axis=2) if samples < 3 else image[:, :, 2::-1]


def encode(image: np.ndarray) -> bytes:
    """A PNG of (height, width, 3) blue-green-red bytes."""
    h, w = image.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image[:, :, ::-1].reshape(h, 3 * w)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return MAGIC["png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


# ---- BMP ------------------------------------------------------------------------------------------------------------


def _bmp(content: bytes) -> np.ndarray:
    offset, size, w, h, _, bits, packed = struct.unpack("<10xIIiiHHI", content[:34])
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise CodecError("a bmp form that isn't read")
    row = (w * bits + 31) // 32 * 4
    lines = np.frombuffer(content, np.uint8, abs(h) * row, offset).reshape(abs(h), row)
    lines = lines[::-1] if h > 0 else lines
    if bits >= 24:
        return lines[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, :3]
    used = struct.unpack("<I", content[46:50])[0] or 2**bits
    palette = np.frombuffer(content, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, :3]
    places = np.unpackbits(lines, axis=1).reshape(abs(h), -1, bits) @ (1 << np.arange(bits)[::-1])
    return palette[places[:, :w]]


def encode_bmp(image: np.ndarray) -> bytes:
    """A BMP of (height, width, 3) blue-green-red bytes."""
    h, w = image.shape[:2]
    lines = np.pad(image.reshape(h, 3 * w)[::-1], [(0, 0), (0, -3 * w % 4)])
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + lines.size, 0, 54, 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


# ---- JPEG -----------------------------------------------------------------------------------------------------------


def _zigzag() -> np.ndarray:
    """Places of the 64 coefficients in the order of the file."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag().tolist()


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits, symbol) of the code that each 16-bit number begins with."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for bits, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first = code << (16 - bits)
            table[first : first + (1 << (16 - bits))] = [(bits, symbol)] * (1 << (16 - bits))
            code += 1
        at += n
        code <<= 1
    return table


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 8].ljust(8, b"\xff")
            self.at += 8
            if self.at > len(self.data) + 64:
                raise CodecError("a jpeg scan ends early")
            self.held, self.n = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(chunk, "big"), self.n + 64

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        bits, found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not bits:
            raise CodecError("an unknown jpeg code")
        self.n -= bits
        return found

    def value(self, size: int) -> int:
        if not size:
            return 0
        self.need(size)
        self.n -= size
        found = (self.held >> self.n) & ((1 << size) - 1)
        return found if found >> (size - 1) else found - (1 << size) + 1


def _doubled(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along ``axis``, each three parts its own and one part its nearer neighbour."""
    p = np.moveaxis(plane, axis, 0)
    before, after = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
    return np.moveaxis(np.stack([(3 * p + before) / 4, (3 * p + after) / 4], axis=1).reshape(-1, *p.shape[1:]), 0, axis)


def _jpeg(content: bytes) -> np.ndarray:
    at, steps, codes, parts, interval, transform = 2, {}, {}, [], 0, None
    while True:
        while content[at] == 0xFF and content[at + 1] == 0xFF:
            at += 1
        mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        body, at = content[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                steps[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(float)
                body = body[n:]
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17:n])
                body = body[n:]
        elif mark in (0xC0, 0xC1):
            h, w, n = struct.unpack(">xHHB", body[:6])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise CodecError("a progressive or lossless jpeg")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif mark == 0xDA:
            break
    if len(parts) not in (1, 3):
        raise CodecError("a jpeg of unusual channels")
    used = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
    if len(used) != len(parts):
        raise CodecError("a jpeg of several scans")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    mh, mv = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * mh)), -(-h // (8 * mv))
    found = [np.zeros((down * v, across * x, 64)) for _, x, v, _ in parts]
    scan = content[at:]
    end = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", scan)
    segments = re.split(rb"\xff[\xd0-\xd7]", scan[: end.start()] if end else scan)
    total, unit = across * down, 0
    for segment in segments:
        bits, last = _Bits(segment.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for unit in range(unit, min(total, unit + interval) if interval else total):
            my, mx = divmod(unit, across)
            for k, (name, x, v, _) in enumerate(parts):
                dc, ac = codes[used[name][0]], codes[16 + used[name][1]]
                for b in range(v * x):
                    block = found[k][my * v + b // x, mx * x + b % x]
                    last[k] += bits.value(bits.symbol(dc))
                    block[0] = last[k]
                    i = 1
                    while i < 64:
                        symbol = bits.symbol(ac)
                        if not symbol & 15:
                            if symbol != 0xF0:
                                break
                            i += 16
                            continue
                        i += symbol >> 4
                        block[ZIGZAG[i]] = bits.value(symbol & 15)
                        i += 1
        unit += 1
        if unit >= total:
            break
    if unit < total:
        raise CodecError("a jpeg scan ends early")
    basis, planes = cosines(8), []
    for (_, x, v, q), own in zip(parts, found):
        table = np.zeros(64)
        table[ZIGZAG] = steps[q]
        rows, cols = own.shape[:2]
        plane = (basis.T @ (own * table).reshape(rows, cols, 8, 8) @ basis).swapaxes(1, 2).reshape(8 * rows, 8 * cols)
        plane = np.clip(np.round(plane + 128), 0, 255)
        plane = plane[: -(-h * v // mv), : -(-w * x // mh)]
        for axis, times in ((0, mv // v), (1, mh // x)):
            plane = _doubled(plane, axis) if times == 2 else np.repeat(plane, times, axis=axis)
        planes.append(plane[:h, :w])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes
    if transform == 0:
        b, g, r = cr, cb, y
    else:
        b, g, r = y + 1.772 * (cb - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.402 * (cr - 128)
    return np.clip(np.round(np.stack([b, g, r], axis=2)), 0, 255).astype(np.uint8)


DECODERS = {"png": _png, "bmp": _bmp, "jpeg": _jpeg}
