"""FLAC columns: bytes as 8-bit mono samples, coded losslessly and read back by seekable frames.

Encoding takes, for each frame of up to 4096 samples, the best of a constant, the plain
samples and a fixed linear predictor of order 0 to 2 with Rice-coded residuals.  Every frame has a
seek point, so decoding starts at any of them.  Decoding verifies the header's CRC-8, the
frame's CRC-16 and the MD5 of all samples; it also reads frames that other encoders made (any fixed order,
quantised linear predictors, Rice partitions, escape codes, wasted bits), a sample at a time.

Many frames are coded together: numpy follows one Rice code of each frame at a step.  Frames
go in groups of bounded size, so memory beyond the media itself doesn't grow with a text.

Defined cases: a null text is empty; an empty payload is padded to one unit of zeros; equal
payloads have equal media; a broken frame raises ``ValueError`` and nothing is returned in its place; repeated rows
are coded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT, BLOCK, GROUP = 64, 4096, 256
LONGEST = BLOCK + 64
#: Fixed values of the format.
SYNC, RATE_8K, BITS_8, BLOCK_4096, BLOCK_16BIT = 0xFFF8, 4, 1, 12, 7
SEEK, HEAD = 18, 42


def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (poly if crc >> (bits - 1) else 0) & ((1 << bits) - 1) if crc >> (bits - 1) else crc << 1
            crc &= (1 << bits) - 1
        out.append(crc)
    return np.array(out, np.uint16)


CRC8 = _crc_table(8, 0x07).tolist()
CRC16 = _crc_table(16, 0x8005)


def _distances() -> np.ndarray:
    """What a byte adds to the CRC-16 of a frame, by how many bytes follow it: the checksum is linear."""
    table = np.empty((LONGEST, 256), np.uint16)
    table[0] = CRC16
    for d in range(1, LONGEST):
        table[d] = (table[d - 1] << np.uint16(8)) ^ CRC16[table[d - 1] >> np.uint16(8)]
    return table.reshape(-1)


_DISTANCE = _distances()


def crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = CRC8[crc ^ byte]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of data[start:end] for each pair, which follow one another without gaps."""
    n = ends - starts
    if n.max() > LONGEST:
        return np.array([_crc16_one(data[a:b]) for a, b in zip(starts, ends)], np.uint16)
    left = np.repeat(ends, n) - 1 - np.arange(starts[0], ends[-1])
    return np.bitwise_xor.reduceat(_DISTANCE[left * 256 + data[starts[0] : ends[-1]]], starts - starts[0])


def _crc16_one(data: np.ndarray) -> int:
    crc, table = 0, CRC16.tolist()
    for byte in data.tolist():
        crc = ((crc << 8) & 0xFFFF) ^ table[(crc >> 8) ^ byte]
    return crc


def _number(n: int) -> bytes:
    """A frame's number, coded as UTF-8 codes characters."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF80 >> len(tail)) & 0xFF | n, *reversed(tail)])


def _header(n: int, number: int) -> bytes:
    code = BLOCK_4096 if n == BLOCK else BLOCK_16BIT
    head = SYNC.to_bytes(2, "big") + bytes([code << 4 | RATE_8K, BITS_8 << 1]) + _number(number)
    head += b"" if n == BLOCK else (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def encode_frames(data: np.ndarray, lengths: np.ndarray, numbers: list[int]) -> list[bytes]:
    """A frame of each run of ``lengths`` bytes in ``data``."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    x = data.astype(np.int32) - 128
    one = np.diff(x, prepend=x[:1])
    one[starts] = 0
    two = np.diff(one, prepend=one[:1])
    two[starts] = 0
    two[starts + 1] = 0
    sizes = np.stack([np.add.reduceat(np.abs(r), starts) for r in (x, one, two)])
    order = sizes.argmin(axis=0)
    sample_order = np.repeat(order, lengths)
    r = np.where(sample_order == 0, x, np.where(sample_order == 1, one, two))
    u = ((r << 1) ^ (r >> 31)).astype(np.int32)
    coded = lengths - order
    total = np.add.reduceat(u, starts, dtype=np.int64)
    guess = np.clip(np.floor(np.log2(np.maximum(total / coded, 1))), 0, 13).astype(np.int32)
    trials = []
    for k in (np.maximum(guess - 1, 0), guess, guess + 1):
        trials.append(coded * (k + 1) + np.add.reduceat(u >> np.repeat(k, lengths), starts))
    best = np.argmin(trials, axis=0)
    k = np.choose(best, [np.maximum(guess - 1, 0), guess, guess + 1]).astype(np.int32)
    # A sample before the order is no residual; its u is 0 and its code is taken off here.
    rice = np.choose(best, trials) + 18 + 8 * order
    same = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    plain = ~same & (rice >= 8 + 8 * lengths)
    rice_coded = ~same & ~plain
    sub_bits = np.where(same, 16, np.where(plain, 8 + 8 * lengths, rice))
    heads = [_header(int(n), number) for n, number in zip(lengths, numbers)]
    head_bytes = np.array([len(h) for h in heads])
    frame_bytes = head_bytes + (sub_bits + 7) // 8 + 2
    frame_ends = np.cumsum(frame_bytes)
    frame_starts = frame_ends - frame_bytes
    sub_at = frame_starts + head_bytes
    out = np.zeros(int(frame_ends[-1]), np.uint8)

    place = np.arange(len(x), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
    at = np.flatnonzero(np.repeat(rice_coded, lengths) & (place >= sample_order))
    if len(at):
        per_frame = np.where(rice_coded, coded, 0)
        ks, us = np.repeat(k, per_frame), u[at]
        q = us >> ks
        run = np.cumsum(q + ks + 1, dtype=np.int64)
        first = np.cumsum(per_frame) - per_frame
        shift = np.zeros(len(lengths), np.int64)
        shift[rice_coded] = (sub_at * 8 + 18 + 8 * order)[rice_coded] - np.append(0, run)[first[rice_coded]]
        # The closing one of a code and its k low bits lie within three bytes.
        stop = run + np.repeat(shift, per_frame) - ks - 1
        byte = stop >> 3
        three = (1 << ks | us & (1 << ks) - 1) << (23 - (stop & 7) - ks)
        new = np.flatnonzero(np.diff(byte, prepend=-1))
        three, byte = np.add.reduceat(three, new), byte[new]
        out[byte] = three >> 16
        out[byte + 1] += (three >> 8 & 255).astype(np.uint8)
        out[byte + 2] += (three & 255).astype(np.uint8)
    two_at = (sub_at + 1 + order)[rice_coded]  # coding method and partition order are 0, then the parameter
    out[two_at] += (k[rice_coded] >> 2).astype(np.uint8)
    out[two_at + 1] += ((k[rice_coded] & 3) << 6).astype(np.uint8)
    kind = np.where(same, 0, np.where(plain, 1, 8 + order))
    out[sub_at] = kind << 1
    for i in range(2):
        warm = rice_coded & (order > i)
        out[sub_at[warm] + 1 + i] = (x[starts[warm] + i] & 0xFF).astype(np.uint8)
    out[sub_at[same] + 1] = (x[starts[same]] & 0xFF).astype(np.uint8)
    for f in np.flatnonzero(plain):
        out[sub_at[f] + 1 : sub_at[f] + 1 + lengths[f]] = (x[starts[f] : ends[f]] & 0xFF).astype(np.uint8)
    for start, head in zip(frame_starts, heads):
        out[start : start + len(head)] = np.frombuffer(head, np.uint8)
    # The checksum of a frame and its two last bytes is zero; with these still zero, it is what they must hold.
    left = np.repeat(frame_ends, frame_bytes) - 3 - np.arange(len(out))
    left[left < 0] = 0
    crc = np.bitwise_xor.reduceat(np.where(np.arange(len(out)) < np.repeat(frame_ends - 2, frame_bytes), _DISTANCE[left * 256 + out], 0), frame_starts)
    out[frame_ends - 2], out[frame_ends - 1] = crc >> 8, crc & 0xFF
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(frame_starts.tolist(), frame_ends.tolist())]


def _file(frames: list[bytes], sizes: list[int], samples: bytes) -> bytes:
    total, at, seek = len(samples), 0, []
    for i, (frame, n) in enumerate(zip(frames, sizes)):
        seek.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + n.to_bytes(2, "big"))
        at += len(frame)
    small, large = min(map(len, frames)), max(map(len, frames))
    rest = 8000 << 44 | 0 << 41 | 7 << 36 | total
    info = BLOCK.to_bytes(2, "big") * 2 + small.to_bytes(3, "big") + large.to_bytes(3, "big") + rest.to_bytes(8, "big") + hashlib.md5(samples).digest()
    table = b"".join(seek)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's payload, and its bytes before the padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file of each payload (a positive multiple of 64 bytes)."""
    sizes = [[min(BLOCK, len(p) - at) for at in range(0, len(p), BLOCK)] for p in payloads]
    lengths = np.array([n for own in sizes for n in own], np.int64)
    numbers = [i for own in sizes for i in range(len(own))]
    data, frames, at = np.frombuffer(b"".join(payloads), np.uint8), [], 0
    for g in range(0, len(lengths), GROUP):
        some = lengths[g : g + GROUP]
        frames += encode_frames(data[at : at + some.sum()], some, numbers[g : g + GROUP])
        at += int(some.sum())
    out, f = [], 0
    for payload, own in zip(payloads, sizes):
        samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        out.append(_file(frames[f : f + len(own)], own, samples))
        f += len(own)
    return out


def _metadata(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples, their MD5, the seek points (sample, offset, samples) and where the frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, points, total, digest = 4, False, [], 0, b""
    while not last:
        last, kind, n = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body, at = media[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 36 & 31) != 7 or packed >> 41 & 7:
                raise ValueError("only 8-bit mono streams are read")
            total, digest = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, n, SEEK)]
    return total, digest, [p for p in points if p[0] != (1 << 64) - 1], at


def _frame_header(media: bytes, at: int) -> tuple[int, int]:
    """Samples of the frame at ``at`` and where its subframe begins; checks the header's CRC-8."""
    if media[at] != 0xFF or media[at + 1] & 0xFE != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    code, end = media[at + 2] >> 4, at + 4
    lead = media[end]
    end += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if code == 6:
        n, end = media[end] + 1, end + 1
    elif code == 7:
        n, end = int.from_bytes(media[end : end + 2], "big") + 1, end + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)
    end += {12: 1, 13: 2, 14: 2}.get(media[at + 2] & 15, 0)
    if crc8(media[at : end + 1]):
        raise ValueError(f"the header of the frame at byte {at} is damaged")
    return n, end + 1


def decode_frames(media: bytes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Samples (int32) of the frames media[start:end], which follow one another."""
    base = int(starts[0])
    data = np.frombuffer(media, np.uint8, int(ends[-1]) - base, base)
    if (bad := np.flatnonzero(crc16(data, starts - base, ends - base))).size:
        raise ValueError(f"the frame at byte {starts[bad[0]]} is damaged")
    out: list[np.ndarray | None] = [None] * len(starts)
    lanes = []
    for f, at in enumerate(starts.tolist()):
        n, sub = _frame_header(media, at)
        kind = media[sub] >> 1
        if media[sub] == 0:
            out[f] = np.full(n, _signed(media[sub + 1]), np.int32)
        elif media[sub] == 2:
            out[f] = np.frombuffer(media, np.int8, n, sub + 1).astype(np.int32)
        elif 8 <= kind <= 10 and not media[sub] & 1 and n > kind - 8 and not media[sub + 1 + kind - 8] & 0xFC | (media[sub + 1 + kind - 8] & 3 == 3 and media[sub + 2 + kind - 8] >= 0xC0):
            order = kind - 8
            warm = sub + 1 + order
            lanes.append((n, f, order, (media[warm] & 3) << 2 | media[warm + 1] >> 6, (warm - base) * 8 + 10, [_signed(b) for b in media[sub + 1 : warm]]))
        else:
            out[f] = _subframe(media, sub, n, 8)
    if lanes:
        lanes.sort(key=lambda lane: -lane[0] + lane[2])
        for (_, f, *_rest), samples in zip(lanes, _rice_lanes(data, lanes)):
            out[f] = samples
    return out


def _signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


def _rice_lanes(data: np.ndarray, lanes: list[tuple]) -> list[np.ndarray]:
    """Rice codes of all lanes, one code of each at a step; lanes come longest first."""
    ones = np.flatnonzero(np.unpackbits(data)).astype(np.int32)
    stops = np.append(np.repeat(ones, np.diff(ones, prepend=-1)), np.full(64, len(data) * 8, np.int32))  # the next one, from any bit on
    counts = np.array([n - order for n, _, order, *_ in lanes])
    ks = np.array([lane[3] for lane in lanes], np.int32)
    p = np.array([lane[4] for lane in lanes], np.int32)
    found = np.empty((int(counts[0]) + 1, len(lanes)), np.int32)
    after = ks + 1
    found[0] = p - after
    alive = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left").tolist()
    for t, many in enumerate(alive, 1):
        row = found[t, :many]
        np.take(stops, p[:many], out=row, mode="clip")
        np.add(row, after[:many], out=p[:many])
    window = np.zeros(len(data) + 3, np.int32)
    window[: len(data)] = data
    window[:-2] = window[:-2] << 16 | window[1:-1] << 8 | window[2:]
    out = []
    for i, (n, _, order, k, _, warm) in enumerate(lanes):
        at = found[: n - order + 1, i].copy()
        u = np.diff(at) - (k + 1) << k
        low = at[1:] + 1
        u |= window[low >> 3] >> (24 - k - (low & 7)) & (1 << k) - 1
        x = (u >> 1) ^ -(u & 1)
        if order == 2:
            x = np.cumsum(x) + (warm[1] - warm[0])
        if order:
            x = np.concatenate([warm, np.cumsum(x) + warm[-1]])
        out.append(x.astype(np.int32))
    return out


def _subframe(media: bytes, at: int, n: int, bits: int) -> np.ndarray:
    """Any mono subframe, a sample at a time: linear predictors, partitions, escape codes, wasted bits."""
    whole = int.from_bytes(media[at : at + 2 * n + 4096], "big")
    size, pos = len(media[at : at + 2 * n + 4096]) * 8, 0

    def take(k: int) -> int:
        nonlocal pos
        pos += k
        return whole >> (size - pos) & ((1 << k) - 1) if k else 0

    def signed(k: int) -> int:
        value = take(k)
        return value - (1 << k) if k and value >> (k - 1) else value

    def unary() -> int:
        count = 0
        while not take(1):
            count += 1
        return count

    take(1)
    kind, wasted = take(6), take(1)
    wasted = unary() + 1 if wasted else 0
    bits -= wasted
    if kind == 0:
        samples = [signed(bits)] * n
    elif kind == 1:
        samples = [signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        samples = [signed(bits) for _ in range(order)]
        #: The format's fixed predictors, last sample first.
        coefficients, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind <= 12 else [], 0
        if kind >= 32:
            precision, shift = take(4) + 1, signed(5)
            coefficients = [signed(precision) for _ in range(order)]
        width, parts = (4, 5)[take(2)], 1 << take(4)
        for part in range(parts):
            k = take(width)
            escape = take(5) if k == (1 << width) - 1 else None
            for _ in range(n // parts - (order if not part else 0)):
                if escape is None:
                    high = unary()
                    u = high << k | take(k)
                    residual = (u >> 1) ^ -(u & 1)
                else:
                    residual = signed(escape)
                samples.append(residual + (sum(c * samples[-1 - i] for i, c in enumerate(coefficients)) >> shift))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    return np.array(samples, np.int64).astype(np.int32) << wasted


def frame_edges(media: bytes) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Samples, MD5, and first and last bytes of the frames, from the seek points."""
    total, digest, points, at = _metadata(media)
    if not points or sum(p[2] for p in points) != total:
        raise ValueError("a seek point of each frame is needed")
    edges = np.array([at + p[1] for p in points] + [len(media)], np.int64)
    return total, digest, edges[:-1], edges[1:]


def decode(media: bytes) -> Iterator[np.ndarray]:
    """PCM blocks (uint8) of a file, in groups of frames; checks the MD5 at the end."""
    total, digest, starts, ends = frame_edges(media)
    md5, n = hashlib.md5(), 0
    for g in range(0, len(starts), GROUP):
        for samples in decode_frames(media, starts[g : g + GROUP], ends[g : g + GROUP]):
            md5.update(samples.astype(np.int8).tobytes())
            n += len(samples)
            yield (samples + 128).astype(np.uint8)
    if n != total or any(digest) and md5.digest() != digest:
        raise ValueError("the samples differ from those that were coded")


def decode_many(files: list[bytes]) -> list[bytes]:
    """The payloads of many files; frames of different files are decoded together."""
    edges = [frame_edges(m) for m in files]
    out: list[bytes] = []
    g = 0
    while g < len(files):
        h, frames = g, 0
        while h < len(files) and (h == g or frames + len(edges[h][2]) <= GROUP):
            frames += len(edges[h][2])
            h += 1
        if frames > GROUP:
            out.append(b"".join(b.tobytes() for b in decode(files[g])))
        else:
            joined, at = [], 0
            starts, ends = [], []
            for media, (_, _, first, last) in zip(files[g:h], edges[g:h]):
                joined.append(media[first[0] :])
                starts.append(first - first[0] + at)
                ends.append(last - first[0] + at)
                at += len(joined[-1])
            blocks = decode_frames(b"".join(joined), np.concatenate(starts), np.concatenate(ends))
            f = 0
            for total, digest, first, _ in edges[g:h]:
                samples = np.concatenate(blocks[f : f + len(first)])
                f += len(first)
                if len(samples) != total or hashlib.md5(samples.astype(np.int8).tobytes()).digest() != digest:
                    raise ValueError("the samples differ from those that were coded")
                out.append((samples + 128).astype(np.uint8).tobytes())
        g = h
    return out


def _grouped(values: Iterator, size, most: int = 1 << 20) -> Iterator[list]:
    held, total = [], 0
    for value in values:
        held.append(value)
        total += size(value)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a FLAC file."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in _grouped((padded(t.as_py()) for t in batch.column(1)), lambda p: len(p[0])):
                media = encode_many([p for p, _ in some])
                own = batch.column(0).slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([own, pa.array([n for _, n in some], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def features(payload: bytes) -> str:
    """Mean, mean square and sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.sum() / len(x):.4f};power={(x * x).sum() / len(x):.4f};changes={changes}"


def digest(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) read back: sizes, checksums and features of the payload and of the stored form."""
    schema = T.StructType([media.schema["doc_id"], T.StructField("n_bytes", T.LongType())])
    for name, kind in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())):
        schema = schema.add(name, kind)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for some in _grouped((m.as_py() for m in batch.column(2)), len):
                for stored, payload in zip(some, decode_many(some)):
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [f.name for f in schema.fields])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> (doc_id, sample_offset, samples, pcm): one row per frame, at its sample offset."""
    schema = T.StructType([media.schema["doc_id"], T.StructField("sample_offset", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stored in enumerate(batch.column(1)):
                at = 0
                for block in decode(stored.as_py()):
                    columns = [pa.array([at], pa.int64()), pa.array([len(block)], pa.int64()), pa.array([block.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *columns], [f.name for f in schema.fields])
                    at += len(block)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def read_from(media: bytes, sample: int, n: int) -> bytes:
    """``n`` samples from ``sample`` on; only the frames that hold them are decoded."""
    _, _, points, at = _metadata(media)
    _, _, starts, ends = frame_edges(media)
    some = [i for i, (first, _, many) in enumerate(points) if first < sample + n and first + many > sample]
    if not some:
        return b""
    blocks = decode_frames(media, starts[some[0] : some[-1] + 1], ends[some[0] : some[-1] + 1])
    joined = (np.concatenate(blocks) + 128).astype(np.uint8).tobytes()
    skip = sample - points[some[0]][0]
    return joined[skip : skip + n]
