"""FLAC frames of another encoder: linear predictors, partitions, escape codes, wasted bits; and reading from the middle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import flac


class Bits:
    def __init__(self) -> None:
        self.text = ""

    def put(self, value: int, width: int) -> Bits:
        self.text += f"{value & ((1 << width) - 1):0{width}b}" if width else ""
        return self

    def rice(self, value: int, k: int) -> Bits:
        u = 2 * value if value >= 0 else -2 * value - 1
        self.text += "0" * (u >> k) + "1"
        return self.put(u, k)

    def done(self) -> bytes:
        text = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def crc(data: bytes, width: int, poly: int) -> int:
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> (width - 1) else 0)) & ((1 << width) - 1)
    return value


def frame(subframe: bytes, n: int) -> bytes:
    head = bytes([0xFF, 0xF8, 7 << 4 | 4, 1 << 1, 0]) + (n - 1).to_bytes(2, "big")
    whole = head + bytes([crc(head, 8, 0x07)]) + subframe
    return whole + crc(whole, 16, 0x8005).to_bytes(2, "big")


def decoded(data: bytes) -> list[int]:
    (samples,) = flac.decode_frames(data, np.array([0]), np.array([len(data)]))
    return samples.tolist()


def residuals(x: list[int], coefficients: list[int], shift: int) -> list[int]:
    order = len(coefficients)
    return [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(order, len(x))]


WAVE = [round(40 * np.sin(i / 5) + (i * 7 % 3)) for i in range(64)]


@pytest.mark.parametrize("order,coefficients", [(0, []), (1, [1]), (2, [2, -1]), (3, [3, -3, 1]), (4, [4, -6, 4, -1])])
@pytest.mark.parametrize("width,method", [(4, 0), (5, 1)])
@pytest.mark.parametrize("partitions", [0, 2])
def test_fixed_predictors(order, coefficients, width, method, partitions):
    bits = Bits().put(0, 1).put(8 + order, 6).put(0, 1)
    for v in WAVE[:order]:
        bits.put(v, 8)
    bits.put(method, 2).put(partitions, 4)
    rest, size, at = residuals(WAVE, coefficients, 0), 64 >> partitions, 0
    for part in range(1 << partitions):
        k = 2 + part
        bits.put(k, width)
        many = size - (order if not part else 0)
        for v in rest[at : at + many]:
            bits.rice(v, k)
        at += many
    assert decoded(frame(bits.done(), 64)) == WAVE


def test_linear_predictor_with_an_escaped_partition():
    coefficients, shift, precision = [13, -6], 3, 6
    rest = residuals(WAVE, coefficients, shift)
    bits = Bits().put(0, 1).put(32 + 1, 6).put(0, 1)
    for v in WAVE[:2]:
        bits.put(v, 8)
    bits.put(precision - 1, 4).put(shift, 5)
    for c in coefficients:
        bits.put(c, precision)
    bits.put(0, 2).put(1, 4).put(3, 4)
    for v in rest[:30]:
        bits.rice(v, 3)
    bits.put(15, 4).put(9, 5)
    for v in rest[30:]:
        bits.put(v, 9)
    assert decoded(frame(bits.done(), 64)) == WAVE


def test_wasted_bits():
    even = [v // 4 * 4 for v in WAVE]
    bits = Bits().put(0, 1).put(1, 6).put(1, 1).put(1, 2)  # two low bits are zero: one less, in unary
    for v in even:
        bits.put(v >> 2, 6)
    assert decoded(frame(bits.done(), 64)) == even


@pytest.mark.parametrize("at", [3, 7, 20, -1])
def test_a_changed_bit_is_found(at):
    bits = Bits().put(0, 1).put(1, 6).put(0, 1)
    for v in WAVE:
        bits.put(v, 8)
    data = bytearray(frame(bits.done(), 64))
    data[at] ^= 4
    with pytest.raises(ValueError):
        decoded(bytes(data))


def test_reading_from_the_middle(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(30_000))
    media = flac.encode(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    payload = text.encode() + bytes(-len(text) % 64)
    for first, n in ((0, 10), (4090, 20), (12_345, 9000), (len(payload) - 5, 50), (len(payload) + 1, 3)):
        assert flac.read_from(stored[1], first, n) == payload[first : first + n]
    blocks = flac.pcm_blocks(media).where("doc_id = 1").orderBy("sample_offset").collect()
    assert b"".join(r.pcm for r in blocks) == payload and [r.sample_offset for r in blocks] == list(np.cumsum([0, *[r.samples for r in blocks]])[:-1])
    assert flac.pcm_blocks(media).where(F.col("doc_id") == 2).first().samples == 64
