"""Words of many texts at once, as arrays: where they lie, and a 64-bit hash of each.

Texts are scanned as arrays of bytes; nothing runs once a word but for the few of over ``LONGEST`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of a word that the array hash takes; longer words are hashed one by one.
LONGEST = 256
#: Bytes that are scanned at a time.
SCAN = 1 << 18
_odd = np.random.default_rng(97).integers(0, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERM, BASE = _odd[:256], _odd[256]
POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(LONGEST, BASE)]))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(values: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of ``inside`` in the byte array ``values``: a polynomial in a fixed odd number over random terms."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    terms = TERM[values[inside]] * POWER[np.minimum(place, LONGEST)]
    found = mixed(np.add.reduceat(terms, first) + length.astype(np.uint64))
    for i in np.flatnonzero(length > LONGEST):
        found[i] = int.from_bytes(blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return found


def groups(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[list[tuple[tuple, str]]]:
    """Rows as (other columns, text), null texts empty, gathered until ``size`` code points are there: bounded but for one text."""
    held, n = [], 0
    for batch in batches:
        others = [batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != text]
        for k, own in enumerate(batch.column(batch.schema.get_field_index(text))):
            own = own.as_py() or ""
            held.append((tuple(x[k] for x in others), own))
            n += len(own)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held
