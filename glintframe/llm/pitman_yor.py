"""Texts scored by a hierarchical Pitman-Yor model whose Chinese-restaurant seating is sampled by Gibbs.

Contexts.  A word is drawn in the restaurant of how the word before it ends: its last two bytes in UTF-8 (nothing before the
first word).  All of these that share the last byte share a parent, and the parents share the root, whose base is
uniform over the words learned and one more, which stands for all others.  A customer at a
new table is a customer of the parent.  There are at most 65,536 + 256 + 1 restaurants, whatever the corpus; what grows with it are the dishes (words
in contexts), and these are dealt over tasks by their word, so that a word's seating in all contexts is in one place.

Gibbs.  A restaurant's dishes depend on each other through its number of tables alone.  With an auxiliary gamma
variable g for each restaurant, given its tables, the dishes are independent: that of c customers has t tables with a probability in proportion to
S(c, t) a^t, where a = d g p, d is the discount, p the parent's probability of the word without this dish's own
customers, and S are generalised Stirling numbers.  A sweep draws t for all dishes, level by level,
then the totals of tables give new g.  Up to ``EXACT`` customers t is drawn from that law itself; beyond, tables are a
Poisson process conditioned on its customers, and t comes from its limits: normal with the conditional
mean and variance, or, for few tables, one large table and a Poisson number of others.  After
``BURN`` sweeps, ``SAMPLES`` more are kept, and a word's probability is the mean of its predictive probabilities in these.  Discounts are
estimated from counts of counts (n1 / (n1 + 2 n2)) at each level.  Draws are hashes of word, context and sweep: reruns agree.

Jobs.  Texts are read once, in chunks of about ``CHUNK`` code points: a chunk keeps for each token the number of its (word, context) pair, and
sends its distinct pairs, with their counts in training texts, to the buckets of their words.  Buckets add up the
counts, sample the seating, and answer each chunk with its pairs' probabilities, which the chunk sums by document.  No
task needs the vocabulary, and a word that is a third of all tokens is a row a chunk.

Defined cases: a null or empty text is its end alone; a null id counts as the empty string for the hold-out; rows with equal ids
are scored each; an empty table gives an empty result; without training tokens every token has the base probability 1; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, settings, written
from .placed import bucketed
from .wordscan import SCAN, groups, hashes, mixed, runs

#: Code points of a chunk, and buckets that words are dealt to.
CHUNK, BUCKETS = 2 << 20, 1024
#: Pairs that a task merges or samples at a time, about.
AT_ONCE = 1 << 18
#: Bytes of an Arrow batch: rows are blocks of up to some megabytes.
BATCH = 4 << 20
#: Sweeps before samples are kept, and samples.
BURN, SAMPLES = 2, 3
#: Strength of every restaurant; customers up to which tables are drawn from their exact law; tables from which on the normal limit holds.
STRENGTH, EXACT, NORMAL_FROM = 1.0, 128, 12.0
#: The end's number as a word; no hash of a word is 0 (``_tokens``).
END = 0
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


# ---- texts as tokens ------------------------------------------------------------------------------------------------


def _parts(data: bytes) -> Iterator[bytes]:
    """``data`` cut after separators, in parts of about ``SCAN`` bytes."""
    at = 0
    while len(data) - at > SCAN:
        ends = [i for i in (data.find(bytes([b]), at + SCAN) for b in np.flatnonzero(SEPARATOR)) if i >= 0]
        if not ends:
            break
        yield data[at : min(ends) + 1]
        at = min(ends) + 1
    yield data[at:]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (the end last) of all texts, the context of each (last byte of the word before, and the one before that), and where each text starts."""
    words, contexts, counts = [], [], np.zeros(len(texts), np.int64)
    held, size, first = [], 0, 0

    def scan(own: list[bytes], first: int) -> None:
        # Texts are joined by a line feed, so no word spans two.
        values = SMALL[np.frombuffer(b"\n".join(own), np.uint8)]
        inside = ~SEPARATOR[values]
        starts, ends = runs(inside)
        found = hashes(values, inside, starts, ends)
        found[found == END] = 1
        ending = values[ends - 1].astype(np.uint16) << 8 | np.where(ends - starts > 1, values[np.maximum(ends - 2, 0)], 0)
        limits = np.cumsum([0, *[len(x) + 1 for x in own]])
        owner = np.searchsorted(limits, starts, side="right") - 1
        counts[first : first + len(own)] += np.bincount(owner, minlength=len(own))
        words.append(found)
        contexts.append(ending.astype(np.uint16))

    for i, text in enumerate(texts):
        data = text.encode()
        if len(data) > SCAN:
            if held:
                scan(held, first)
            for part in _parts(data):
                scan([part], i)
            held, size, first = [], 0, i + 1
            continue
        held.append(data)
        size += len(data)
        if size >= SCAN:
            scan(held, first)
            held, size, first = [], 0, i + 1
    if held:
        scan(held, first)
    flat, ending = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((words, np.uint64), (contexts, np.uint16)))
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out, before = np.full(starts[-1], END, np.uint64), np.zeros(starts[-1], np.uint16)
    is_word = np.ones(starts[-1], bool)
    is_word[starts[1:] - 1] = False
    out[is_word] = flat
    at = np.flatnonzero(is_word)
    before[at + 1] = ending  # after each word comes a word or the end of its text
    return out, before, starts


def _scanned(docs: DataFrame, chunk: int) -> DataFrame:
    """Chunks (kind 0: their rows and each token's pair) and what they send to the buckets (kind 1: words, pairs, training counts)."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"kind int, chunk long, bucket int, ids array<{kind}>, held array<boolean>, starts binary, at binary, first int, words binary, sizes binary, keys binary, n binary"
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in groups(batches, "text", chunk):
            words, before, starts = _tokens([text for _, text in rows])
            ids, held = ([key[k] for key, _ in rows] for k in (0, 1))
            train = ~np.repeat(np.array(held, bool), np.diff(starts))
            known, code = np.unique(words, return_inverse=True)
            order = np.lexsort((known, bucket(known)))  # distinct words by bucket
            place = np.empty(len(known), np.int64)
            place[order] = np.arange(len(known))
            pairs, at = np.unique(place[code] << 16 | before, return_inverse=True)
            known = known[order]
            n = np.bincount(at[train], minlength=len(pairs)).astype(np.uint32)
            keys, sizes = (pairs & 0xFFFF).astype(np.uint16), np.bincount(pairs >> 16, minlength=len(known)).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([dict(kind=0, chunk=number, ids=ids, held=held, starts=starts.tobytes(), at=at.astype(np.uint32).tobytes())], arrow)
            own, limits = bucket(known), np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                i, j = int(limits[a]), int(limits[b])
                out.append(dict(kind=1, chunk=number, bucket=int(own[a]), first=i, words=known[a:b].tobytes(), sizes=sizes[a:b].tobytes(), keys=keys[i:j].tobytes(), n=n[i:j].tobytes()))
            yield pa.RecordBatch.from_pylist(out, arrow)
            number += 1

    return bucketed(docs.mapInArrow(scan, schema), "chunk", scratch(docs.sparkSession, "lm-scan"))


def bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) % BUCKETS


# ---- seating --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) at discount ``d``, c and t up to ``EXACT``."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        s[c + 1, t] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(np.maximum(c - d * t, 1e-300)))
    return s


def tables(c: np.ndarray, a: np.ndarray, d: float, u: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A draw of the tables of each dish of ``c`` customers: t in proportion to S(c, t) a^t.  ``u``, ``z``: two uniform numbers for each."""
    t = np.ones(len(c), np.int64)
    log_a = np.log(np.maximum(a, 1e-300))
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    s = stirling(round(d, 6))
    cuts = np.flatnonzero(np.diff(c[small], prepend=0, append=0))
    for i, j in zip(cuts[:-1], cuts[1:]):
        n = int(c[small[i]])
        for k in range(i, j, max(1, (1 << 18) // n)):
            own = small[k : min(j, k + max(1, (1 << 18) // n))]
            weight = s[n, 1 : n + 1] + np.arange(1, n + 1) * log_a[own, None]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (weight < (u[own] * weight[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        n, own, log_n = c[large].astype(float), a[large], np.log(c[large])
        # The tilt e^-x at which the process has n customers on average: log a + log(1 - e^-x) + (1 - d) x = log n.
        low, high = np.full(len(large), 1e-9), np.maximum(1.0, (log_n - log_a[large] + 0.5) / (1 - d))
        for _ in range(50):
            x = (low + high) / 2
            less = log_a[large] + np.log(-np.expm1(-x)) + (1 - d) * x < log_n
            low, high = np.where(less, x, low), np.where(less, high, x)
        mean = own * -np.expm1(-d * x) / d
        spread = n + n * (1 - d) * np.expm1(x)  # the customers' variance
        normal = mean + np.sqrt(np.maximum(mean - n * n / spread, 0)) * np.sqrt(-2 * np.log(np.maximum(u[large], 1e-300))) * np.cos(2 * np.pi * z[large])
        rate = np.minimum(own / d * (1 - n**-d), 4 * NORMAL_FROM)
        term = np.exp(-rate)
        total, few = term.copy(), np.ones(len(large))
        for k in range(1, int(8 * NORMAL_FROM)):
            few += u[large] > total
            term = term * rate / k
            total += term
        t[large] = np.clip(np.where(mean >= NORMAL_FROM, np.rint(normal), few), 1, n).astype(np.int64)
    return t


def _uniform(number: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by hash."""
    h = mixed(number ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


class Totals:
    """What all dishes share: tables of each restaurant (two, one and no bytes of context), customers of the first, and discounts."""

    def __init__(self, t2: np.ndarray, t1: np.ndarray, t0: float, c2: np.ndarray, discounts: tuple[float, float, float], words: int) -> None:
        self.t2, self.t1, self.t0, self.c2, self.d, self.words = t2, t1, t0, c2, discounts, words
        self.c1, self.c0 = t2.reshape(256, 256).sum(axis=1), t1.sum()

    def gammas(self, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
        rng = np.random.default_rng(seed)
        d2, d1, d0 = self.d
        return rng.gamma(STRENGTH / d2 + self.t2), rng.gamma(STRENGTH / d1 + self.t1), float(rng.gamma(STRENGTH / d0 + self.t0))

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def p0(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c - self.d[2] * t + (STRENGTH + self.d[2] * self.t0) * self.base) / (STRENGTH + self.c0)

    def p1(self, v: np.ndarray, c: np.ndarray, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (c - self.d[1] * t + (STRENGTH + self.d[1] * self.t1[v]) * p) / (STRENGTH + self.c1[v])

    def p2(self, key: np.ndarray, c: np.ndarray, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (c - self.d[0] * t + (STRENGTH + self.d[0] * self.t2[key]) * p) / (STRENGTH + self.c2[key])


class Seating:
    """Dishes of some words: contexts ``key`` (sorted within a word) with customers ``c2``, and the tables of all levels."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, key: np.ndarray, c2: np.ndarray) -> None:
        self.words, self.sizes, self.key, self.c2 = words, sizes.astype(np.int64), key.astype(np.int64), c2.astype(np.int64)
        self.row = np.repeat(np.arange(len(words)), self.sizes)
        both = self.row << 8 | self.key >> 8
        self.start1 = np.flatnonzero(np.diff(both, prepend=-1))
        self.group = np.cumsum(np.diff(both, prepend=-1) != 0) - 1
        self.row1, self.v = both[self.start1] >> 8, both[self.start1] & 255
        self.start0 = np.flatnonzero(np.diff(self.row1, prepend=-1))
        self.t2, self.t1, self.t0 = np.ones(len(key), np.int64), np.ones(len(self.v), np.int64), np.ones(len(words), np.int64)

    @property
    def c1(self) -> np.ndarray:
        return np.add.reduceat(self.t2, self.start1) if len(self.start1) else self.t2

    @property
    def c0(self) -> np.ndarray:
        return np.add.reduceat(self.t1, self.start0) if len(self.start0) else self.t1

    def sweep(self, all_: Totals, gammas: tuple, salt: int) -> None:
        """New tables for all dishes, from the contexts to the root; each dish sees its parent without its own customers."""
        g2, g1, g0 = gammas
        d2, d1, d0 = all_.d
        ids = self.words.view(np.uint64)
        number = mixed(ids[self.row] + self.key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        p0 = all_.p0(self.c0, self.t0)
        others = self.c1[self.group] - self.t2
        p1 = all_.p1(self.v[self.group], others, np.minimum(self.t1[self.group], others), p0[self.row])
        self.t2 = tables(self.c2, d2 * g2[self.key] * p1, d2, _uniform(number, 6 * salt), _uniform(number, 6 * salt + 1))
        number = mixed(ids[self.row1] + (self.v + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        c1, others = self.c1, self.c0[self.row1] - self.t1
        p0 = all_.p0(others, np.minimum(self.t0[self.row1], others))
        self.t1 = tables(c1, d1 * g1[self.v] * p0, d1, _uniform(number, 6 * salt + 2), _uniform(number, 6 * salt + 3))
        self.t0 = tables(self.c0, np.full(len(self.words), d0 * g0 * all_.base), d0, _uniform(mixed(ids), 6 * salt + 4), _uniform(mixed(ids), 6 * salt + 5))


SUMS = "level int, place int, value double"
STATE = "kind int, bucket int, words binary, sizes binary, keys binary, c binary, t2 binary, t1 binary, t0 binary, level array<int>, place array<int>, value array<double>"
_ARROW = {"int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
STATE_ARROW = pa.schema([(n, _ARROW[k]) for n, k in (f.split() for f in STATE.split(", "))])


class _Sums:
    """Sums by level and place, as one row at a task's end."""

    def __init__(self) -> None:
        self.by: dict[int, np.ndarray] = {}

    def add(self, level: int, values: np.ndarray) -> None:
        self.by[level] = self.by.get(level, 0.0) + values

    def row(self) -> dict:
        at = [(level, np.flatnonzero(values), values) for level, values in self.by.items()]
        lists = [list(chain.from_iterable(x)) for x in zip(*[([level] * len(i), i.tolist(), v[i].tolist()) for level, i, v in at])] or [[], [], []]
        return dict(kind=1, level=lists[0], place=lists[1], value=lists[2])

    def tables(self, own: Seating, sample: int) -> None:
        self.add(10 * sample + 2, np.bincount(own.key, own.t2, 65536))
        self.add(10 * sample + 1, np.bincount(own.v, own.t1, 256))
        self.add(10 * sample, np.array([float(own.t0.sum())]))


def _gathered(found: DataFrame) -> dict[int, np.ndarray]:
    """The sums of all tasks: at most 65,536 places a level."""
    rows = found.where("kind = 1").select(F.explode(F.arrays_zip("level", "place", "value")).alias("s")).select("s.*")
    out: dict[int, np.ndarray] = {}
    for level, place, value in rows.groupBy("level", "place").agg(F.sum("value")).collect():
        out.setdefault(level, np.zeros(65536))[place] = value
    return out


def _counted(scanned: DataFrame) -> DataFrame:
    """The buckets' words with their contexts and training counts, and the sums at one table a dish."""
    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = scanned.where("kind = 1").select("bucket", "words", "sizes", "keys", "n").repartition(parts, "bucket").sortWithinPartitions("bucket")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        held: list[tuple] = []
        size = 0

        def merged(w, k, n):
            order = np.lexsort((k, w, bucket(w)))
            w, k, n = w[order], k[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])])) if len(w) else np.zeros(0, int)
            return w[new], k[new], np.add.reduceat(n, new) if len(new) else n

        def compact() -> None:
            nonlocal held, size
            held = [merged(*[np.concatenate(x) for x in zip(*held)])] if held else []
            size = len(held[0][0]) if held else 0

        def flush() -> Iterator[dict]:
            nonlocal held, size
            compact()
            if not size:
                return
            w, k, n = held[0]
            start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            sizes = np.diff(np.append(start, len(w)))
            words = w[start]
            own = Seating(words.view(np.int64), sizes, k, n)
            sums.add(3, np.bincount(own.key, own.c2, 65536))
            sums.tables(own, 0)
            sums.add(4, np.array([[(x == m).sum() for m in (1, 2)] for x in (own.c2, own.c1, own.c0)], float).ravel())
            b = bucket(words)
            cuts = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:]):
                x, y = int(start[i]), int(start[j]) if j < len(start) else len(w)
                yield dict(kind=0, bucket=int(b[i]), words=words[i:j].tobytes(), sizes=sizes[i:j].astype(np.uint32).tobytes(), keys=k[x:y].tobytes(), c=n[x:y].tobytes())
            held, size = [], 0

        last, bound = None, 2 * AT_ONCE
        for batch in batches:
            for b, words, sizes, keys, n in zip(*[c.to_pylist() for c in batch.columns]):
                if b != last and size > AT_ONCE:
                    yield pa.RecordBatch.from_pylist(list(flush()), STATE_ARROW)
                    bound = 2 * AT_ONCE
                last = b
                n = np.frombuffer(n, np.uint32).astype(np.int64)
                seen = n > 0
                w = np.repeat(np.frombuffer(words, np.uint64), np.frombuffer(sizes, np.uint32))
                held.append((w[seen], np.frombuffer(keys, np.uint16)[seen], n[seen]))
                size += int(seen.sum())
                if size > bound:  # one bucket's chunks: their sum needs no more room than the bucket's pairs
                    compact()
                    bound = max(2 * AT_ONCE, 2 * size)
        yield pa.RecordBatch.from_pylist([*flush(), sums.row()], STATE_ARROW)

    return written(sent.mapInArrow(merge, STATE), "lm-counts")


def _seatings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Seating, list[int], list[int]]]:
    """Rows of ``STATE`` as seatings of about ``AT_ONCE`` pairs, with the buckets and how many words of each."""
    held: list[dict] = []
    size = 0

    def joined() -> tuple[Seating, list[int], list[int]]:
        get = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in held])
        own = Seating(get("words", np.int64), get("sizes", np.uint32), get("keys", np.uint16), get("c", np.int64))
        if held[0]["t2"] is not None:
            own.t2, own.t1, own.t0 = (get(name, np.int32).astype(np.int64) for name in ("t2", "t1", "t0"))
        return own, [r["bucket"] for r in held], [len(r["words"]) // 8 for r in held]

    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["keys"]) // 2
            if size > AT_ONCE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _rows(own: Seating, buckets: list[int], counts: list[int], tables_of: list[tuple]) -> Iterator[dict]:
    """``STATE`` rows of a seating, by bucket; ``tables_of`` are (t2, t1, t0) of each sample, kept one after the other."""
    ends = np.cumsum(counts)
    pair = np.concatenate([[0], np.cumsum(own.sizes)])
    group = np.searchsorted(own.row1, np.arange(len(own.words) + 1))
    for b, n, j in zip(buckets, counts, ends):
        i = j - n
        x, y, p, q = pair[i], pair[j], group[i], group[j]
        kept = {name: b"".join(t[k][s].astype(np.int32).tobytes() for t in tables_of) for k, (name, s) in enumerate((("t2", slice(x, y)), ("t1", slice(p, q)), ("t0", slice(i, j))))}
        yield dict(
            kind=0, bucket=b, words=own.words[i:j].tobytes(), sizes=own.sizes[i:j].astype(np.uint32).tobytes(), keys=own.key[x:y].astype(np.uint16).tobytes(), c=own.c2[x:y].tobytes(), **kept
        )


def _swept(state: DataFrame, all_: Totals, gammas: list[tuple], salts: list[int], keep: bool, name: str) -> DataFrame:
    """A sweep for each of ``salts`` over all buckets; ``keep``: the tables of each sweep, else those of the last."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for own, buckets, counts in _seatings(batches):
            kept = []
            for k, (g, salt) in enumerate(zip(gammas, salts)):
                own.sweep(all_, g, salt)
                if keep or salt == salts[-1]:
                    kept.append((own.t2, own.t1, own.t0))
                    sums.tables(own, k if keep else 0)
            yield pa.RecordBatch.from_pylist(list(_rows(own, buckets, counts, kept)), STATE_ARROW)
        yield pa.RecordBatch.from_pylist([sums.row()], STATE_ARROW)

    return written(state.where("kind = 0").mapInArrow(sweep, STATE), name)


def fit(scanned: DataFrame, burn: int = BURN, samples: int = SAMPLES) -> tuple[DataFrame, list[Totals]]:
    """The seating of all training texts: a row a bucket with the tables of each sample, and the samples' totals."""
    state = _counted(scanned)
    sums = _gathered(state)
    zero = np.zeros(65536)
    n1n2 = sums.get(4, zero)[:6].reshape(3, 2)
    discounts = tuple(float(np.clip(a / max(a + 2 * b, 1.0), 0.05, 0.95)) for a, b in n1n2)
    words, c2 = int(sums.get(0, zero)[0]), sums.get(3, zero)

    def totals(own: dict[int, np.ndarray], k: int = 0) -> Totals:
        return Totals(own.get(10 * k + 2, zero), own.get(10 * k + 1, zero)[:256], float(own.get(10 * k, zero)[0]), c2, discounts, words)

    now = totals(sums)
    for step in range(burn):
        before, state = state, _swept(state, now, [now.gammas(step)], [step], False, "lm-seating")
        discard(before)
        now = totals(_gathered(state))
    kept = _swept(state, now, [now.gammas(burn + k) for k in range(samples)], [burn + k for k in range(samples)], True, "lm-samples")
    discard(state)
    sums = _gathered(kept)
    return kept, [totals(sums, k) for k in range(samples)]


# ---- scores ---------------------------------------------------------------------------------------------------------


class Model:
    """A bucket's words with the mean predictive probability of any pair."""

    def __init__(self, row: dict, totals: list[Totals]) -> None:
        words, sizes, keys, c = (np.frombuffer(row[n], k) for n, k in (("words", np.int64), ("sizes", np.uint32), ("keys", np.uint16), ("c", np.int64)))
        own = Seating(words, sizes, keys, c)
        order = np.argsort(words.view(np.uint64), kind="stable")
        self.own, self.totals, self.order, self.sorted = own, totals, order, words.view(np.uint64)[order]
        self.count = np.bincount(own.row, own.c2, len(words)).astype(np.int64)
        self.pair_id, self.group_id = own.row << 16 | own.key, own.row1 << 8 | own.v
        self.kept = [np.frombuffer(row[n], np.int32).astype(np.int64).reshape(len(totals), -1) for n in ("t2", "t1", "t0")]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of ``words``, -1 for those that aren't known."""
        at = np.searchsorted(self.sorted, words)
        at = np.minimum(at, max(len(self.sorted) - 1, 0))
        return np.where(self.sorted[at] == words, self.order[at], -1) if len(self.sorted) else np.full(len(words), -1)

    def probability(self, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of the word at ``row`` (-1: unknown) in context ``key``."""
        own, v = self.own, key >> 8

        def seen(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(ids):
                return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            return at, (ids[at] == wanted) & (row >= 0)

        at2, in2 = seen(self.pair_id, row << 16 | key)
        at1, in1 = seen(self.group_id, row << 8 | v)
        known = row >= 0
        pick = lambda values, at, mask: np.where(mask, values[np.where(mask, at, 0)], 0) if len(values) else np.zeros(len(mask))
        total = np.zeros(len(row))
        for all_, t2, t1, t0 in zip(self.totals, *self.kept):
            own.t2, own.t1, own.t0 = t2, t1, t0
            p0 = all_.p0(pick(own.c0, row, known), pick(t0, row, known))
            p1 = all_.p1(v, pick(own.c1, at1, in1), pick(t1, at1, in1), p0)
            total += all_.p2(key, pick(own.c2, at2, in2), pick(t2, at2, in2), p1)
        return total / len(self.totals)


ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("first", pa.int32()), ("logs", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary())])
EMPTY = dict(words=b"", sizes=b"", keys=b"", c=b"", t2=b"", t1=b"", t0=b"")
ANSWER = "chunk long, first int, logs binary, counts binary, sizes binary"


def _answered(scanned: DataFrame, kept: DataFrame, totals: list[Totals]) -> DataFrame:
    """For each chunk and bucket the log10 probabilities of the chunk's pairs, and the training counts of their words."""
    parts = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = kept.where("kind = 0").select("bucket", F.lit(0).alias("turn"), *EMPTY, F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("first"))
    asked = scanned.where("kind = 1").select("bucket", F.lit(1).alias("turn"), "words", "sizes", "keys", *[F.lit(None).cast("binary").alias(c) for c in ("c", "t2", "t1", "t0")], "chunk", "first")
    both = model.unionByName(asked).repartition(parts, "bucket").sortWithinPartitions("bucket", "turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = Model(EMPTY, totals), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["turn"] == 0:
                    model, of = Model(row, totals), row["bucket"]
                    continue
                if row["bucket"] != of:
                    model, of = Model(EMPTY, totals), row["bucket"]
                place = model.find(np.frombuffer(row["words"], np.uint64))
                sizes = np.frombuffer(row["sizes"], np.uint32)
                p = model.probability(np.repeat(place, sizes), np.frombuffer(row["keys"], np.uint16).astype(np.int64))
                counts = np.where(place >= 0, model.count[np.maximum(place, 0)], 0) if len(model.count) else np.zeros(len(place), np.int64)
                out.append(dict(chunk=row["chunk"], first=row["first"], logs=np.log10(p).astype(np.float32).tobytes(), counts=counts.astype(np.uint32).tobytes(), sizes=row["sizes"]))
            yield pa.RecordBatch.from_pylist(out, ANSWER_ARROW)

    return both.mapInArrow(answer, ANSWER)


def scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", burn: int = BURN, samples: int = SAMPLES, chunk: int = CHUNK) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; texts that ``held`` marks are scored, not learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}):
        return _scored(rows, burn, samples, chunk)


def _scored(rows: DataFrame, burn: int, samples: int, chunk: int) -> DataFrame:
    scanned = _scanned(rows, chunk)
    kept, totals = fit(scanned, burn, samples)
    n, words = int(totals[0].c2.sum()), totals[0].words
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    # A chunk's answers, a row a bucket at most, go to where the chunk was written.
    answers = _answered(scanned, kept, totals).groupBy("chunk").agg(F.collect_list(F.struct("first", "logs", "counts", "sizes")).alias("answers"))
    both = scanned.where("kind = 0").select("chunk", "ids", "held", "starts", "at").join(answers.hint("shuffle_hash"), "chunk").drop("chunk")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(map(pa.RecordBatch.to_pylist, batches)):
            starts, at = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["at"], np.uint32)
            logs, counts = np.zeros(int(at.max()) + 1), np.zeros(int(at.max()) + 1, np.int64)
            for own in row["answers"]:
                found = np.frombuffer(own["logs"], np.float32)
                place = slice(own["first"], own["first"] + len(found))
                logs[place] = found
                counts[place] = np.repeat(np.frombuffer(own["counts"], np.uint32), np.frombuffer(own["sizes"], np.uint32))
            base = np.log10((counts + 1.0) / (n + words + 1.0))
            sums = [np.add.reduceat(values[at], starts[:-1]) for values in (logs, base, (counts > 0).astype(np.int64))]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(row["ids"], arrow.field("id").type), "held_out": row["held"], "n_tokens": np.diff(starts), "n_known": sums[2],
                "train_tokens": np.full(len(starts) - 1, n), "base_score": sums[1], "score": sums[0],
            }, schema=arrow)

    found = written(both.mapInArrow(add_up, schema), "lm-scores")
    discard(kept)
    return found
