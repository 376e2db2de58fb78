"""The hierarchical Pitman-Yor model over whole words: a word is drawn in the restaurant of the word before it.

Restaurants.  There is one for each word that is followed by another (``END`` before a text's first), without a bound on their number.  All
share the root, whose base is uniform over the words learned and one more, which stands for all others.  A customer at a new table is a
customer of the root.  Tables, discounts and draws are those of ``pitman_yor``: given an auxiliary gamma variable of each restaurant, dishes are
independent.

Gibbs.  Dishes (a word in a context) lie in buckets by their word, so a word's root dish is beside them.  Dishes of one customer have
one table and never move.  For the others a bucket asks for the gammas of their contexts: it tells the room of the context by how many customers exceed
tables; the room, which knows how often each of its words occurs, adds these up, draws the gammas and sends them back.  The tables of all
restaurants thus follow every sweep, and no task needs the vocabulary.  ``BURN`` sweeps are dropped, ``SAMPLES`` are kept.

Scores.  Chunks of texts send their pairs to the buckets of the words once, beside the chunks themselves.  A bucket keeps of them
where they lie among its dishes, as gaps between places, and of the dishes' contexts only what sweeps need.  It answers each chunk with counts: customers and tables of
each pair, and of each word its customers and tables at the root and the tables of its restaurant, by sample; the chunk makes probabilities of them.
Numbers travel as compressed planes, since what is on disk at once is what bounds the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, delete, discard, scratch, settings
from .pitman_yor import AT_ONCE, BATCH, BURN, SAMPLES, STRENGTH, _tokens, _uniform, tables
from .wordscan import groups, mixed

#: Code points of a chunk.
CHUNK = 8 << 20
#: Contexts are known by this many bits of their word's hash; the first of them name a word's bucket and a context's room.
BITS, BUCKET_BITS, ROOM_BITS = 40, 9, 6
MASK = np.uint64(2**BITS - 1)
#: Kinds of rows, in the order in which a task meets them.
CHUNKS, ASKED, DISHES, KNOWN, SEATS, KEPT, ROOMS, EXCESS, GAMMAS, SUMS, PLACES, ANSWERS = range(12)
#: Chunks go to buckets of their own, below zero: ``-1 - chunk``.
ROW = "kind int, bucket long, origin int, chunk long, first int, pair int, words binary, sizes binary, keys binary, n binary, t binary, t0 binary, ones binary, value array<double>"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
ROW_ARROW = pa.schema([(n, _ARROW[k]) for n, k in (f.split() for f in ROW.split(", "))])


def bucket(words: np.ndarray) -> np.ndarray:
    return ((words & MASK) >> np.uint64(BITS - BUCKET_BITS)).astype(np.int64)


def room(words: np.ndarray) -> np.ndarray:
    return ((words & MASK) >> np.uint64(BITS - ROOM_BITS)).astype(np.int64)


def turned(words: np.ndarray) -> np.ndarray:
    """Words with the bits by which they are contexts in front: words in this order are in that of their buckets and of their keys."""
    return words << np.uint64(64 - BITS) | words >> np.uint64(BITS)


def turned_back(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - BITS) | words << np.uint64(BITS)


def packed(numbers: np.ndarray, kind: type, width: int | None = None) -> bytes:
    """Numbers as planes of their first, second ... bytes, which compress better than the numbers."""
    data = np.ascontiguousarray(numbers, kind)
    return np.ascontiguousarray(data.view(np.uint8).reshape(-1, data.itemsize)[:, :width].T).tobytes()


def unpacked(data: bytes, kind: type, width: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((len(data) // (width or size), size), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width or size, -1).T
    return out.reshape(-1).view(kind)


def shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def gaps(places: np.ndarray, known: np.ndarray) -> bytes:
    """Ascending ``places``, where ``known``, as one more than the steps from the one before (two contexts of one key have one place); 0 is not known."""
    out = np.zeros(len(places), np.int64)
    out[known] = np.diff(places[known], prepend=0) + 1
    return shrunk(packed(out, np.int64))


def from_gaps(data: bytes) -> np.ndarray:
    """Places as ``gaps`` took them; -1 for those that aren't known."""
    steps = unpacked(grown(data), np.int64)
    return np.where(steps > 0, np.cumsum(np.maximum(steps - 1, 0)), -1)


def _keys(data: bytes) -> np.ndarray:
    return unpacked(data, np.uint64, BITS // 8)


def _packed_keys(keys: np.ndarray) -> bytes:
    return packed(keys, np.uint64, BITS // 8)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ROW_ARROW)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Each bucket with its rows one after the other; rows must be sorted by bucket."""
    yield from groupby(chain.from_iterable(map(pa.RecordBatch.to_pylist, batches)), key=lambda r: r["bucket"])


def _dealt(*parts: DataFrame) -> DataFrame:
    """Rows of all tables by bucket, in the order of their kinds."""
    rows = parts[0]
    for own in parts[1:]:
        rows = rows.unionByName(own, allowMissingColumns=True)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "origin", "first", "chunk")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared folder, kinds apart, so that none is read with another."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    found.scratch_path = path
    _let_go(df.sparkSession)
    return found


def _let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of tables that nobody holds when the driver's JVM collects garbage, which it may not do for long."""
    spark.sparkContext._jvm.System.gc()


def _sums(df: DataFrame) -> np.ndarray:
    """The totals of all tasks: a few numbers each."""
    rows = df.where(F.col("kind") == SUMS).select(F.posexplode("value").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    _let_go(df.sparkSession)
    out = np.zeros(8)
    for r in rows:
        out[r["at"]] = r["x"]
    return out


# ---- texts -----------------------------------------------------------------------------------------------------------


def _coded(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word << 32 | word before) of tokens by their places, and which of these each token is."""
    before = np.concatenate([[0], place[:-1]])  # before a text's first word comes the end of another, whose hash is the least
    return np.unique(place << 32 | before, return_inverse=True)


def _scanned(docs: DataFrame, chunk: int) -> DataFrame:
    """Chunks (their rows and the place of each token among the chunk's words) and what they send to the buckets (words, pairs, training counts)."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"{ROW}, ids array<{kind}>, held array<boolean>, starts binary, at binary"
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in groups(batches, "text", chunk):
            words, _, starts = _tokens([text for _, text in rows])
            ids, held = ([key[k] for key, _ in rows] for k in (0, 1))
            train = ~np.repeat(np.array(held, bool), np.diff(starts))
            known, code = np.unique(turned(words), return_inverse=True)
            sent, known = known, turned_back(known)
            pairs, at = _coded(code)
            n = np.bincount(at[train], minlength=len(pairs))
            keys, sizes = known[pairs & 0xFFFFFFFF] & MASK, np.bincount(pairs >> 32, minlength=len(known))
            yield pa.RecordBatch.from_pylist([dict(
                kind=CHUNKS, bucket=-1 - number, chunk=number, ids=ids, held=held, starts=shrunk(packed(starts, np.int64)), at=shrunk(packed(code, np.uint32)),
            )], arrow)
            own, limits = bucket(known), np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                i, j = int(limits[a]), int(limits[b])
                out.append(dict(
                    kind=ASKED, chunk=number, bucket=int(own[a]), first=int(a), pair=i, words=shrunk(packed(sent[a:b], np.uint64)), sizes=shrunk(packed(sizes[a:b], np.uint32)),
                    keys=shrunk(_packed_keys(keys[i:j])), n=shrunk(packed(n[i:j], np.uint32)),
                ))
            yield pa.RecordBatch.from_pylist(out, arrow)
            number += 1

    return docs.mapInArrow(scan, schema)


# ---- seating ---------------------------------------------------------------------------------------------------------


def _told(b: int, keys: np.ndarray, more: np.ndarray) -> Iterator[dict]:
    """For each room the contexts of a bucket's dishes of several customers, in order, with their customers beyond tables."""
    contexts, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, more, len(contexts))
    rooms = room(contexts)
    cuts = np.flatnonzero(np.diff(rooms, prepend=-1, append=-1))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield dict(kind=EXCESS, bucket=int(rooms[i]), origin=b, keys=_packed_keys(contexts[i:j]), n=packed(total[i:j], np.int64))


def _added(words: np.ndarray, row: np.ndarray, t: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Root customers of each word: the tables of its dishes, those of one customer too."""
    return ones + np.bincount(row, t, len(words)).astype(np.int64)


def _counted(scanned: DataFrame, lookup: bool) -> DataFrame:
    """Chunks as they are; all dishes with their customers; where the pairs of each chunk lie among these; the words with their counts, by room; and the
    first seating, at one table a dish.  ``lookup``: dishes keep their words and contexts."""
    arrow = scanned.sparkSession.createDataFrame([], scanned.schema).toArrow().schema

    def summed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
        return ids[new], np.add.reduceat(n, new) if len(new) else n

    def taught(r: dict) -> np.ndarray:
        """Words of a row, turned, that occur in training texts."""
        sizes = unpacked(grown(r["sizes"]), np.uint32)
        n = np.add.reduceat(unpacked(grown(r["n"]), np.uint32), np.cumsum(sizes, dtype=np.int64) - sizes)  # each word has a pair
        return unpacked(grown(r["words"]), np.uint64)[n > 0]

    def found(r: dict, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of a row's words among ``words``, turned, whether they are there, and the same of its pairs, a number each: the word's place, then the context."""
        w = unpacked(grown(r["words"]), np.uint64)
        at = np.searchsorted(words, w)
        there = words[np.minimum(at, len(words) - 1)] == w
        sizes = unpacked(grown(r["sizes"]), np.uint32)
        return at, there, np.repeat(at.astype(np.uint64) << np.uint64(BITS), sizes) | _keys(grown(r["keys"])), np.repeat(there, sizes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(8)
        for b, rows in _rows(batches):
            if b < 0:
                yield pa.RecordBatch.from_pylist(list(rows), arrow)
                continue
            rows = list(rows)
            words = np.unique(np.concatenate([taught(r) for r in rows]))
            if not len(words):
                none = lambda size: gaps(np.zeros(size, np.int64), np.zeros(size, bool))
                sizes = [unpacked(grown(r["sizes"]), np.uint32) for r in rows]
                yield pa.RecordBatch.from_pylist([
                    dict(kind=PLACES, bucket=b, chunk=r["chunk"], first=r["first"], pair=r["pair"], words=none(len(n)), keys=none(int(n.sum()))) for r, n in zip(rows, sizes)
                ], arrow)
                continue
            held, size, bound = [], 0, 2 * AT_ONCE
            for r in rows:
                ids, n = found(r, words)[2], unpacked(grown(r["n"]), np.uint32).astype(np.int64)
                seen = n > 0
                held.append((ids[seen], n[seen]))
                size += len(held[-1][0])
                if size > bound:  # the sum needs no more room than the bucket's pairs
                    held = [summed(*[np.concatenate(x) for x in zip(*held)])]
                    size = len(held[0][0])
                    bound = max(2 * AT_ONCE, 2 * size)
            ids, n = summed(*[np.concatenate(x) for x in zip(*held)])
            known, words = words, turned_back(words)
            row, k = (ids >> np.uint64(BITS)).astype(np.int64), ids & MASK
            count, dishes = np.bincount(row, n, len(words)).astype(np.int64), np.bincount(row, minlength=len(words))
            live = n > 1
            ones = np.bincount(row[~live], minlength=len(words))
            sums += [len(words), n.sum(), len(ids), len(words), *[(x == m).sum() for x in (n, dishes) for m in (1, 2)]]
            yield pa.RecordBatch.from_pylist([
                dict(
                    kind=DISHES, bucket=b, sizes=packed(dishes, np.uint32), n=packed(n, np.int64),
                    **(dict(words=words.tobytes(), keys=_packed_keys(k)) if lookup else {}),
                ),
                dict(kind=KNOWN, bucket=b >> (BUCKET_BITS - ROOM_BITS), origin=b, words=words.tobytes(), n=packed(count, np.int64)),
                dict(
                    kind=SEATS, bucket=b, words=words.tobytes(), sizes=packed(np.bincount(row[live], minlength=len(words)), np.uint32), keys=_packed_keys(k[live]),
                    n=packed(n[live], np.int64), t=packed(np.ones(live.sum()), np.int64), t0=packed(np.ones(len(words)), np.int64), ones=packed(ones, np.int64),
                ),
                *_told(b, k[live], n[live] - 1),
            ], arrow)
            out, size = [], 0
            for r in rows:
                at, there, asked, near = found(r, known)
                place = np.searchsorted(ids, asked)
                near &= ids[np.minimum(place, len(ids) - 1)] == asked
                out.append(dict(kind=PLACES, bucket=b, chunk=r["chunk"], first=r["first"], pair=r["pair"], words=gaps(at, there), keys=gaps(place, near)))
                size += len(asked)
                if size > AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, arrow)
        yield pa.RecordBatch.from_pylist([dict(kind=SUMS, value=sums.tolist())], arrow)

    with settings(scanned.sparkSession, SMALL_BATCHES):
        return _written(_dealt(scanned).mapInArrow(merge, scanned.schema), "lm-dishes")


def _of(df: DataFrame, kind: int) -> DataFrame:
    return df.where(F.col("kind") == kind).select(*ROW_ARROW.names)


def _drawn(counted: DataFrame, seated: DataFrame, step: int, discount: float) -> DataFrame:
    """Rooms add up the tables of their restaurants and draw the gammas that each bucket has asked for."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _rows(batches):
            known, told = [], []
            for r in rows:
                (known if r["kind"] == KNOWN else told).append(r)
            known.sort(key=lambda r: r["origin"])
            words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in known]) & MASK
            count = np.concatenate([unpacked(r["n"], np.int64) for r in known])
            ends = np.cumsum([len(r["words"]) // 8 for r in known])[:-1]
            contexts, of = np.unique(words, return_inverse=True)  # words of one hash share a restaurant, its customers and its tables
            customers = np.bincount(of, count, len(contexts)).astype(np.int64)
            t = customers.copy()
            keys, more = [_keys(r["keys"]) for r in told], [unpacked(r["n"], np.int64) for r in told]
            if told:  # the contexts of all rows at once: there is one row for each bucket
                at = np.searchsorted(contexts, np.concatenate(keys))
                np.subtract.at(t, at, np.concatenate(more))
            gamma = np.random.default_rng([step, b]).gamma(STRENGTH / discount + t)
            both = zip(known, np.split(t[of], ends), np.split(customers[of] - count, ends))
            yield _batch([dict(kind=ROOMS, bucket=r["origin"], origin=step, t=packed(own, np.int64), n=packed(others, np.int64)) for r, own, others in both])
            if told:
                own = np.split(gamma[at].astype(np.float32), np.cumsum([len(x) for x in keys])[:-1])
                yield _batch([dict(kind=GAMMAS, bucket=r["origin"], origin=b, t=packed(x, np.float32)) for r, x in zip(told, own)])

    return _dealt(_of(counted, KNOWN), _of(seated, EXCESS)).mapInArrow(draw, ROW)


def _root(words: int, discount: float, c: float, t: float, own_c: np.ndarray, own_t: np.ndarray) -> np.ndarray:
    """The root's probability of words with ``own_c`` customers at ``own_t`` tables."""
    return (own_c - discount * own_t + (STRENGTH + discount * t) / (words + 1)) / (STRENGTH + c)


def _swept(seated: DataFrame, gammas: DataFrame, step: int, discounts: tuple[float, float], words: int, totals: tuple[float, float], gamma: float, keep: bool) -> DataFrame:
    """New tables for all dishes, then for the root; a dish sees the root without its own customers.  ``keep``: the tables alone once more."""
    d1, d0 = discounts

    def drawn(held: list[list[dict]], sums: np.ndarray) -> Iterator[dict]:
        """The rows of several buckets swept at once."""
        seats = [rows[0] for rows in held]
        parts = [[np.frombuffer(r["words"], np.uint64), _keys(r["keys"]), unpacked(r["sizes"], np.uint32), *[unpacked(r[n], np.int64) for n in ("n", "t0", "ones", "t")]] for r in seats]
        ids, keys, sizes, c, t0, ones, t = (np.concatenate(x) for x in zip(*parts))
        row = np.repeat(np.arange(len(ids)), sizes)
        if len(keys):
            g = np.concatenate([
                np.concatenate([unpacked(x["t"], np.float32) for x in sorted(rows[1:], key=lambda x: x["origin"])]).astype(float)[np.unique(own[1], return_inverse=True)[1]]
                for rows, own in zip(held, parts) if len(own[1])
            ])
            others = _added(ids, row, t, ones)[row] - t
            p = _root(words, d0, *totals, others, np.minimum(t0[row], others))
            number = mixed(ids[row] + keys * np.uint64(0x9E3779B97F4A7C15))
            t = tables(c, d1 * g * p, d1, _uniform(number, 6 * step), _uniform(number, 6 * step + 1))
        c0 = _added(ids, row, t, ones)
        t0 = tables(c0, np.full(len(ids), d0 * gamma / (words + 1)), d0, _uniform(mixed(ids), 6 * step + 4), _uniform(mixed(ids), 6 * step + 5))
        sums[2:4] += c0.sum(), t0.sum()
        word, dish = (np.cumsum([len(own[k]) for own in parts])[:-1] for k in (0, 1))
        for r, own, own_t, own_t0 in zip(seats, parts, np.split(t, dish), np.split(t0, word)):
            new = dict(bucket=r["bucket"], origin=step, t=packed(own_t, np.int64), t0=packed(own_t0, np.int64), ones=r["ones"])
            yield dict(kind=SEATS, words=r["words"], sizes=r["sizes"], keys=r["keys"], n=r["n"], **new)
            if keep:
                yield dict(kind=KEPT, **new)
            yield from _told(r["bucket"], own[1], own[3] - own_t)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros(8), [], 0
        for _, rows in _rows(batches):
            held.append(list(rows))
            size += len(held[-1][0]["words"]) + len(held[-1][0]["keys"])
            if size > 8 * AT_ONCE:
                yield _batch(list(drawn(held, sums)))
                held, size = [], 0
        if held:
            yield _batch(list(drawn(held, sums)))
        yield _batch([dict(kind=SUMS, value=sums.tolist())])

    return _written(_dealt(_of(seated, SEATS), _of(gammas, GAMMAS)).mapInArrow(sweep, ROW), "lm-seats")


class Fitted:
    """The tables of a fit: dishes, kept seatings, and the numbers that all share; the root's totals are (customers, tables) by sample."""

    def __init__(self, counted: DataFrame, words: int, tokens: int, discounts: tuple[float, float]) -> None:
        self.counted, self.words, self.tokens, self.discounts = counted, words, tokens, discounts
        self.kept: list[tuple[int, DataFrame, tuple[float, float]]] = []

    def shared(self) -> dict:
        return dict(discounts=self.discounts, words=self.words, totals=[(step, totals) for step, _, totals in self.kept])

    def rows(self) -> DataFrame:
        """Dishes, and of each sample the seats and the restaurants' tables."""
        out = _of(self.counted, DISHES)
        for step, seated, _ in self.kept:
            out = out.unionByName(_of(seated, KEPT)).unionByName(_of(_drawn(self.counted, seated, step, self.discounts[0]), ROOMS))
        return out


def fit(scanned: DataFrame, burn: int = BURN, samples: int = SAMPLES, lookup: bool = True) -> Fitted:
    """The model of what was scanned.  ``lookup``: it can be asked for any word and context; else for the places of the scanned texts only."""
    counted = _counted(scanned, lookup)
    sums = _sums(counted)
    discounts = tuple(float(np.clip(a / max(a + 2 * b, 1.0), 0.05, 0.95)) for a, b in (sums[4:6], sums[6:8]))
    found = Fitted(counted, int(sums[0]), int(sums[1]), discounts)
    seated, totals = counted, (sums[2], sums[3])
    for step in range(burn + samples):
        gamma = float(np.random.default_rng([step, 1 << ROOM_BITS]).gamma(STRENGTH / discounts[1] + totals[1]))
        # Draws of rooms are numbered by the seating they follow, so that they are the same when they are made again.
        gammas = _drawn(counted, seated, step - 1 if step else burn + samples, discounts[0])
        before, seated = seated, _swept(seated, gammas, step, discounts, found.words, totals, gamma, step >= burn)
        if 0 < step <= burn:
            discard(before)
        else:
            delete(before.sparkSession, *[f"{before.scratch_path}/kind={kind}" for kind in ((SEATS,) if step else (SEATS, EXCESS))])
        totals = tuple(_sums(seated)[2:4])
        if step >= burn:
            found.kept.append((step, seated, totals))
    if burn + samples:
        delete(seated.sparkSession, f"{seated.scratch_path}/kind={SEATS}")
    return found


# ---- scores ----------------------------------------------------------------------------------------------------------


def valued(fitted: dict, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(customers of the words' restaurants, root probabilities and restaurants' weights by sample, shares of the pairs' own customers) of numbers as
    ``Model`` has them."""
    d1, d0 = fitted["discounts"]
    steps = len(fitted["totals"])
    customers, own_c, own_t, restaurants = words[0] + words[1], *words[2:].reshape(3, steps, -1)
    root = np.array([_root(fitted["words"], d0, c0, t0, own_c[k], own_t[k]) for k, (_, (c0, t0)) in enumerate(fitted["totals"])])
    return customers, root, (STRENGTH + d1 * restaurants) / (STRENGTH + customers), pairs[0] - d1 * pairs[1] / steps


class Model:
    """A bucket's words: counts, what words of the same hash add to their restaurants' customers, and by sample customers and tables at the root and tables of their restaurants; its pairs: customers, and tables of all samples.
    The last place is that of unknown ones."""

    def __init__(self, rows: list[dict], fitted: dict) -> None:
        self.fitted = fitted
        by = {(r["kind"], r["origin"]): r for r in rows}
        dishes, steps = by.get((DISHES, None)), [step for step, _ in fitted["totals"]]
        sizes, c = (unpacked(dishes["sizes"], np.uint32), unpacked(dishes["n"], np.int64)) if dishes else np.zeros((2, 0), np.int64)
        m, live = len(sizes), c > 1
        row = np.repeat(np.arange(m), sizes)
        self.word_numbers, self.pair_numbers = np.zeros((2 + 3 * len(steps), m + 1), np.int64), np.zeros((2, len(c) + 1), np.int64)
        own_c, own_t, restaurants = self.word_numbers[2:].reshape(3, len(steps), -1)
        self.word_numbers[0, :-1] = np.bincount(row, c, m)
        self.pair_numbers[0, :-1] = c
        t_sum = self.pair_numbers[1, :-1]
        t_sum[~live] = len(steps)  # the one table of one customer
        for k, step in enumerate(steps if dishes else []):
            seats, rooms = by[KEPT, step], by[ROOMS, step]
            t = unpacked(seats["t"], np.int64)
            t_sum[live] += t
            own_c[k, :-1] = _added(sizes, row[live], t, unpacked(seats["ones"], np.int64))
            self.word_numbers[1, :-1] = unpacked(rooms["n"], np.int64)
            own_t[k, :-1], restaurants[k, :-1] = unpacked(seats["t0"], np.int64), unpacked(rooms["t"], np.int64)
        named = dishes and dishes["words"] is not None
        self.words = np.frombuffer(dishes["words"], np.uint64) if named else np.zeros(0, np.uint64)
        self.pairs = self._ids(row, _keys(dishes["keys"])) if named else np.zeros(0, np.uint64)

    @staticmethod
    def _ids(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return places.astype(np.uint64) << np.uint64(BITS) | keys

    @staticmethod
    def _at(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Places of ``asked``, the one past the last for those that aren't known."""
        if not len(known):
            return np.zeros(len(asked), int)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, at, len(known))

    def answers(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``valued`` tells, of any words and contexts, if the fit can be asked for these."""
        at = self._at(turned(self.words), turned(words))
        pairs = self._at(self.pairs, self._ids(np.repeat(at, sizes), keys))
        return valued(self.fitted, self.word_numbers[:, at], self.pair_numbers[:, pairs])


def probabilities(pairs: np.ndarray, customers: np.ndarray, root: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Mean predictive probability of each of ``pairs`` (word << 32 | word before), from what was answered."""
    word, before = pairs >> 32, pairs & 0xFFFFFFFF
    p = share / (STRENGTH + customers[before])
    for k in range(len(root)):
        p += weight[k, before] * root[k, word] / len(root)
    return p


def _answered(found: Fitted) -> DataFrame:
    """For each chunk and bucket the numbers that the chunk's words and pairs have in the model."""
    fitted = found.shared()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _rows(batches):
            own, model, out, size = [], None, [], 0
            for r in rows:
                if r["kind"] != PLACES:
                    own.append(r)
                    continue
                if model is None:
                    model, own = Model(own, fitted), []
                words, pairs = model.word_numbers[:, from_gaps(r["words"])], model.pair_numbers[:, from_gaps(r["keys"])]
                out.append(dict(
                    kind=ANSWERS, bucket=-1 - r["chunk"], first=r["first"], pair=r["pair"], words=shrunk(packed(words.reshape(-1), np.int64)), keys=shrunk(packed(pairs.reshape(-1), np.int64)),
                ))
                size += pairs.shape[1]
                if size > AT_ONCE:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return _dealt(found.rows(), _of(found.counted, PLACES)).mapInArrow(answer, ROW)


def scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", burn: int = BURN, samples: int = SAMPLES, chunk: int = CHUNK) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; texts that ``held`` marks are scored, not learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}):
        return _scored(rows, burn, samples, chunk)


def _scored(rows: DataFrame, burn: int, samples: int, chunk: int) -> DataFrame:
    found = fit(_scanned(rows, chunk), burn, samples, lookup=False)
    n, words, fitted = found.tokens, found.words, found.shared()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _rows(batches):  # a chunk, then its answers, a row a bucket at most
            row = next(own)
            starts, code = unpacked(grown(row["starts"]), np.int64), unpacked(grown(row["at"]), np.uint32).astype(np.int64)
            pairs, at = _coded(code)
            of_words, of_pairs = np.zeros((2 + 3 * samples, int(code.max()) + 1), np.int64), np.zeros((2, len(pairs)), np.int64)
            for r in own:
                for numbers, first, data in ((of_words, r["first"], r["words"]), (of_pairs, r["pair"], r["keys"])):
                    found = unpacked(grown(data), np.int64).reshape(len(numbers), -1)
                    numbers[:, first : first + found.shape[1]] = found
            customers, root, weight, share = valued(fitted, of_words, of_pairs)
            count = of_words[0]
            logs = np.log10(probabilities(pairs, customers, root, weight, share))
            base = np.log10((count + 1.0) / (n + words + 1.0))
            sums = [np.add.reduceat(values, starts[:-1]) for values in (logs[at], base[code], (count > 0).astype(np.int64)[code])]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(row["ids"], arrow.field("id").type), "held_out": row["held"], "n_tokens": np.diff(starts), "n_known": sums[2],
                "train_tokens": np.full(len(starts) - 1, n), "base_score": sums[1], "score": sums[0],
            }, schema=arrow)

    path = scratch(rows.sparkSession, "lm-scores")
    chunks = found.counted.where(F.col("kind") == CHUNKS)
    _dealt(chunks, _answered(found)).mapInArrow(add_up, schema).write.parquet(path)
    discard(found.counted, *[seated for _, seated, _ in found.kept])
    return rows.sparkSession.read.schema(schema).parquet(path)
