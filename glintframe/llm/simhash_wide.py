"""Near copies by word-shingle similarity, pruned by pigeonring filtering over long SimHash fingerprints.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in about 15 % of their
fingerprint's bits, far more than 3 of 64.  No segment of a fingerprint that is long enough to tell
texts of a large corpus apart stays equal then (a 32-bit segment does in 0.5 % of pairs), so segments can't
be the join key.  Candidates are texts that share a band: six minimal hashes of their shingles, of 24
such bands.  Pairs of similarity 0.8 share one with probability 0.999, and texts without
common shingles share none, however large the corpus.

A candidate then needs a fingerprint within reach.  It has 2048 bits in 64 segments on a ring: a pair
stays if some chain of segments keeps within its proportional budgets (pigeonring
principle) and the whole distance is small enough.  What is left is compared exactly, shingle
set against shingle set.  The features behind the bits are the same distinct shingles, summed
into 2048 signed counters; a randomised Hadamard transform makes the bits from these.

In a band's group each text is first paired with two others alone, the first and the last in an order of the band's
own, so the pairs grow with the group.  Verified pairs are closed to components.  A group that then still
holds several components has pairs that nobody compared: its texts go through an exact prefix-filter join,
which finds every link between different components (two texts of ``similarity`` share one of their rarest shingles).

Rows are told apart by their place.  Defined cases: identical rows are near copies of each other; null and
wordless texts are never near copies; texts shorter than a shingle have one, of all their words;
of a component the row with the least id stays (a null id is the greatest); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, written
from .components import components
from .placed import Placed, place
from .simhash import _words

BITS, SEGMENTS, CHAIN = 2048, 64, 8
BANDS, ROWS = 24, 6
#: Shingles hashed at a time.
BLOCK = 1 << 12
#: Most differing bits of a candidate.  Shingle sets of similarity 0.8 have a cosine of 8/9 at least (sets of one size), so 310
#: differing bits in the mean; with deviations of 16 (bits) and 7 (counters shared by shingles) 410 is five deviations off.
DISTANCE = 410
#: Texts of fewer shingles have fingerprints too coarse for that (4 of 5 shingles: 384 in the mean, 768 at times); all their pairs are compared.
SMALL = 32
MEMO = 1 << 16
#: Texts with a shingle in common that one task of the prefix join takes.
SALT = 2048
_odd = np.uint64(0x9E3779B97F4A7C15)
_xors, _factors = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_factors |= np.uint64(1)
_signs = np.random.default_rng(2048).choice(np.array([-1.0, 1.0], np.float32), BITS)


class _WordHash(dict):
    """Hashes of words, with a bounded memory of those seen."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _hashes(text: str, known: _WordHash) -> np.ndarray:
    words = _words(text.translate(ASCII_LOWER))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, or of all if there are fewer; sorted and distinct."""
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * _odd
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _transform(counters: np.ndarray) -> np.ndarray:
    """Hadamard transform of each row."""
    h = 1
    while h < counters.shape[1]:
        pairs = counters.reshape(len(counters), -1, 2, h)
        counters = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(counters), -1)
        h *= 2
    return counters


def _bits(features: list[np.ndarray]) -> np.ndarray:
    """Segments (int32) of each document's fingerprint."""
    counters = np.zeros((len(features), BITS), np.float32)
    for row, own in zip(counters, features):
        sign = (own >> np.uint64(40) & np.uint64(1)).astype(np.float32) * 2 - 1
        row += np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), sign, BITS).astype(np.float32)
    bits = _transform(counters * _signs) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i4")


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band's minimal hashes, and of its place."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, ((shingles[at : at + BLOCK] ^ _xors) * _factors).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for own in least.reshape(BANDS, ROWS).T:
        out = (out ^ own) * _odd
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(docs: DataFrame, *, uid: str, text_col: str = "text", width: int = 5, block: int = 256) -> DataFrame:
    """(uid, segments, bands, small) of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                features, bands, rows = [], [], []
                for row, text in enumerate(part.column(1)):
                    hashes = _hashes(text.as_py() or "", known)
                    if len(hashes):
                        shingles = _runs(hashes, width)
                        features.append(shingles)
                        bands.append(_bands(shingles))
                        rows.append(row)
                if rows:
                    lists = [
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                        for x in (_bits(features), np.stack(bands))
                    ]
                    small = pa.array([len(f) < SMALL for f in features])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *lists, small], ["uid", "segments", "bands", "small"])

    return docs.select(F.col(uid).alias("uid"), F.col(text_col).cast("string")).mapInArrow(run, "uid long, segments array<int>, bands array<long>, small boolean")


def candidates(sketched: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that share a band, each text with the first and the last of its group: the first pass."""
    keys = sketched.select("uid", F.explode("bands").alias("key"))
    placed = F.struct(F.xxhash64("uid", "key").alias("place"), F.col("uid").alias("uid"))
    buckets = keys.groupBy("key").agg(F.min(placed).alias("low"), F.max(placed).alias("high")).where("low < high")
    buckets = buckets.select("key", F.col("low.uid").alias("low"), F.col("high.uid").alias("high"))
    met = keys.join(buckets.withColumnRenamed("key", "bucket"), F.col("key") == F.col("bucket"))
    pairs = met.select("uid", F.explode(F.array("low", "high")).alias("other")).where("uid <> other")
    return pairs.select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct()


def within(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE, chain: int = CHAIN) -> np.ndarray:
    """Which rows of segments are within ``distance``: the chains first, the whole distance of those that pass."""
    apart = np.bitwise_count(left ^ right).astype(np.int32)
    ring = np.cumsum(np.concatenate([np.zeros((len(apart), 1), np.int32), apart, apart[:, :chain]], axis=1), axis=1)
    starts = np.ones(apart.shape, bool)
    for n in range(1, chain + 1):
        starts &= ring[:, n : n + SEGMENTS] - ring[:, :SEGMENTS] <= distance * n // SEGMENTS
    near = starts.any(axis=1)
    near[near] = apart[near].sum(axis=1) <= distance
    return near


def pruned(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    left = sketched.select(F.col("uid").alias("a"), F.col("segments").alias("left"), "small")
    right = sketched.select(F.col("uid").alias("b"), F.col("segments").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [np.asarray(batch.column(i).flatten(), np.int32).view(np.uint32).reshape(-1, SEGMENTS) for i in (2, 3)]
                small = batch.column(4).to_numpy(zero_copy_only=False)
                yield batch.select([0, 1]).filter(pa.array(within(*sides) | small))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right", "small").mapInArrow(run, "a long, b long")


def shingle_sets(placed: Placed, wanted: DataFrame, *, text_col: str, width: int) -> DataFrame:
    """(uid, shingles) of the texts in ``wanted`` (uid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                shingles = _runs(_hashes(text.as_py(), known), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([shingles], pa.list_(pa.int64()))], ["uid", "shingles"])

    rows = placed.only(wanted).select(F.col(placed.row).alias("uid"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "uid long, shingles array<long>")


def unsettled(sketched: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, root) of the texts in a band's group of several components; in a group of three all pairs were candidates."""
    roots = found.select(F.col("node").alias("uid"), "root")
    rooted = sketched.select("uid", "bands").join(roots, "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"), F.explode("bands").alias("key"))
    mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 3 and low < high")
    return rooted.join(mixed.select("key"), "key", "left_semi").select("uid", "root").distinct()


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of rows (uid, root, shingles) with different roots that may reach ``similarity``; none that do are left out.

    In an order common to all texts, rarest first, the first shingle that a pair has in common is among
    the first of both, so early that what follows it can make up the overlap.
    """
    each = sets.select("uid", "root", F.explode("shingles").alias("shingle"))
    known = each.groupBy("shingle").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed"))
    order = F.sort_array(F.collect_list(F.struct("n", "shingle", "mixed")))
    ranked = each.join(known, "shingle").groupBy("uid", "root").agg(order.alias("order")).withColumn("size", F.size("order"))

    def least(share: float, size: str) -> Column:
        return F.ceil(share * F.col(size) - 1e-9).cast("int")

    placed = ranked.select("uid", "root", "size", F.posexplode(F.slice("order", 1, F.col("size") - least(similarity, "size") + 1)).alias("at", "s"))
    placed = placed.where("s.mixed").select("uid", "root", "size", "at", "s.shingle", F.ceil(F.col("s.n") / SALT).cast("int").alias("salts"))
    # The shorter text of a pair shares more of itself: its part of the order is the lesser one.
    short = placed.where(F.col("at") <= F.col("size") - least(2 * similarity / (1 + similarity), "size"))
    short = short.select(*[F.col(c).alias(f"x_{c}") for c in ("uid", "root", "size", "at")], "shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    long = placed.select(*[F.col(c).alias(f"y_{c}") for c in ("uid", "root", "size", "at")], "shingle", F.pmod(F.hash("uid"), "salts").alias("salt"))
    ordered = F.struct("x_size", "x_uid") < F.struct(F.col("y_size").alias("x_size"), F.col("y_uid").alias("x_uid"))
    room = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")) >= similarity / (1 + similarity) * (F.col("x_size") + F.col("y_size")) - 1e-9
    met = short.join(long, ["shingle", "salt"]).where(ordered & (F.col("x_root") != F.col("y_root")) & room)
    return met.select(F.least("x_uid", "y_uid").alias("a"), F.greatest("x_uid", "y_uid").alias("b")).distinct()


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have ``similarity`` or more."""
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("left")), "a")
    both = both.join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("right")), "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.where(common >= similarity * (F.size("left") + F.size("right") - common)).select("a", "b")


def near_copies(placed: Placed, *, text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(uid, root): the place of every row that is a near copy, with that of the row that names its component; links are pairs of ``similarity`` or more."""
    sketched = written(sketches(placed.df, uid=placed.row, text_col=text_col, width=width), "wide-sketches")
    met = written(candidates(sketched), "wide-candidates")
    near = written(pruned(met, sketched), "wide-near")
    discard(met)
    wanted = near.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = written(shingle_sets(placed, wanted, text_col=text_col, width=width), "wide-sets")
    links = written(linked(near, sets, similarity), "wide-links")
    discard(sets, near)
    found = components(links)
    rest = written(unsettled(sketched, found), "wide-rest")
    discard(sketched)
    if not rest.isEmpty():
        sets = shingle_sets(placed, rest.select("uid"), text_col=text_col, width=width)
        sets = written(sets.join(rest, "uid"), "wide-rest-sets")
        pairs = written(prefix_pairs(sets, similarity), "wide-rest-pairs")
        more = written(linked(pairs, sets, similarity), "wide-rest-links")
        discard(pairs, sets)
        if not more.isEmpty():
            stars = found.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a < b")
            found = components(written(stars.unionByName(more), "wide-all-links"))
    return found.select(F.col("node").alias("uid"), "root")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the near copies of a row that stays: of each component the one with the least id.  No text is shuffled."""
    placed = place(docs, "wide-placed")
    found = near_copies(placed, text_col=text_col, width=width, similarity=similarity)
    ids = placed.df.select(F.col(placed.row).alias("uid"), F.col(id_col).alias("id"))
    named = found.join(ids, "uid").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("stays"))
    gone = found.join(named, "root").where(F.col("uid") != F.col("stays.uid")).select("uid")
    gone = written(gone, "wide-gone")
    return placed.without(gone).select(*docs.columns)
