"""Perceptual hashes that were kept, under each of their segments, so that new ones meet only what they may be near.

Hashes that differ in up to ``distance`` bits share one of distance + 1 segments.  The index is a ``Snapshots`` table of (segment, id, hash) whose
buckets follow the segments: an arrival opens the buckets of its own segments, and what it keeps is published in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators.manifest import greedy_keep, hamming_pairs
from glintframe.session import stored
from glintframe.sources.snapshots import Snapshots


def segments(value: Column, distance: int, bits: int = 64) -> Column:
    """(place, bits) of each of the distance + 1 segments of a hash."""
    parts = distance + 1
    edges = [bits * i // parts for i in range(parts + 1)]
    cut = lambda lo, hi: F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("place"), cut(lo, hi).alias("bits")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


class HashIndex:
    """Keep-first over arrivals: a row stays unless it is near one that stayed before, in arrival order and, within an arrival, by id."""

    def __init__(self, spark: SparkSession, root: str, distance: int = 4, buckets: int = 64) -> None:
        self.distance = distance
        self.table = Snapshots(spark, root, ["place", "bits", "id"], "place int, bits long, id long, hash long", buckets, ["place", "bits"])

    def rows(self) -> DataFrame:
        """(id, hash) of all that stayed."""
        return self.table.read().where("place = 0").select("id", "hash")

    def near(self, new: DataFrame) -> DataFrame:
        """(id, kept, distance): rows of ``new`` (id, hash) and those that stayed within the distance."""
        cut = new.select("id", "hash", F.explode(segments(F.col("hash"), self.distance)).alias("s")).select("id", "hash", "s.place", "s.bits")
        known = self.table.touched(cut).select("place", "bits", F.col("id").alias("kept"), F.col("hash").alias("kept_hash"))
        apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("kept_hash")))
        return cut.join(known, ["place", "bits"]).where(apart <= self.distance).select("id", "kept", apart.alias("distance")).distinct()

    def add(self, new: DataFrame, id_col: str, hash_col: str) -> DataFrame:
        """Rows (id, hash) of ``new`` that stay; they are in the index afterwards.  Null hashes are near nothing and aren't indexed; an id that stayed before is replaced by nothing."""
        rows = stored(new.select(F.col(id_col).cast("long").alias("id"), F.col(hash_col).cast("long").alias("hash")).where("id is not null and hash is not null").dropDuplicates(["id"]), "arrival")
        fresh = stored(rows.join(self.near(rows).select("id"), "id", "left_anti"), "fresh")
        kept = stored(greedy_keep(fresh, hamming_pairs(fresh, "id", "hash", self.distance), "id", "id"), "kept")
        self.table.upsert(kept.select("id", "hash", F.explode(segments(F.col("hash"), self.distance)).alias("s")).select("s.place", "s.bits", "id", "hash"))
        return kept
