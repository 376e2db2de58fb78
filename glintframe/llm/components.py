"""Connected components of a graph of pairs, by alternating star contractions.

Each round is two groupings and a join over the edges that are left; edges of a closed
component are a star around its smallest node and stop changing.  A node's neighbours are
only ever reduced by ``min``, which Spark combines before it shuffles, so a node with very
many of them needs no task of its own.

Defined cases: pairs of a node and itself, and repeated pairs, change nothing; pairs that aren't a < b, or have a null end, are left
out; no pairs give no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), a < b -> (node, root) for every node on an edge; root is the smallest node it reaches."""
    edges = edges.where("a < b")
    before = None
    while True:
        # Large star: every larger neighbour of a node is linked to the node's least neighbour.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the least of them.
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(down, "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(down.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = written(small.where("a < b").distinct(), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = tuple(state)
