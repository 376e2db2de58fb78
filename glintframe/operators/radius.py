"""Rows within a distance of each other, by blocks: counts without pairs, and pairs of chosen rows alone.

Rows are dealt to the cell of the nearest of some pivot rows and, in a cell, cut by their distance to its pivot into rings of ``RING``
rows at most, so a cell may hold any share of the rows.  Two rings can only hold rows within ``epsilon`` if the triangle
inequality allows it, by the pivots' distance and the rings' bounds; those that can meet as one product of matrices.
A ring pair gives each row's count of rows in reach; pairs of rows are emitted for rows that are asked for.  All of it is exact.

Rings are read where they lie and never shuffled to each other: one side is broadcast, about ``AT_ONCE`` bytes after the other.
What is compared grows with the square of the rows where the inequality prunes little; what is sent and written doesn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators import scan
from glintframe.session import stored

#: Rows of a ring, and pivots at most.
RING, PIVOTS = 2048, 256
#: Bytes of rings that are broadcast at a time, about.
AT_ONCE = 64 << 20
#: Distances that differ by less are compared exactly.
SLACK = 1e-7


def rings(df: DataFrame, id_col: str, vector: str, pivots: int = PIVOTS, ring: int = RING) -> tuple[DataFrame, np.ndarray]:
    """(block, cell, low, high, ids, data): rings as matrices of doubles, with the bounds of the distances to their pivot; and the pivots."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null")
    n = rows.count()
    most = max(1, min(pivots, int(np.sqrt(n / 8)) + 1))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()  # PIVOTS rows at most
    centres = np.array([r.v for r in chosen], float).reshape(len(chosen), -1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            if batch.num_rows:
                far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (centres * centres).sum(1) - 2 * v @ centres.T, 0))
                cell = far.argmin(axis=1)
                own = np.sqrt(((v - centres[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cell": pa.array(cell, pa.int32()), "far": own, "data": [x.tobytes() for x in v]})

    celled = stored(rows.mapInArrow(nearest, "id long, cell int, far double, data binary"), "cells")
    placed = scan.ranked(celled, ["cell"], F.col("far"), F.col("id"), "place").withColumn("ring", F.floor((F.col("place") - 1) / ring))
    packed = F.sort_array(F.collect_list(F.struct("id", "data")))
    grouped = placed.groupBy("cell", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), packed.alias("rows"))  # RING rows at most
    joined = F.aggregate("rows", F.lit(b""), lambda s, r: F.concat(s, r["data"]))
    made = grouped.select(F.xxhash64("cell", "ring").alias("block"), "cell", "low", "high", F.col("rows.id").alias("ids"), joined.alias("data"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return stored(made.repartition(parts, "block"), "rings"), centres


def meetings(blocks: DataFrame, centres: np.ndarray, epsilon: float) -> DataFrame:
    """(left, right): pairs of rings that may hold rows within ``epsilon``, each once, a ring and itself too."""
    spark = blocks.sparkSession
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(axis=2), 0))
    table = [(int(a), int(b), float(apart[a, b])) for a in range(len(centres)) for b in range(len(centres))]
    cells = spark.createDataFrame(table or [(0, 0, 0.0)], "cell int, other int, apart double")  # PIVOTS squared rows at most
    slim = blocks.select("block", "cell", "low", "high")
    other = blocks.select(F.col("block").alias("right"), F.col("cell").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = slim.join(F.broadcast(cells), "cell").join(other, "other")
    e = epsilon + SLACK
    near = (F.col("apart") - F.col("high") - F.col("high2") < e) & (F.col("low") - F.col("high2") - F.col("apart") < e) & (F.col("low2") - F.col("high") - F.col("apart") < e)
    return pairs.where((F.col("block") <= F.col("right")) & near).select(F.col("block").alias("left"), "right")


def _reach(left: np.ndarray, right: np.ndarray, epsilon: float) -> np.ndarray:
    """Which rows of ``left`` are closer than ``epsilon`` to which of ``right``; near the bound the differences themselves decide."""
    square = left @ right.T
    square *= -2
    square += (left * left).sum(1)[:, None]
    square += (right * right).sum(1)
    bound = epsilon * epsilon
    close = square < bound
    square -= bound
    for i, j in zip(*np.nonzero(np.abs(square, out=square) < SLACK * (1 + bound))):
        close[i, j] = ((left[i] - right[j]) ** 2).sum() < bound
    return close


def _met(blocks: DataFrame, meet: DataFrame, work: Callable, schema: str, at_once: int | None = None, *more: str) -> DataFrame:
    """What ``work`` makes of the pairs of rings in ``meet``, with the rings' columns ``more`` too (the right one's end in 2), added up by id if it counts."""
    size = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    groups = max(1, -(-size // (at_once or AT_ONCE)))
    names = ("ids", "data", *more)
    left = blocks.select(F.col("block").alias("left"), *names)
    right = blocks.select(F.col("block").alias("right"), *[F.col(n).alias(f"{n}2") for n in names])
    meet, found = stored(meet, "meetings"), []
    for k in range(groups):
        own = F.pmod(F.xxhash64("right"), F.lit(groups)) == k
        # Of a group's rings, a broadcast of bounded size, and the pairs that they are in.
        made = left.join(F.broadcast(meet.where(own)), "left").join(F.broadcast(right.where(own)), "right").mapInArrow(work, schema)
        found.append(stored(made.groupBy("id").agg(F.sum("near").alias("near")) if "near" in made.columns else made, "met"))
    return reduce(DataFrame.unionByName, found)


def _matrices(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[d]).reshape(len(row[i]), -1) for i, d in (("ids", "data"), ("ids2", "data2")))


def counts(blocks: DataFrame, centres: np.ndarray, epsilon: float, at_once: int | None = None) -> DataFrame:
    """(id, near): how many other rows are closer than ``epsilon``; rows without any are left out.  No pair of rows is ever made."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                close = _reach(*_matrices(row), epsilon)
                if row["left"] == row["right"]:
                    np.fill_diagonal(close, False)
                    found = [(row["ids"], close.sum(axis=1))]
                else:
                    found = [(row["ids"], close.sum(axis=1)), (row["ids2"], close.sum(axis=0))]
                for ids, n in found:
                    some = n > 0
                    yield pa.RecordBatch.from_pydict({"id": np.array(ids, np.int64)[some], "near": n[some].astype(np.int64)})

    each = _met(blocks, meetings(blocks, centres, epsilon), count, "id long, near long", at_once)
    return each.groupBy("id").agg(F.sum("near").alias("near"))


def pairs(blocks: DataFrame, centres: np.ndarray, epsilon: float, chosen: DataFrame | None = None, at_once: int | None = None) -> DataFrame:
    """(a, b): rows closer than ``epsilon``, both ways; with ``chosen`` (id) only those whose ``a`` is one of them."""
    asked = blocks
    if chosen is not None:
        ids = blocks.select("block", F.posexplode("ids").alias("pos", "id"))
        marks = ids.join(chosen.select("id").distinct(), "id").groupBy("block").agg(F.collect_list("id").alias("asked"))  # of one ring
        asked = blocks.join(marks.withColumnRenamed("block", "asked__block"), F.col("block") == F.col("asked__block"), "left").drop("asked__block")
    else:
        asked = blocks.withColumn("asked", F.col("ids"))
    asked = stored(asked, "asked")
    meet = meetings(blocks, centres, epsilon)
    wanted = asked.where("size(asked) > 0").select(F.col("block").alias("wanted"))
    half = meet.join(wanted, F.col("left") == F.col("wanted"), "left_semi").unionByName(meet.join(wanted, F.col("right") == F.col("wanted"), "left_semi")).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                close = _reach(*_matrices(row), epsilon)
                a, b = np.array(row["ids"], np.int64), np.array(row["ids2"], np.int64)
                if row["left"] == row["right"]:
                    np.fill_diagonal(close, False)
                sides = [(a, b, close, row["asked"])] + ([] if row["left"] == row["right"] else [(b, a, close.T, row["asked2"])])
                for own, other, near, some in sides:
                    i, j = np.nonzero(near & np.isin(own, np.array(some or [], np.int64))[:, None])
                    for first in range(0, len(i), 100_000):
                        yield pa.RecordBatch.from_pydict({"a": own[i[first : first + 100_000]], "b": other[j[first : first + 100_000]]})

    return _met(asked, half, emit, "a long, b long", at_once, "asked")
