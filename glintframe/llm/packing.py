"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Lengths are whole numbers up to the capacity, so a packing is decided by how many pieces
there are of each length: at most ``capacity`` numbers, whatever the corpus.  The plan is made
from these on the driver, in runs of equal bins; pieces are then numbered within their length
and find their bin by that number, in a broadcast join with the runs (their count is bounded by
the capacity too).

Plan: pieces of full capacity stand alone.  Of those above a third at most two share a bin,
so the longest takes the longest partner that still fits (greedy matching).  Smaller ones, longest
first, go where the least room that is enough is left; new bins open only when none is.

Defined cases: a null or empty text is one piece, the separator alone; a null id is a document
like others; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import ids

CAPACITY, SEPARATOR = 2048, 0


def pieces(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of each document's ids and separator: doc_id, piece, start, length, ids_crc32 [, ids].

    Only documents above capacity are cut; their first piece holds what full ones leave.
    """
    fields = [
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            which: list[int] = []
            for row, text in enumerate(batch.column(1)):
                whole = np.append(ids(text.as_py() or "", tokenizer), np.uint32(SEPARATOR)).astype("<u4")
                first = len(whole) % capacity or capacity
                edges = [0, *range(first, len(whole) + 1, capacity)]
                for n, (start, end) in enumerate(zip(edges, edges[1:])):
                    part = whole[start:end]
                    which.append(row)
                    for column, value in zip(rows, (n, start, end - start, zlib.crc32(part.tobytes()), part.astype(np.int32))):
                        column.append(value)
            columns = [pa.array(column, kind) for column, kind in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *columns], names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first, n, per_bin, bin, offset) and the number of bins.

    Pieces first .. first + n - 1 of a length lie ``per_bin`` to a bin, from ``bin`` on, from ``offset`` on.
    """
    left = {s: n for s, n in counts.items() if n}
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(left, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins with it: first bin, how many
    gaps: list[int] = []
    bins = 0

    def place(length: int, n: int, per_bin: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], n, per_bin, first_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if gap not in room:
                room[gap] = []
                insort(gaps, gap)
            room[gap].append((first_bin, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for length in reversed(large):
        while n := left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and (not left[large[at]] or large[at] == length and n < 2):
                at -= 1
            if at < 0:
                place(length, n, 1, bins, 0)
                leave(capacity - length, bins, n)
                bins += n
            elif (partner := large[at]) == length:
                pairs = n // 2
                place(length, 2 * pairs, 2, bins, 0)
                leave(capacity - 2 * length, bins, pairs)
                bins += pairs
            else:
                pairs = min(n, left[partner])
                place(length, pairs, 1, bins, 0)
                place(partner, pairs, 1, bins, length)
                leave(capacity - length - partner, bins, pairs)
                bins += pairs
    for length in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while n := left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                opened = -(-n // (capacity // length))
                leave(capacity, bins, opened)
                bins += opened
                continue
            gap = gaps[at]
            first_bin, many = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop(at)
            fits = gap // length
            full = min(many, n // fits)
            if full:
                place(length, full * fits, fits, first_bin, capacity - gap)
                leave(gap - fits * length, first_bin, full)
            elif n < fits:
                place(length, n, n, first_bin, capacity - gap)
                leave(gap - n * length, first_bin, 1)
                full = 1
            leave(gap, first_bin + full, many - full)
    return runs, bins


def numbered(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``cut`` with ``number``, the rank of a piece among those of its length.

    A length that many pieces have is dealt out over salts, so that no group outgrows half a
    partition's share; ranks within a salt start where those of the salts before it end.
    """
    spark = cut.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum(counts.values())
    salts = spark.createDataFrame([(s, -(-parts * n // total)) for s, n in counts.items()], "salt__length long, salts long")
    dealt = cut.join(F.broadcast(salts), F.col("length") == F.col("salt__length"))  # at most ``capacity`` rows
    dealt = dealt.withColumn("salt", F.expr("pmod(xxhash64(uid), salts)")).drop("salt__length", "salts")
    starts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(F.col("length").alias("start__length"), F.col("salt").alias("start__salt"), F.coalesce(before, F.lit(0)).alias("before"))
    starts = written(starts, "pack-starts")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = dealt.withColumn("rank", rank).join(starts, (F.col("length") == F.col("start__length")) & (F.col("salt") == F.col("start__salt")))
    return ranked.withColumn("number", F.col("rank") + F.col("before")).drop("rank", "before", "salt", "start__length", "start__salt")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (any rows with a ``length`` of 1 to capacity) with sequence_id and offset; columns of these names are replaced."""
    spark = cut.sparkSession
    kept = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    rows = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # names of the input can't clash inside
    cut = written(cut.select(rows, "length", F.monotonically_increasing_id().alias("uid")), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity)
    names = "run__length long, first long, n long, per_bin long, bin long, run__offset long"
    table = F.broadcast(spark.createDataFrame(runs, names))
    if not counts:
        return cut.select("row.*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    inside = (F.col("length") == F.col("run__length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n"))
    placed = numbered(cut, counts).join(table, inside)
    nth = F.col("number") - F.col("first")
    return placed.select(
        "row.*",
        (F.col("bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run__offset") + (nth % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """Packed pieces with their ids -> (sequence_id, ids, doc_ids), one row per sequence of at most capacity ids."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = placed.groupBy("sequence_id").agg(ordered.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
