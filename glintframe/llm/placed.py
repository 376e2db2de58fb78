"""Rows with a place, so that decisions about rows reach whole texts without moving the texts.

``place`` writes a table once more with a unique row number, bucketed by chunks of 2^15 rows.  A
chunk holds rows that one task has written, so nothing is shuffled.  Operators work on slim
columns and row numbers; what they decide comes back as one bitmap for each chunk (4 KB), joined
to the chunk's bucket: the rows decided on are shuffled as 8 bytes each, texts never.

Defined cases: columns of any kind, nulls too, are kept as they are; names that clash with ``row`` and ``chunk`` get other names beside them; repeated rows have
numbers of their own; a decision about no rows marks none; an empty table stays one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, small_batches

CHUNK_BITS = 15
#: Files that a task keeps open: it writes chunk after chunk, each to its bucket's file.
OPEN_FILES = "4"
#: Bytes of a row group, which a reader holds as a whole.
ROW_GROUP = 16 << 20


@dataclass
class Placed:
    df: DataFrame
    row: str
    chunk: str
    path: str
    columns: list[str]

    def marked(self, *rows: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``df``, and for each of ``rows`` (one column: row numbers, each once) whether a row is in it."""
        out, marks = self.df, []
        for number, own in enumerate(rows):
            bits, at = fresh(out, f"place__bits{number}", f"place__at{number}")
            numbers = own.select(F.col(own.columns[0]).alias("row"))
            numbers = numbers.select(F.shiftright("row", CHUNK_BITS).alias(at), F.col("row").bitwiseAND(2**CHUNK_BITS - 1).alias("place__bit"))
            # Dealt by chunk before the bitmaps are made: rows are smaller than bitmaps of a few rows each.
            vectors = numbers.repartition(at).groupBy(at).agg(F.bitmap_construct_agg("place__bit").alias(bits))
            out = out.join(vectors.hint("shuffle_hash"), F.col(self.chunk) == F.col(at), "left").drop(at)
            byte = F.substring(bits, F.shiftright(F.col(self.row).bitwiseAND(2**CHUNK_BITS - 1), 3).cast("int") + 1, F.lit(1))
            value = F.conv(F.hex(byte), 16, 10).cast("int")
            bit = F.call_function("shiftright", value, F.col(self.row).bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
            marks.append(F.col(bits).isNotNull() & bit)
        return out, marks

    def only(self, rows: DataFrame) -> DataFrame:
        out, (mark,) = self.marked(rows)
        return out.where(mark)

    def without(self, rows: DataFrame) -> DataFrame:
        out, (mark,) = self.marked(rows)
        return out.where(~mark)


def bucketed(rows: DataFrame, column: str, path: str) -> DataFrame:
    """``rows`` written at ``path`` and reread, bucketed by ``column``, of which a task has few values, one after the other: nothing is shuffled or sorted."""
    spark = rows.sparkSession
    known = f"glintframe_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, OPEN_FILES)  # else each task would sort its texts by bucket
    try:
        with small_batches(spark):
            rows.write.bucketBy(buckets, column).options(**{"path": path, "compression": "zstd", "parquet.block.size": ROW_GROUP}).saveAsTable(known)
    finally:
        spark.conf.set(setting, before)
    df = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # the catalog forgets it; files and ``df`` stay
    return df


def place(docs: DataFrame, name: str, row: str = "row", chunk: str = "chunk", path: str | None = None) -> Placed:
    """``docs`` with a unique ``row`` (those of a chunk without gaps) and its ``chunk``, or names near these where ``docs`` has them."""
    columns = docs.columns
    row, chunk = fresh(docs, row, chunk)
    path = path or scratch(docs.sparkSession, name)
    number = F.monotonically_increasing_id()
    rows = docs.select("*", number.alias(row), F.shiftright(number, CHUNK_BITS).alias(chunk))
    return Placed(bucketed(rows, chunk, path), row, chunk, path, columns)
