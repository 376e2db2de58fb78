"""Batch jobs and live figures as structured streams over folders that files arrive in.

Every stream runs over what has arrived and then ends (``availableNow``); called again with its
checkpoint it goes on with what has come since.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintframe.operators import scan

#: Files that a job takes; seconds between two looks at it, and until it is given up.
JOB_FILES, POLL_SECONDS, POLL_TIMEOUT = 64, 0.7, 300.0


def arrivals(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def submitted(files: DataFrame, job: str, order: str, most: int = JOB_FILES) -> DataFrame:
    """The first ``most`` files of each job, numbered from 0; what is over is left out, as the service does."""
    index = F.row_number().over(Window.partitionBy(job).orderBy(order)) - 1
    return files.withColumn("index", index).where(F.col("index") < most)


def outcomes(rows: DataFrame, error: Column, results: dict[str, Column]) -> DataFrame:
    """Each row with status, error and ``results``; a row with an error has no results, and the others go on."""
    failed = error.isNotNull()
    columns = {name: F.when(~failed, value) for name, value in results.items()}
    return rows.withColumns({"status": F.when(failed, "error").otherwise("done"), "error": error, **columns})


def run_job(stream: DataFrame, into: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's outcomes to its own folder of ``into``, so that a batch done twice is there once."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict[str, Any]:
    """Rows and batches that a stream has done so far."""
    seen = query.recentProgress
    return {"batches": len(seen), "completed": sum(p["numInputRows"] for p in seen), "active": query.isActive}


def poll(query: StreamingQuery, look: Callable[[dict[str, Any]], None] | None = None, timeout: float = POLL_TIMEOUT, every: float = POLL_SECONDS) -> bool:
    """Looks at ``query`` until it has ended (True) or the time is up (False)."""
    until = time.monotonic() + timeout
    while time.monotonic() < until:
        ended = query.awaitTermination(min(every, max(0.0, until - time.monotonic())))
        if look:
            look(progress(query))
        if ended:
            return True
    return False


def live_counts(stream: DataFrame, into: str, checkpoint: str, by: list[str], figures: list[Column]) -> StreamingQuery:
    """Running figures by ``by``; after each batch ``into`` holds the whole refreshed table."""

    def refresh(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/refresh={number:09d}")

    grouped = stream.groupBy(*by).agg(*figures)
    return grouped.writeStream.outputMode("complete").foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, into: str) -> DataFrame:
    """The table as last refreshed."""
    all_rows = spark.read.parquet(into)
    newest = all_rows.agg(F.max("refresh")).first()[0]
    return all_rows.where(F.col("refresh") == newest).drop("refresh")


def batch_before(spark: SparkSession, into: str, number: int) -> DataFrame | None:
    """What the batch before ``number`` left in ``into``; None for the first."""
    return spark.read.parquet(f"{into}/batch={number - 1:09d}") if number else None


def moving_averages(stream: DataFrame, into: str, checkpoint: str, user: str, order: str, hit: str, share: float = 0.1, start: float = 0.5) -> StreamingQuery:
    """Per user the moving accuracy after each batch's rows in ``order``, and how many rows there were so far; after batch n ``into``/batch=n has all users.

    A batch's rows of a user are one affine map, made of maps of pieces of bounded size: no task has a user's rows. The state is the table that the
    batch before left; a batch that is done again reads and writes the same tables.
    """

    def step(batch: DataFrame, number: int) -> None:
        maps = scan.moving_average(batch, [user], F.col(order), F.col(hit), F.col(hit), share, 0.0).select(user, F.col("n").alias("new"), F.col("average").alias("moved"))
        before = batch_before(batch.sparkSession, into, number)
        if before is None:
            before = batch.sparkSession.createDataFrame([], f"{user} {batch.schema[user].dataType.simpleString()}, accuracy double, n long")
        both = maps.join(before.withColumnRenamed(user, "before__user"), F.col(user).eqNullSafe(F.col("before__user")), "full")
        old, new = F.coalesce("n", F.lit(0)), F.coalesce("new", F.lit(0))
        value = F.coalesce("moved", F.lit(0.0)) + F.pow(F.lit(1.0 - share), new) * F.coalesce("accuracy", F.lit(start))
        both.select(F.coalesce(user, "before__user").alias(user), value.alias("accuracy"), (old + new).alias("n")).write.mode("overwrite").parquet(f"{into}/batch={number:09d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_batch(spark: SparkSession, into: str) -> DataFrame:
    """The table that the last batch left."""
    every = spark.read.parquet(into)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


#: Rows that a buffer of samples holds at most, and the oldest ones that go when it is over.
BUFFER_MOST, BUFFER_DROP = 2000, 1000


def buffered(n: Column) -> Column:
    """How many of ``n`` arrivals the buffer holds."""
    over = F.greatest(F.lit(0), F.ceil((n - BUFFER_MOST) / BUFFER_DROP)) * BUFFER_DROP
    return n - over


def nearest_ranks(values: Column, shares: dict[str, float]) -> list[Column]:
    """Of a sorted array the value at place floor(n * share), the last one at most; 0 of an empty one."""
    n = F.size(values)
    return [F.coalesce(F.get(values, F.least(n - 1, F.floor(n * F.lit(share))).cast("int")), F.lit(0.0)).alias(name) for name, share in shares.items()]


def sample_figures(stream: DataFrame, into: str, checkpoint: str, order: str, value: str) -> StreamingQuery:
    """A buffer of the newest arrivals (batch after batch, in ``order`` within one) and its nearest-rank figures after each batch.

    ``into``/buffer has the buffer of each batch, ``into``/figures a row (total, n, p50, p95, p99).  Of a batch only as many rows
    as the buffer can hold are sorted out, as a distributed top-N; a batch that is done again writes the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch_before(spark, f"{into}/buffer", number)
        total = (spark.read.parquet(f"{into}/figures/batch={number - 1:09d}").first().total if number else 0) + batch.count()
        keep = spark.range(1).select(buffered(F.lit(total)).cast("long")).first()[0]
        rows = batch.select(F.lit(number).cast("long").alias("arrival"), F.col(order).alias("place"), F.col(value).cast("double").alias("value"))
        rows = rows if held is None else rows.unionByName(held)
        rows.orderBy(F.desc("arrival"), F.desc("place")).limit(keep).write.mode("overwrite").parquet(f"{into}/buffer/batch={number:09d}")
        kept = spark.read.parquet(f"{into}/buffer/batch={number:09d}").agg(F.sort_array(F.collect_list("value")).alias("values"))  # BUFFER_MOST rows
        figures = kept.select(F.lit(total).cast("long").alias("total"), F.size("values").cast("long").alias("n"), *nearest_ranks(F.col("values"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}))
        figures.write.mode("overwrite").parquet(f"{into}/figures/batch={number:09d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
