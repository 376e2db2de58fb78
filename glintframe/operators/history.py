"""Audit history and live metrics: top-N, nearest-rank percentiles, bounded samples, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit, ratio
from glintframe.operators import scan

#: Fixed values.
RECENT_MOST, SOURCE_MOST, SAMPLE_MOST, SAMPLE_DROP, TREND_ROWS, FEED_ROWS, PAGE_ROWS = 1000, 512, 2000, 1000, 60, 12, 23


def clamp_limit(n: int, most: int = RECENT_MOST) -> int:
    return max(1, min(n, most))


def recent(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` rows (1 to 1000) by ``order``."""
    return df.orderBy(F.desc(order)).limit(clamp_limit(n))


def payload_number(payload: Column, key: str) -> Column:
    """A number of a JSON object; null for text that is none."""
    return F.try_to_number(F.get_json_object(payload, f"$.{key}"), F.lit("S999999999"))


def history_row(df: DataFrame) -> DataFrame:
    """Rows as the history keeps them: sources up to 512 characters, verdicts by is_ai alone, the rest as JSON."""
    verdict = F.when(F.col("is_ai"), "ai").otherwise("authentic")
    return df.withColumns({"source": F.substring("source", 1, SOURCE_MOST), "verdict": verdict, "payload_json": F.to_json(F.struct("p", "verdict_state"))})


def stats(df: DataFrame, hit: Column, latency: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.coalesce(F.avg(latency), lit(0.0)).alias("mean_latency"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))


def nearest_rank(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """n, p50 = the value at place n // 2 and p95 = at place min(n - 1, floor(0.95 n)) of the sorted values.

    Rows are ranged and counted by range; only the two ranges that hold the places are numbered.
    """
    rows = df.select(F.col(value).alias("value")).where("value is not null")
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    sums = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts
    base = sums.select(F.col("part").alias("own"), before.alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    placed = ranged.join(F.broadcast(base), F.col("part") == F.col("own")).withColumn("upto", upto)  # ``parts`` rows

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("value")))

    last = F.least(F.col("total") - 1, F.floor(F.col("total") * lit(0.95)))
    return placed.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), F.coalesce(at(F.floor(F.col("total") / 2)), lit(0.0)).alias("p50"), F.coalesce(at(last), lit(0.0)).alias("p95"))


def keep_last(df: DataFrame, n: int, order: str, by: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows by ``order``; by group if ``by`` is given, else as a distributed top-N."""
    if not by:
        return df.orderBy(F.desc(order)).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return df.withColumn("place", place).where(F.col("place") <= n).drop("place")


def bounded_sample(df: DataFrame, order: str) -> DataFrame:
    """What a buffer holds that drops its oldest 1000 whenever it passes 2000."""
    n = df.count()
    over = 0 if n <= SAMPLE_MOST else -(-(n - SAMPLE_MOST) // SAMPLE_DROP) * SAMPLE_DROP
    return keep_last(df, n - over, order)


def kpis(df: DataFrame, ai: Column, authentic: Column, latency: str) -> DataFrame:
    n = F.count("*")
    return df.agg(
        n.alias("n"), F.coalesce(F.sum(ai.cast("long")), F.lit(0)).alias("ai"), F.coalesce(F.sum(authentic.cast("long")), F.lit(0)).alias("authentic"),
        F.coalesce(F.avg(latency), lit(0.0)).alias("mean_latency"),
        (F.coalesce(F.sum(ai.cast("long")), F.lit(0)) * lit(100.0) / F.greatest(n, F.lit(1))).alias("ai_percent"),
    )


def histogram(df: DataFrame, percent: Column, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` of 0 to 100, empty ones kept."""
    at = F.least(F.lit(bins - 1), F.floor(percent / 100 * bins)).cast("long")
    counts = df.groupBy(at.alias("bin")).agg(F.count("*").alias("found"))
    axis = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return axis.join(counts, "bin", "left").select("bin", F.coalesce("found", F.lit(0)).alias("n"))


def trend(df: DataFrame, order: str, n: int = TREND_ROWS) -> DataFrame:
    """The last ``n`` rows by ``order``, numbered from 0."""
    last = keep_last(df, n, order)
    return last.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)  # ``n`` rows


def with_style(df: DataFrame, styles: DataFrame, key: str, fallback: str) -> DataFrame:
    """A small dimension joined, with a style for what it lacks; the planner broadcasts it if it is small."""
    return df.join(styles, key, "left").withColumn("style", F.coalesce("style", F.lit(fallback)))


def pages(df: DataFrame, order: str, by: str, rows: int = PAGE_ROWS) -> DataFrame:
    """The page of each row when a report of ``by`` shows ``rows`` to a page; rows that tie by a hash of all their columns."""
    name = scan.fresh(df, "page__place")
    return scan.ranked(df, [by], F.col(order), F.xxhash64(*df.columns), name).withColumn("page", F.floor((F.col(name) - 1) / rows)).drop(name)


def job_progress(df: DataFrame, by: str, failed: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum((~failed).cast("long")).alias("done"), F.sum(failed.cast("long")).alias("errors")).withColumn(
        "share", ratio(F.col("done"), F.col("n"))
    )
