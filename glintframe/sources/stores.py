"""History, reports and exports as folders of Parquet and JSON that are appended to.

A folder that lacks a newer column is read with nulls for it; reports that don't parse are left
out and start no new history's end; an export carries the digest of its rows.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
SOURCE_LENGTH, REPORTS_KEPT = 512, 100
HISTORY = (
    "id long, created_at timestamp, request_id string, source string, verdict string, verdict_state string, confidence double, fake_probability double, "
    "latency_ms double, model_version string, file_sha256 string, payload_json string"
)
CSV_COLUMNS = ("index", "filename", "status", "is_ai", "confidence", "fake_probability", "family", "latency_ms", "error")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a history; files of before a column was added have nulls there."""
    return spark.read.schema(HISTORY).parquet(path)


def append_history(rows: DataFrame, path: str, order: str, now: Column | None = None) -> None:
    """Appends ``rows`` (HISTORY's columns but id and created_at; ``payload`` a struct or map) with ids that follow on, in ``order``.

    Ids are dealt by ranges of ``order``: each range is numbered alone and starts where those before it end.
    """
    spark = rows.sparkSession
    first = 0
    if exists(spark, path):
        first = history(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = with_ids(rows, order, first)
    out = numbered.select(
        "id", (F.current_timestamp() if now is None else now).alias("created_at"), "request_id", F.substring("source", 1, SOURCE_LENGTH).alias("source"), "verdict", "verdict_state",
        *[F.col(c).cast("double").alias(c) for c in ("confidence", "fake_probability", "latency_ms")], "model_version", "file_sha256",
        F.coalesce(F.to_json("payload"), F.lit("{}")).alias("payload_json"),
    )
    out.write.mode("append").parquet(path)


def with_ids(rows: DataFrame, order: str, first: int, parts: int = 64) -> DataFrame:
    """``rows`` with ``id``: first + 1, first + 2, ... by ``order``, without a task that sees all rows.

    The ranges' bounds are read once: Spark samples anew for each range exchange, so two that differ in their columns may cut elsewhere.
    """
    ranged = rows.select(F.col(order).alias("ids__order")).repartitionByRange(parts, "ids__order").groupBy(F.spark_partition_id()).agg(F.min("ids__order").alias("low"))
    bounds = sorted(r[0] for r in ranged.where("low is not null").collect())[1:]  # fewer than ``parts``
    kind = rows.schema[order].dataType
    part = sum((F.when(F.col(order) >= F.lit(b).cast(kind), 1).otherwise(0) for b in bounds), F.lit(0))
    cut = rows.withColumn("ids__part", part)
    sums = cut.groupBy("ids__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("ids__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ``parts`` rows
    base = F.broadcast(sums.select(F.col("ids__part").alias("ids__own"), before.alias("ids__before")))
    inside = F.row_number().over(Window.partitionBy("ids__part").orderBy(order))
    numbered = cut.withColumn("ids__in", inside).join(base, F.col("ids__part") == F.col("ids__own"))
    return numbered.withColumn("id", F.col("ids__in") + F.col("ids__before") + first).drop("ids__in", "ids__part", "ids__own", "ids__before")


def clear_history(spark: SparkSession, path: str) -> None:
    """Leaves an empty history that can still be read."""
    spark.createDataFrame([], HISTORY).write.mode("overwrite").parquet(path)


def batch_csv(results: DataFrame) -> DataFrame:
    """The nine columns of a job's table; ``is_ai`` in words, empty for rows that failed.  Sort by index to write."""
    word = F.when(F.col("is_ai").isNull(), "").when(F.col("is_ai"), "ai").otherwise("authentic")
    return results.withColumn("is_ai", word).select(*CSV_COLUMNS)


def append_report(spark: SparkSession, report: dict, folder: str, stamp: str) -> None:
    """One report in full, and without its curves as the newest entry of the history."""
    full = spark.createDataFrame([(stamp, json.dumps(report))], "stamp string, body string")
    full.select("body").coalesce(1).write.mode("append").text(f"{folder}/reports/stamp={stamp}")
    slim = {k: v for k, v in report.items() if k not in ("roc_points", "pr_points")}
    spark.createDataFrame([(json.dumps({"stamp": stamp, **slim}),)], "body string").coalesce(1).write.mode("append").text(f"{folder}/history")


def report_history(spark: SparkSession, folder: str, schema: str, keep: int = REPORTS_KEPT) -> DataFrame:
    """The last ``keep`` entries (stamp and ``schema``); entries that don't parse are left out."""
    if not exists(spark, f"{folder}/history"):
        return spark.createDataFrame([], f"stamp string, {schema}")
    rows = spark.read.schema(f"stamp string, {schema}, broken string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="broken").json(f"{folder}/history")
    return rows.where("broken IS NULL").drop("broken").orderBy(F.desc("stamp")).limit(keep)


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """The newest full report, as one row; an error where there is none yet."""
    try:
        reports = spark.read.option("basePath", f"{folder}/reports").text(f"{folder}/reports/*")
    except AnalysisException as why:
        raise FileNotFoundError("no performance report yet") from why
    newest = reports.orderBy(F.desc("stamp")).limit(1)
    return newest.select("stamp", F.col("value").alias("body"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def data_hash(df: DataFrame) -> DataFrame:
    """One digest of all rows, whatever their order: row digests are summed by 32-bit words, the sums digested."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    sums = df.agg(F.count("*").alias("rows"), *words)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)])
    return sums.select(F.col("rows").alias("sample_count"), F.sha2(text, 256).alias("data_hash"))


def export_signed(df: DataFrame, path: str, version: str = "1.0.0") -> None:
    """Rows and, beside them, their proof: digest, count, version and a stamp."""
    export_json(df, f"{path}/rows")
    proof = data_hash(df).withColumns({"version": F.lit(version), "created_at": F.current_timestamp()})
    proof = proof.withColumn("signature", F.sha2(F.concat("data_hash", F.col("created_at").cast("string")), 256))
    proof.write.json(f"{path}/proof")


def import_verified(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The exported rows; an error if their digest isn't that of the proof.  The signature isn't checked: it names no key."""
    rows = import_json(spark, f"{path}/rows", schema)
    proof = spark.read.schema("data_hash string").json(f"{path}/proof").first()
    if proof is None or proof[0] != data_hash(rows).first()["data_hash"]:
        raise ValueError("the rows of this export are not those of its proof")
    return rows
