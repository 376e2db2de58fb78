"""Tables of a data folder, and the score table that evaluation queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored images: id, y, p, state, generator, size, toxic."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    p = lit(0.4) * F.col("quality") + lit(0.6) * ((F.col("doc_id") * 7919) % 1000) / lit(1000.0)
    return joined.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), p.alias("p"), F.col("lang").alias("state"),
        F.col("source").alias("generator"), F.col("n_chars").alias("size"), "toxic",
    )


#: The same table for the SQL oracles.
SCORED_SQL = """scored AS (
  SELECT l.doc_id AS id, l.quality AS y, 4e-1 * l.quality + 6e-1 * ((l.doc_id * 7919) % 1000) / 1e3 AS p,
    d.lang AS state, d.source AS generator, d.n_chars AS size, l.toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
