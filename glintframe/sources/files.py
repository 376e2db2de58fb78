"""Manifests as CSV with dead letters, and files as bytes.

A manifest is read with its own header, every column as text, so that a bad value costs its row
and not the job: rows that can't be used come back as dead letters with the reason.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators.manifest import EXTENSIONS, REQUIRED

#: Fixed value: bytes beyond which an image is refused.
MOST_BYTES = 25 * 1024 * 1024


class ManifestError(ValueError):
    """A manifest that can't be used as a whole."""


def rows_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header; every column as text, fields may hold line ends and quotes."""
    return spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """``df`` with a header; ``files`` only for results known to be small."""
    (df if files is None else df.coalesce(files)).write.options(header=True, escape='"', nullValue="").csv(path)


def manifest_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a manifest with path and label, and its dead letters with a ``reason``.

    A missing file, or a file without the required columns, is an error.
    """
    try:
        rows = rows_csv(spark, path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" in str(why):
            raise FileNotFoundError(f"manifest not found: {path}") from why
        raise
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ManifestError(f"manifest lacks columns {missing}")
    label = F.expr("try_cast(trim(label) AS double)").cast("int")
    reason = (
        F.when(F.col("image_path").isNull() | (F.col("image_path") == ""), "no path").when(F.col("label").isNull() | (F.col("label") == ""), "no label")
        .when(label.isNull(), "label is no number").when(~label.isin(0, 1), "label is neither 0 nor 1")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason").withColumn("label", label), judged.where("reason IS NOT NULL")


def require_two_classes(rows: DataFrame) -> DataFrame:
    """``rows``, or an error if their labels aren't both 0 and 1."""
    found = {r[0] for r in rows.select("label").distinct().limit(3).collect()}
    if found != {0, 1}:
        raise ManifestError("a manifest needs rows of label 0 and of label 1, and no others")
    return rows


def files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files below ``root``, in all its folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Files with an image's extension, whatever its case; sort by path for the order of a scan."""
    ending = "{" + ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS) + "}"
    return files(spark, root, ending)


def load_error(length: Column) -> Column:
    """Why bytes are no loadable image, or null."""
    return F.when(length.isNull() | (length == 0), "empty file").when(length > MOST_BYTES, "file is too large")


def decoded(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Images as (path, height, width, channels, pixels: blue-green-red bytes), and dead letters (path, reason).

    The JVM decodes them where they are read.
    """
    scan = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False)
    found = scan.load(root).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
    found = found.withColumnRenamed("origin", "path")
    broken = found.where("height < 0").select("path", F.lit("no image that can be decoded").alias("reason"))
    return found.where("height >= 0"), broken


def checksums(content: DataFrame, pins: DataFrame) -> DataFrame:
    """Files (path, content) beside their pinned SHA-256 (path, sha256): ok, changed, unpinned, or missing."""
    found = content.select("path", F.sha2("content", 256).alias("found"))
    both = found.join(pins, "path", "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unpinned").when(F.col("found") == F.lower("sha256"), "ok").otherwise("changed")
    return both.select("path", "found", state.alias("state"))
