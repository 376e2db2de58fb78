"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Paths of scratch tables; a block of ``collected()`` has a list of its own.
_made: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a folder of this machine only where the machine is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "glintframe-shared")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends or by ``delete``."""
    path = f"{shared_dir(spark)}/glintframe/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    for path in paths:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may have gone first; the folder is scratch space
            pass
        for own in _made:
            if path in own:
                own.remove(path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The scratch paths made inside, so that the caller can delete them when what was built on them has been written."""
    own: list[str] = []
    _made.append(own)
    try:
        yield own
    finally:
        _made.pop()
        _made[0].extend(own)


@atexit.register
def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        delete(spark, *[p for own in _made for p in own])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed inside, and as they were after; ones that weren't set at all are unset."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession):
    """Fewer rows at a time in readers' and Python's batches: whole texts, some of them very long, then take little memory."""
    return settings(spark, SMALL_BATCHES)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table written in the shared folder and reread: lineage ends here, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote; nothing built on these tables may still be waiting to run."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does the same, and faster, where all is ASCII."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
