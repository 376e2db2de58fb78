"""Sessions with the settings that the operators count on."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "glintframe", master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a folder of this machine only where the machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "glintframe-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def with_checkpoints(spark: SparkSession) -> str:
    """Makes sure that ``checkpoint()`` has a folder, and tells it."""
    return shared_dir(spark)


#: Paths that are deleted when the driver ends.
_made: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written in the shared folder and reread, so that what is built on it computes it once."""
    into = workspace(df.sparkSession, name)
    df.write.parquet(into)
    return df.sparkSession.read.schema(df.schema).parquet(into)


@atexit.register
def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm if spark is not None else None
    if jvm is None or spark.sparkContext._jsc is None:
        return
    for path in _made:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may have gone first; the folder is scratch space
            pass
