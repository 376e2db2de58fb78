"""What Spark itself knows of a job: rows done and failed while it runs, and the memory that executors needed at most."""

from __future__ import annotations

import json
import threading
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The name that a job's counts have among the observed metrics.
COUNTS = "outcomes"
#: Peaks that make up a process, as Spark names them.
PEAKS = ("JVMHeapMemory", "JVMOffHeapMemory", "DirectPoolMemory", "ProcessTreePythonRSSMemory")


def counted(rows: DataFrame, failed: Column, name: str | Observation = COUNTS) -> DataFrame:
    """``rows``, whose number, and that of the failed ones, Spark counts as they pass: no second pass over them."""
    return rows.observe(name, F.count("*").alias("rows"), F.coalesce(F.sum(failed.cast("long")), F.lit(0).cast("long")).alias("failed"))


class Progress(StreamingQueryListener):
    """Writes a row for each batch of each query (query, batch, rows, failed, total, total_failed) as soon as it is done; ``into`` is a folder."""

    def __init__(self, spark: SparkSession, into: str) -> None:
        self.spark, self.into, self.lock = spark, into, threading.Lock()
        self.totals: dict[str, list[int]] = {}
        self.seen: list[dict[str, Any]] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event: Any) -> None:
        with self.lock:
            self.totals.setdefault(str(event.id), [0, 0])

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        found = p.observedMetrics.get(COUNTS) if p.observedMetrics else None
        rows, failed = (found.rows, found.failed) if found else (p.numInputRows, 0)
        with self.lock:
            total = self.totals.setdefault(str(p.id), [0, 0])
            total[0], total[1] = total[0] + rows, total[1] + failed
            row = {"query": str(p.id), "batch": p.batchId, "rows": rows, "failed": failed, "total": total[0], "total_failed": total[1]}
            self.seen.append(row)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.into}/{p.id}-{p.batchId:09d}.json")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        with self.lock:
            self.ended.add(str(event.id))


def progress_rows(spark: SparkSession, into: str) -> DataFrame:
    """What a ``Progress`` has written so far; any session can look."""
    return spark.read.schema("query string, batch long, rows long, failed long, total long, total_failed long").json(into)


def tasks_done(spark: SparkSession) -> dict[str, int]:
    """Tasks of the stages that run just now: done, failed, all."""
    tracker = spark.sparkContext.statusTracker()
    infos = [i for i in (tracker.getStageInfo(s) for s in tracker.getActiveStageIds()) if i]
    return {"done": sum(i.numCompletedTasks for i in infos), "failed": sum(i.numFailedTasks for i in infos), "all": sum(i.numTasks for i in infos)}


def peak_memory(spark: SparkSession) -> list[dict[str, Any]]:
    """(executor, heap_mb, total_mb) of each executor so far, as its heartbeats told; the driver is one in local mode.

    total_mb has off-heap and direct memory too, and Python workers where spark.executor.processTreeMetrics.enabled is set.
    """
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    out = []
    for i in range(found.size()):
        one = found.apply(i)
        peaks = one.peakMemoryMetrics()
        values = [peaks.get().getMetricValue(name) if peaks.isDefined() else 0 for name in PEAKS]
        heap = values[0]
        if not heap and one.id() == "driver":  # before the first heartbeat
            pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
            heap = pools.getHeapMemoryUsage().getUsed()
            values[0] = heap
        out.append({"executor": one.id(), "heap_mb": heap / 2**20, "total_mb": sum(max(v, 0) for v in values) / 2**20})
    return out


def with_peak_memory(report: DataFrame) -> DataFrame:
    """An evaluation's rows (part, key, metric, value), computed, and the greatest memory that an executor needed until they were."""
    spark = report.sparkSession
    rows = report.collect()  # a report: a few hundred rows
    most = max((e["total_mb"] for e in peak_memory(spark)), default=0.0)
    return spark.createDataFrame([*map(tuple, rows), ("system", "", "peak_memory_mb", float(most))], report.schema)


def memory_gate(report: DataFrame, most_mb: float) -> DataFrame:
    """Whether the report's peak is below the bound: (peak_memory_mb, allowed, ok)."""
    peak = report.where("metric = 'peak_memory_mb'").select(F.col("value").alias("peak_memory_mb"))
    return peak.withColumns({"allowed": F.lit(float(most_mb)), "ok": F.col("peak_memory_mb") < most_mb})
