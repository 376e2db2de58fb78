"""Centroids of clusters kept as state while vectors arrive.

The state of a cluster's shard is a typed value (sum, count, version); a vector counts once, however often its id arrives, and whenever it does.
Shards spread a large cluster over tasks.  After each batch the changed shards are put in a ``Snapshots`` table, which readers can open at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glintframe.sources.snapshots import Snapshots

#: Parts that a cluster's vectors are dealt to.
SHARDS = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sums(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "total array<double>, n long, version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        total, n, version = self.state.get() if self.state.exists() else (None, 0, 0)
        total = None if total is None else np.asarray(total, float)
        cluster = None
        for frame in rows:
            if len(frame):
                cluster = frame["cluster"].iloc[0]
                own = np.stack(frame["vector"].tolist()).astype(float).sum(axis=0)
                total, n = own if total is None else total + own, n + len(frame)
        if total is None:
            return
        self.state.update((total.tolist(), int(n), int(version) + 1))
        yield pd.DataFrame({"cluster": [None if pd.isna(cluster) else cluster], "shard": [key[1]], "total": [total.tolist()], "n": [int(n)], "changes": [int(version) + 1]})

    def close(self) -> None:
        pass


def store(spark: SparkSession, root: str, kind: str = "long") -> Snapshots:
    return Snapshots(spark, root, ["cluster", "shard"], f"cluster {kind}, shard int, total array<double>, n long, changes long", 16)


def keep(stream: DataFrame, root: str, checkpoint: str, id_col: str, by: str, vector: str) -> StreamingQuery:
    """Runs over what has arrived; called again with its checkpoint it goes on.  Rows without a vector or of another length than the rest aren't for it: check first."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = stream.schema[by].dataType.simpleString()
    table = store(spark, root, kind)
    rows = stream.select(F.col(id_col).alias("id"), F.col(by).alias("cluster"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    rows = rows.dropDuplicates(["id"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int"))
    # A state's key can't hold null: the cluster as text can.
    rows = rows.withColumn("name", F.to_json(F.struct("cluster")))
    sums = rows.groupBy("name", "shard").transformWithStateInPandas(
        statefulProcessor=Sums(), outputStructType=f"cluster {kind}, shard int, total array<double>, n long, changes long", outputMode="append", timeMode="none"
    )

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, F.col("changes"))

    return sums.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(table: Snapshots) -> DataFrame:
    """(cluster, centroid, n) as far as vectors have come."""
    parts = table.read()
    long = parts.select("cluster", F.posexplode("total").alias("pos", "x"))
    sums = long.groupBy("cluster", "pos").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("sums"))
    n = parts.groupBy(F.col("cluster").alias("n__cluster")).agg(F.sum("n").alias("n"))
    joined = sums.join(n, F.col("cluster").eqNullSafe(F.col("n__cluster")))
    return joined.select("cluster", F.transform("sums", lambda s: s["x"] / F.col("n")).alias("centroid"), "n")
