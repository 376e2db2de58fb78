"""Scans within keys beside plain loops, where one key holds a third of a million rows."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.operators import evaluation as E
from glintframe.operators import scan
from glintframe.streaming import jobs

ROWS = 1_000_000


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """(key, at, x): key 0 has a third of the rows; every seventh has the same ``at``, some none."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)) + 1)
    at = F.when(F.col("id") % 7 == 0, F.lit(500)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000_000)))
    into = str(tmp_path_factory.mktemp("hot") / "rows")
    spark.range(ROWS).select(key.alias("key"), at.cast("long").alias("at"), "id", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)).cast("int").alias("x")).write.parquet(into)
    return spark.read.parquet(into)


def test_pieces_are_bounded_and_in_order(hot):
    pieces = scan.cut(hot, ["key"], F.col("at"), F.col("id"), "piece", 20_000)
    sizes = {(r.key, r.piece): r["count"] for r in pieces.groupBy("key", "piece").count().collect()}
    assert sum(sizes.values()) == ROWS and max(sizes.values()) < 40_000 and sum(k == 0 for k, _ in sizes) >= 10
    assert {p for k, p in sizes if k != 0} == {0}
    ends = pieces.where("key = 0").groupBy("piece").agg(F.min(F.coalesce("at", F.lit(-1))).alias("low"), F.max(F.coalesce("at", F.lit(-1))).alias("high")).orderBy("piece").collect()
    assert all(a.high <= b.low for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_and_sums(hot, descending):
    found = scan.carried(hot, ["key"], F.col("at"), F.col("id"), {"place": F.lit(1).cast("long"), "sum": F.col("x").cast("long")}, 20_000, descending)
    rows = found.select("key", "at", "id", "x", "place", "sum", scan.place(F.col("id")).alias("tie")).toPandas()
    assert len(rows) == ROWS
    rows["at"] = rows["at"].fillna(-1)
    rows = rows.sort_values(["key", "at", "tie", "id"], ascending=not descending, kind="stable")
    assert (rows["place"] == rows.groupby("key").cumcount() + 1).all()
    assert (rows["sum"] == rows.groupby("key")["x"].cumsum()).all()


def test_moving_averages(hot):
    found = {r.key: r for r in scan.moving_average(hot, ["key"], F.col("at"), F.col("id"), F.col("x"), 0.1, 0.5, 20_000).collect()}
    rows = hot.select("key", "at", "id", "x", scan.place(F.col("id")).alias("tie")).where("key < 20").toPandas()
    rows["at"] = rows["at"].fillna(-1)
    for key, own in rows.sort_values(["at", "tie", "id"]).groupby("key"):
        value = 0.5
        for x in own["x"]:
            value = 0.1 * x + 0.9 * value
        assert found[key].average == pytest.approx(value) and (found[key].n, found[key].total) == (len(own), own["x"].sum())


def test_auc_of_a_hot_slice(hot):
    p = ((F.col("id") * 7919 + F.col("x") * 300_000) % ROWS) / F.lit(float(ROWS))
    df = hot.select(F.when(F.col("key") > 0, F.concat(F.lit("g"), F.col("key") % 3)).otherwise(F.lit(None)).alias("slice"), p.alias("p"), F.col("x").alias("y"))
    found = {r.slice: r.roc_auc for r in E.roc_auc_by(df, "slice").collect()}
    rows = df.toPandas()
    for name, own in rows.groupby(rows["slice"].fillna("unknown")):
        rank = own["p"].rank()
        n1 = int(own["y"].sum())
        want = (rank[own["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(own) - n1))
        assert found[name] == pytest.approx(want)


def test_hard_rows(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, None, 3), (1, 5, 1), (1, 5, 1), (1, None, None)], "key int, at int, scan__piece int")
    found = scan.ranked(df, ["key"], F.col("at"), F.col("scan__piece"), "place", 1)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 1, 2, 2), (None, None, 3, 1), (1, 5, 1, 2), (1, 5, 1, 3), (1, None, None, 1)], key=str)
    assert scan.ranked(df.where("false"), ["key"], F.col("at"), F.col("at"), "place").collect() == []
    assert scan.moving_average(df.where("false"), ["key"], F.col("at"), F.col("at"), F.col("at"), 0.1, 0.5).collect() == []


def test_streamed_averages_go_on(spark, tmp_path):
    """Batches in order give what one loop gives; a batch done again changes nothing."""
    rng = np.random.default_rng(1)
    folder, into, at = (f"{tmp_path}/{n}" for n in ("in", "out", "at"))
    value, seen = {}, {}
    for part in range(3):
        rows = [(int(rng.integers(0, 4)), part * 1000 + i, int(rng.integers(0, 2))) for i in range(200)]
        spark.createDataFrame(rows, "user int, at int, hit int").repartition(3).write.mode("append").parquet(folder)
        jobs.moving_averages(jobs.arrivals(spark, folder, "user int, at int, hit int"), into, at, "user", "at", "hit").awaitTermination()
        for user, _, hit in rows:
            value[user], seen[user] = 0.1 * hit + 0.9 * value.get(user, 0.5), seen.get(user, 0) + 1
        found = {r.user: (r.accuracy, r.n) for r in jobs.last_batch(spark, into).collect()}
        assert {u: n for u, (_, n) in found.items()} == seen and all(found[u][0] == pytest.approx(value[u]) for u in value)
    assert jobs.batch_before(spark, into, 0) is None and jobs.batch_before(spark, into, 3).count() == len(seen)


def test_a_buffer_that_drops_its_oldest(spark, tmp_path):
    rng = np.random.default_rng(6)
    folder, into, at = (f"{tmp_path}/{n}" for n in ("in", "out", "at"))
    buffer, place, figures = [], 0, []
    for size in (1500, 1, 700, 4000, 3):
        values = [float(x) for x in rng.integers(0, 1000, size)]
        spark.createDataFrame([(place + i, v) for i, v in enumerate(values)], "at long, ms double").repartition(4).write.mode("append").parquet(folder)
        place += size
        for v in values:
            buffer.append(v)
            if len(buffer) > 2000:
                del buffer[:1000]
        own, n = sorted(buffer), len(buffer)
        figures.append((place, n, own[n // 2], own[min(n - 1, int(n * 0.95))], own[min(n - 1, int(n * 0.99))]))
        jobs.sample_figures(jobs.arrivals(spark, folder, "at long, ms double"), into, at, "at", "ms").awaitTermination()
        assert tuple(jobs.last_batch(spark, f"{into}/figures").select("total", "n", "p50", "p95", "p99").first()) == figures[-1]
    assert spark.read.parquet(f"{into}/figures").count() == len(figures)


def test_progress_and_memory_from_spark(spark, tmp_path):
    from glintframe.streaming import watch

    folder, into, told, at = (f"{tmp_path}/{n}" for n in ("in", "out", "told", "at"))
    for part in range(3):
        spark.createDataFrame([(part * 10 + i, "x" * (400 if i == 1 else 5)) for i in range(10)], "id long, text string").coalesce(1).write.mode("append").parquet(folder)
    listener = watch.Progress(spark, told)
    spark.streams.addListener(listener)
    stream = jobs.outcomes(jobs.arrivals(spark, folder, "id long, text string", 1), F.when(F.length("text") > 300, "too long"), {"size": F.length("text")})
    query = jobs.run_job(watch.counted(stream, F.col("status") == "error"), into, at)
    assert jobs.poll(query)
    for _ in range(100):
        if str(query.id) in listener.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    rows = [(r.batch, r.rows, r.failed, r.total, r.total_failed) for r in watch.progress_rows(spark, told).orderBy("batch").collect()]
    assert rows == [(b, 10, 1, 10 * (b + 1), b + 1) for b in range(3)]
    assert set(watch.tasks_done(spark)) == {"done", "failed", "all"}
    peaks = watch.peak_memory(spark)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory() / 2**20
    assert peaks and all(0 < e["heap_mb"] <= heap and e["total_mb"] >= e["heap_mb"] for e in peaks)
    report = watch.with_peak_memory(spark.createDataFrame([("overall", "", "n", 3.0)], "part string, key string, metric string, value double"))
    assert report.count() == 2 and watch.memory_gate(report, 1e6).first().ok and not watch.memory_gate(report, 1).first().ok
