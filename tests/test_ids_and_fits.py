"""Ids that follow on over sampled ranges; fits that read what they were given once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.operators import embeddings, kernels, models, planes, verdict
from glintframe.plans import models as plans_models
from glintframe.session import with_checkpoints
from glintframe.sources import stores


def test_ids_follow_the_order_where_ranges_are_sampled(spark):
    rows = spark.range(0, 100_000, numPartitions=8).select((F.col("id") * 7919 % 100_003).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    found = stores.with_ids(rows, "at", 5).select("id", "at", "text").toPandas().sort_values("at")
    assert list(found["id"]) == list(range(6, 100_006))


def test_fits_compute_their_rows_once(spark):
    """However many fits, folds and figures: what rows are made of is computed once a row."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def made(i):
        seen.add(1)
        return [float(i % 7), float(i % 2) + i % 5]

    rows = spark.range(0, 60, numPartitions=2).select("id", (F.col("id") % 2).cast("int").alias("y"), made("id").alias("features"))
    tiny = models.Config(trees=2, tree_depth=2, boosts=1, boost_depth=2, waves=4, iterations=3)
    figures = models.fold_metrics(models.out_of_fold(rows, tiny, k=2)).first()
    assert (figures.n_fake, figures.n_real, seen.value) == (30, 30, 60)
    assert models.ablation(rows, ["fft_a", "fft_b"], tiny).count() == 1
    assert seen.value == 120


def test_contributions_rank_the_features_within_a_row(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 3), -3.0, 3.0, 0.5]) for i in range(40)], "id long, y int, features array<double>")
    ensemble = models.fit(rows, models.Config(trees=2, tree_depth=2, boosts=1, boost_depth=2, waves=4, iterations=3))
    found = models.contributions(ensemble, rows, "id", probe=2, keep=2)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1  # that of the deltas; vectors aren't moved
    assert {(r["feature"], r["value"]) for r in found.collect()} == {(1, -3.0), (2, 3.0)}


def test_contributions_of_every_feature(spark, tmp_path, monkeypatch):
    """The query has a row for each feature of each document, as scoring without one feature after the other has."""
    texts = [None, "", "the same", "the same", *[f"Word {i}, " * (i % 5 + 1) + "12\n" * (i % 3) + "END. " * (i % 4) for i in range(56)]]
    spark.createDataFrame([(i, t, ("en", "de")[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i * 7 % 3 % 2) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    fitted = []
    keep = models.fit
    monkeypatch.setattr(models, "fit", lambda *a: fitted.append(keep(*a)) or fitted[-1])
    monkeypatch.setattr(plans_models, "SMALL", models.Config(trees=2, tree_depth=3, boosts=2, boost_depth=2, waves=4, iterations=5))
    found = plans_models.feature_contributions(spark, str(tmp_path)).collect()
    rows = plans_models.featured(spark, str(tmp_path))
    score = lambda zeroed: {r["id"]: sum(r["members"]) / 4 for r in fitted[0].members(rows.withColumn("features", zeroed)).collect()}
    base, vectors = score(F.col("features")), {r["id"]: r["features"] for r in rows.collect()}
    want = {}
    for at in range(8):
        less = score(F.transform("features", lambda x, i: F.when(i == at, F.lit(0.0)).otherwise(x)))  # noqa: B023
        want |= {(i, at): (vectors[i][at], base[i] - less[i]) for i in base}
    assert len(found) == len(want) == 8 * len(texts)
    assert {(r["id"], r["feature"]): r["value"] for r in found} == {k: v for k, (v, _) in want.items()}
    assert {(r["id"], r["feature"]): r["delta"] for r in found} == pytest.approx({k: d for k, (_, d) in want.items()}, abs=1e-12)
    for i in base:
        own = sorted((r for r in found if r["id"] == i), key=lambda r: (-r["delta"], r["feature"]))
        assert [r["place"] for r in own] == list(range(1, 9))


def test_contributions_have_either_limit_alone(spark):
    rows = [(1, f, v, d) for f, (v, d) in enumerate([(9.0, 0.1), (-8.0, -0.4), (1.0, 0.3), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "id long, feature int, value double, delta double")
    told = lambda **limits: [(r["feature"], r["place"]) for r in verdict.contributions(df, "id", **limits).orderBy("place").collect()]
    assert told(probe=None, keep=None) == [(2, 1), (0, 2), (3, 3), (1, 4)]
    assert told(probe=2, keep=None) == [(0, 1), (1, 2)]
    assert told(probe=None, keep=2) == [(2, 1), (1, 2)]


def test_each_feature_is_computed_once(spark):
    """What makes a feature finite uses its value, not its expression four times over."""
    images = spark.createDataFrame([(1, bytes(192), 8, 8, 3)], "id long, pixels binary, height int, width int, channels int")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        plan = planes.extract(images, 64)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count(".coherence") == 1


@pytest.mark.parametrize("at_once", [300, 10**7])
def test_clusters_over_stretches_of_ids(spark, at_once):
    """Dense vectors, where every row is within two steps of nearly all: few jobs, and the loop's clusters."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 3))
    spark.sparkContext.setCheckpointDir(with_checkpoints(spark))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    near = ((v[:, None] - v[None]) ** 2).sum(axis=2) < 0.7**2
    free, want = set(range(len(v))), set()
    for i in range(len(v)):
        own = [int(j) for j in np.flatnonzero(near[i]) if j in free]
        if i in free and len(own) >= 5:
            want |= {(i, j) for j in own}
            free -= set(own)
    assert len({s for s, _ in want}) > 10
    tracker, group = spark.sparkContext.statusTracker(), f"stretches-{at_once}"
    spark.sparkContext.setJobGroup(group, group)
    found = {tuple(r) for r in embeddings.unknown_clusters(df, 0.7, 5, **({} if at_once == 10**7 else {"at_once": at_once})).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == want
    assert at_once == 300 or len(tracker.getJobIdsForGroup(group)) < 60


def test_jpeg_history_takes_the_transform_once_a_row(spark):
    """The picked coefficients are no lambda over places in which the whole transform stands."""
    df = spark.createDataFrame([(1, [float(i % 9) for i in range(64)]), (1, [float(i % 5) for i in range(64)])], "label int, embedding array<double>")
    found = kernels.jpeg_history(df, "label", "embedding")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert "lambdafunction(transform(array(" not in plan and found.count() == 1
