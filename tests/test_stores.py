"""Snapshot tables, and centroids kept as state: arrivals one after the other, repeated, late, stopped and resumed."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.sources.snapshots import Conflict, Snapshots
from glintframe.streaming import centroids, jobs

SCHEMA = "id long, name string, x int"


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("id", "name", "x", "version").collect()), key=str)


def test_upserts_like_a_dictionary(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, 8)
    assert table.versions() == [] and table.read().count() == 0
    held: dict = {}
    rng = np.random.default_rng(2)
    history = []
    for step in range(4):
        new = [(int(i) if i else None, f"s{step}", int(k)) for k, i in enumerate(rng.integers(0, 12, 9))]
        assert table.upsert(spark.createDataFrame(new, SCHEMA), F.col("x")) == step + 1
        for i, name, x in new:
            held[i] = (i, name, x, held.get(i, (0, 0, 0, 0))[3] + 1)
        history.append(sorted(held.values(), key=str))
        assert rows(table.read()) == history[-1]
    assert [rows(table.read(v)) for v in table.versions()] == history
    gone = spark.createDataFrame([(None,), (3,), (99,)], "id long")
    table.delete(gone)
    held.pop(None, None), held.pop(3, None)
    assert rows(table.read()) == sorted(held.values(), key=str)
    table.vacuum(1)
    assert table.versions() == [5] and rows(table.read()) == sorted(held.values(), key=str)
    table.upsert(spark.createDataFrame([(3, "again", 1)], SCHEMA))
    assert (3, "again", 1, 1) in rows(table.read())


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, 16)
    table.upsert(spark.range(1000).select("id", F.lit("a").alias("name"), F.lit(1).alias("x")))
    first = table.manifest()["folders"]
    table.upsert(spark.createDataFrame([(7, "b", 2)], SCHEMA))
    second = table.manifest()["folders"]
    assert len(first) == len(second) == 16 and sum(first[b] != second[b] for b in first) == 1


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = Snapshots(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, 4)
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA))
    reader = table.read()

    def die(manifest: dict) -> None:
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([(1, "z", 9), (5, "z", 9)], SCHEMA))
    monkeypatch.undo()
    assert rows(table.read()) == rows(reader) == [(1, "a", 1, 1), (2, "b", 1, 1)]
    table.vacuum(1)
    assert rows(table.read()) == [(1, "a", 1, 1), (2, "b", 1, 1)] and len(os.listdir(tmp_path / "t" / "data")) == 1
    assert table.upsert(spark.createDataFrame([(1, "c", 3)], SCHEMA)) == 2 and rows(reader) == [(1, "a", 1, 1), (2, "b", 1, 1)]


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    table, other = (Snapshots(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, 4) for _ in range(2))
    table.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    stale = other.manifest()
    table.upsert(spark.createDataFrame([(1, "b", 2)], SCHEMA))
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(Conflict):
        other.upsert(spark.createDataFrame([(1, "c", 3)], SCHEMA))
    assert rows(table.read()) == [(1, "b", 2, 2)]
    with pytest.raises(ValueError, match="buckets"):
        Snapshots(spark, f"file://{tmp_path}/t", ["id"], SCHEMA, 5).read()


def test_centroids_of_three_arrivals(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = {i: (None if i % 50 == 0 else int(i % 3 if i % 4 else 0), rng.normal(size=5).tolist()) for i in range(300)}
    folder, root, at = f"{tmp_path}/in", f"file://{tmp_path}/store", f"{tmp_path}/at"
    schema = "id long, label long, embedding array<double>"
    parts = [range(200, 300), range(100), [*range(50, 100), *range(100, 200)]]  # the oldest come late, some of them twice
    seen: set = set()
    for part in parts:
        spark.createDataFrame([(i, *vectors[i]) for i in part], schema).repartition(3).write.mode("append").parquet(folder)
        centroids.keep(jobs.arrivals(spark, folder, schema, 2), root, at, "id", "label", "embedding").awaitTermination()
        seen |= set(part)
        found = {r.cluster: r for r in centroids.read(centroids.store(spark, root)).collect()}
        for label in {vectors[i][0] for i in seen}:
            own = np.array([vectors[i][1] for i in seen if vectors[i][0] == label])
            assert found[label].n == len(own) and np.allclose(found[label].centroid, own.mean(axis=0))
        assert len(found) == len({vectors[i][0] for i in seen})


def test_an_index_of_hashes_keeps_first(spark, tmp_path):
    """Arrivals one by one give what one pass over all of them gives; only touched buckets are opened."""
    from glintframe.session import with_checkpoints
    from glintframe.sources.hash_index import HashIndex

    with_checkpoints(spark)
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 60)]
    hashes = []
    for i in range(400):
        h = base[int(rng.integers(0, 60))]
        for b in rng.choice(64, int(rng.integers(0, 8)), replace=False):
            h ^= 1 << int(b)
        hashes.append((i, (h + 2**63) % 2**64 - 2**63))
    kept: list[tuple[int, int]] = []
    for i, h in hashes:
        if all(bin((h ^ own) & (2**64 - 1)).count("1") > 4 for _, own in kept):
            kept.append((i, h))
    index = HashIndex(spark, f"file://{tmp_path}/index", buckets=512)
    for first, last in ((0, 150), (150, 151), (151, 400)):
        index.add(spark.createDataFrame([*hashes[first:last], (None, 5), (900 + first, None)], "name long, h long"), "name", "h")
    assert sorted(map(tuple, index.rows().collect())) == kept
    one = spark.createDataFrame(hashes[:1], "id long, hash long")
    assert len(index.table.touched(one.select("id", "hash", F.explode(F.array(*[F.struct(F.lit(0).alias("place"), F.lit(3).cast("long").alias("bits"))])).alias("s")).select("s.*")).inputFiles()) <= 5
    assert {r.kept for r in index.near(one).collect()} >= {0}
