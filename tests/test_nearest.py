"""Neighbours of more queries than a block holds."""

from __future__ import annotations

import random

import pytest

from glintframe.operators import embeddings as B
from glintframe.operators import radius
from glintframe.session import with_checkpoints


@pytest.mark.parametrize("count,block", [(600, 50), (10_100, B.QUERY_BLOCK)])
def test_more_queries_than_a_block(spark, count, block):
    with_checkpoints(spark)
    rng = random.Random(9)
    base = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(600)}
    asked = {i: base[i % 600] for i in range(count)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): r.neighbour_id for r in B.nearest(frame(base), frame(asked), k=3, **({} if block == B.QUERY_BLOCK else {"block": block})).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    assert len(found) == 3 * count
    for q in range(0, count, 97):
        best = sorted(base, key=lambda i: (-sum(x * y for x, y in zip(asked[q], base[i])) / norm(asked[q]) / norm(base[i]), i))[:3]
        assert [found[q, n] for n in (1, 2, 3)] == best


def test_rings_that_meet_are_not_shuffled(spark):
    """Rows of one ball, where no two rings can be told apart: what is sent for counting doesn't grow with the pairs of rings."""
    with_checkpoints(spark)
    rng = random.Random(4)
    base = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(500)}
    df = spark.createDataFrame(list(base.items()), "vec_id long, embedding array<double>")
    blocks, centres = radius.rings(df, "vec_id", "embedding", pivots=4, ring=16)
    assert blocks.count() > 30
    near = {i: sum(j != i and sum((x - y) ** 2 for x, y in zip(base[i], base[j])) < 1 for j in base) for i in base}
    sent = []
    own = type(df).mapInArrow

    def seen(df, work, schema, *more):
        sent.append(df._jdf.queryExecution().optimizedPlan().toString())
        return own(df, work, schema, *more)

    for at_once in (None, 3000):  # in one group of rings, and in some
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(type(df), "mapInArrow", seen)
            found = {r.id: r.near for r in radius.counts(blocks, centres, 1.0, at_once).collect()}
        assert found == {i: n for i, n in near.items() if n}
        assert len(sent) == (1 if at_once is None else 4)
        assert all(p.count("strategy=broadcast") == 2 for p in sent)
        sent.clear()
    some = df.where("vec_id % 9 = 0").selectExpr("vec_id AS id")
    pairs = [tuple(r) for r in radius.pairs(blocks, centres, 1.0, some, 3000).collect()]
    assert len(pairs) == len(set(pairs)) == sum(near[i] for i in base if i % 9 == 0)
