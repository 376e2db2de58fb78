"""The pass that makes features: whole vectors leave it, and its shortcuts give what the plain forms give."""

from __future__ import annotations

import numpy as np
import pytest

from glintframe.functions import signal as S
from glintframe.operators import planes as P
from glintframe.plans import planes as plans


def test_only_the_vector_leaves_the_pass(spark, sf):
    """No sums and histograms come back to be folded number by number: beside the rows' own columns there is one array."""
    parts = P.measured(plans.labelled(spark, sf), P.VECTOR, plans.SIDE, "augmented", "id")
    assert [f.simpleString() for f in parts.schema if f.name.startswith("plane__")] == ["plane__vector:struct<values:array<double>,coherence:double>"]
    for query in (plans.training_matrix, plans.feature_vectors):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "lambda" not in plan


def test_short_forms(spark):
    rng = np.random.default_rng(5)
    planes = rng.integers(0, 256, (3, 21, 34)) / 255.0
    planes[1] = 0.25
    room = np.pad(planes, [(0, 0), (1, 1), (1, 1)], mode="edge")
    assert (S.median3(planes) == np.median([room[:, y : y + 21, x : x + 34] for y in range(3) for x in range(3)], axis=0)).all()
    line = np.exp(-(np.arange(-2, 3) ** 2) / 2)
    assert S.blurred(planes, 1.0, 5) == pytest.approx(S.stencil(planes, np.outer(line, line) / line.sum() ** 2, "reflect"), rel=1e-12)
    kernel = np.outer([1, 2, 1], [-1, 0, 1])
    for found, own in zip(S.slopes(planes), (kernel, kernel.T)):
        assert found == pytest.approx(S.stencil(planes, own, "reflect"), abs=1e-12)
    flat = rng.normal(0, 3, (4, 1000))
    assert S.moments(flat) == pytest.approx(np.stack([flat.mean(axis=1), *[((flat - flat.mean(axis=1, keepdims=True)) ** k).mean(axis=1) for k in (2, 3, 4)]], axis=1), rel=1e-9)


def test_texture_beside_the_matrix(spark):
    """Sums over unordered pairs are those over the symmetric matrix; a plane of one grey is alike in itself."""
    planes = np.stack([np.random.default_rng(1).integers(0, 256, (24, 30)) / 255.0, np.full((24, 30), 0.5)])
    found = P._texture(planes)["properties"]
    i, j = np.mgrid[:64, :64]
    for row, plane in enumerate(planes):
        grey, k = np.clip(plane * 64, 0, 63).astype(int), 0
        for d in (1, 2):
            for dy, dx in ((0, d), (d, d), (d, 0), (d, -d)):
                p = np.zeros((64, 64))
                for y in range(24 - dy):
                    for x in range(max(0, -dx), 30 - max(0, dx)):
                        a, b = grey[y, x], grey[y + dy, x + dx]
                        p[a, b] += 1
                        p[b, a] += 1
                p /= p.sum()
                mean, spread = (p * i).sum(), (p * (i - (p * i).sum()) ** 2).sum()
                alike = ((p * (i - mean) * (j - mean)).sum() / spread) if spread > 1e-15 else 1.0
                want = [(p * (i - j) ** 2).sum(), alike, np.sqrt((p**2).sum()), (p / (1 + (i - j) ** 2)).sum(), (p * abs(i - j)).sum()]
                assert found[row, :, k] == pytest.approx(want, rel=1e-9, abs=1e-12)
                k += 1


def test_vectors_of_odd_planes(spark):
    """Planes of other sizes in one frame, of one value, and too small for some families: each row is what it is alone."""
    rng = np.random.default_rng(2)
    rows = [(i, *[(rng.random(n * n) if i != 3 else np.full(n * n, 0.5)).tolist()] * 5) for i, n in enumerate((32, 48, 32, 32, 16, 48))] + [(6, *[None] * 5)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} array<double>" for c in P.PLANES)).coalesce(1)
    found = {r.id: r.features for r in P.extract(df).collect()}
    assert found[6] is None and all(len(found[i]) == 120 and np.isfinite(found[i]).all() for i in range(6))
    for i in range(6):
        n = int(len(rows[i][1]) ** 0.5)
        alone = P._vector(*[np.array(rows[i][1]).reshape(1, n, n)] * 5)["values"][0]
        for x, want, decimals in zip(found[i], alone, P.FEATURES.values()):
            assert x == pytest.approx(want, rel=1e-9, abs=1e-9 if decimals is None else 0.51 * 10**-decimals)


def test_wavelet_step_as_a_matrix(spark):
    """A product with the step's matrix is the filter along the mirrored axis."""
    low = np.array(S.DB4)
    high = low[::-1] * np.where(np.arange(8) % 2, 1.0, -1.0)
    for n in (8, 13, 64, 131):
        x = np.random.default_rng(n).random((2, 5, n))
        room = np.pad(x, [(0, 0), (0, 0), (7, 7)], mode="symmetric")
        for found, across, own in zip(S.halved(x, 2), S.halved(x.swapaxes(1, 2), 1), (low, high)):
            want = np.stack([room[..., 2 * k + 1 : 2 * k + 9] @ own[::-1] for k in range((n + 7) // 2)], axis=-1)
            assert found == pytest.approx(want, abs=1e-12) and across.swapaxes(1, 2) == pytest.approx(want, abs=1e-12)


def test_images_make_several_tasks_a_core(spark, sf):
    """A second wave of a few tasks leaves the other cores idle."""
    assert plans.labelled(spark, sf).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
