"""What keeps the analysis of many files whole and quick: small groups of files, plain windows for masks, fits beside each other."""

from __future__ import annotations

import threading

import numpy as np

from glintframe.functions import codecs
from glintframe.operators import arbiter as A
from glintframe.operators import models as M
from glintframe.operators import planes as P
from glintframe.sources import contents


def test_many_small_files_are_many_groups(spark, tmp_path):
    image = codecs.encode(np.zeros((8, 8, 3), np.uint8))
    for i in range(600):
        (tmp_path / f"{i}.png").write_bytes(image)
    found = contents.images(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == -(-600 // contents.MANY) > 1
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == sorted(f"{i}.png" for i in range(600))


def test_masks_beside_windows(spark):
    """One axis after the other gives what each pixel's whole square gives; regions keep their areas."""
    rng = np.random.default_rng(4)
    for k in range(40):
        mask = rng.random((int(rng.integers(3, 40)), int(rng.integers(3, 40)))) < rng.uniform(0.05, 0.95)
        by = k % 3 + 1
        windows = lambda m, by: np.lib.stride_tricks.sliding_window_view(np.pad(m, by), (2 * by + 1, 2 * by + 1))
        assert (A.around(np.logical_or, mask, by, False) == windows(mask, by).any(axis=(2, 3))).all()
        number = rng.integers(0, 99, mask.shape)
        assert (A.around(np.minimum, number, 1, 99) == np.lib.stride_tricks.sliding_window_view(np.pad(number, 1, constant_values=99), (3, 3)).min(axis=(2, 3))).all()
    block = np.zeros((20, 20), bool)
    block[2:9, 3:13] = block[12:18, 12:18] = True
    assert sorted(A.regions(block)) == [25, 54] and A.regions(np.zeros((5, 5), bool)) == []


def test_tiles_beside_a_fit_of_each(spark):
    """Slope and flatness of a tile's spectrum, tile by tile."""
    plane = np.random.default_rng(6).random((1, 64, 64))
    found = P.FAMILIES["tiles"].work(plane)
    r = np.hypot(*np.ogrid[:16, :9])
    edges = np.logspace(0.0, np.log10(r.max() + 1.0), 13) - 1.0
    edges[0] = 0.0
    bins = np.clip(np.searchsorted(edges, r, side="right") - 1, 0, 11)
    for k in range(16):
        tile = plane[0, k // 4 * 16 : k // 4 * 16 + 16, k % 4 * 16 : k % 4 * 16 + 16]
        size = np.abs(np.fft.rfft2(tile - tile.mean()))
        points = [(r[bins == b].mean(), size[bins == b].mean()) for b in range(12) if (bins == b).any()]
        x, y = np.array([p for p in points if p[0] > 2.0]).T
        power = size[r > 2.0] ** 2
        assert np.isclose(found["slope"][0, k], np.polyfit(np.log(x), np.log(y), 1)[0]) and np.isclose(found["flatness"][0, k], np.exp(np.log(power).mean()) / power.mean())


def test_fits_run_beside_each_other(spark):
    """Each of the works waits for the other one: in a row they would never end."""
    both = threading.Barrier(2, timeout=60)
    spark.sparkContext.setLocalProperty("own", "x")

    def work(k: int) -> tuple[int, str, int]:
        both.wait()
        return k, spark.sparkContext.getLocalProperty("own"), spark.range(k).count()

    assert M.at_once(spark, [lambda: work(1), lambda: work(2)]) == [(1, "x", 1), (2, "x", 2)]
