"""Image queries over whole tables beside plain numpy, image by image."""

from __future__ import annotations

import hashlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import signal as S
from glintframe.operators import planes as P
from glintframe.plans import planes as plans

SIDE = plans.SIDE


@pytest.fixture(scope="module")
def pixels(sf) -> dict[int, np.ndarray]:
    """(height, width, blue-green-red) of each page's bytes."""
    out = {}
    for i, html in duckdb.sql(f"SELECT page_id, html FROM read_parquet('{sf}/pages.parquet')").fetchall():
        data = (html or "").encode()
        w = max(8, int(np.ceil(np.sqrt(len(data) / 3))))
        h = max(8, -(-len(data) // (3 * w)))
        out[i] = np.frombuffer(data.ljust(3 * w * h, b"\0"), np.uint8).reshape(h, w, 3)
    return out


def plain_resized(plane: np.ndarray, nh: int, nw: int) -> np.ndarray:
    """Bilinear where it grows, means of areas where it shrinks, one axis after the other."""

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        for i in range(m):
            if m < n:
                low, high = i * n / m, (i + 1) * n / m
                for k in range(int(low), min(n, int(np.ceil(high)))):
                    out[i, k] = min(high, k + 1) - max(low, k)
            else:
                at = min(max((i + 0.5) * n / m - 0.5, 0.0), n - 1.0)
                k = min(int(at), n - 1)
                out[i, k] += 1 - (at - k)
                out[i, min(k + 1, n - 1)] += at - k
        return out / out.sum(axis=1, keepdims=True)

    return weights(plane.shape[0], nh) @ plane @ weights(plane.shape[1], nw).T


def plain_planes(image: np.ndarray, side: int) -> dict[str, np.ndarray]:
    h, w = image.shape[:2]
    scale = side / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    b, g, r = (np.zeros((side, side)) for _ in range(3))
    y, x = (side - nh) // 2, (side - nw) // 2
    for out, k in ((b, 0), (g, 1), (r, 2)):
        own = image[:, :, k].astype(float)
        out[y : y + nh, x : x + nw] = own if (nh, nw) == (h, w) else np.round(plain_resized(own, nh, nw))
    grey = np.round(0.299 * r + 0.587 * g + 0.114 * b)
    return {name: plane / 255 for name, plane in (("y", grey), ("gray", grey), ("red", r), ("green", g), ("blue", b))}


def test_planes(spark, sf, pixels):
    rows = plans.preprocessed_planes(spark, sf).collect()
    assert {r.id for r in rows} == set(pixels)
    for r in rows:
        want = plain_planes(pixels[r.id], 48)
        assert all(abs(r[c] - want[c].mean()) < 2e-3 for c in want)  # a step of grey where rounding is a tie


def test_features(spark, sf, pixels):
    """Each of the spectral, block and texture figures that a few lines of numpy give, over every page."""
    names = list(P.feature_columns())
    found = {r.id: dict(zip(names, r.features)) for r in plans.feature_vectors(spark, sf).collect()}
    assert set(found) == set(pixels) and all(len(f) == 120 and np.isfinite(list(f.values())).all() for f in found.values())
    basis = S.cosines(8)
    for i, row in found.items():
        planes = P.planes_of(pixels[i].transpose(2, 0, 1).astype(float), SIDE)
        y = planes["y"]
        size = np.abs(np.fft.rfft2(y - y.mean()))
        far = size[np.hypot(*np.mgrid[:SIDE, : SIDE // 2 + 1]) > 2] ** 2
        assert row["fft_flatness"] == pytest.approx(np.exp(np.log(far + 1e-12).mean()) / far.mean(), rel=1e-6)
        half = (SIDE // 2 + 1) // 2
        assert row["fft_high_freq_ratio"] == pytest.approx((size[-half:, -half:] ** 2).sum() / (size**2).sum(), rel=1e-6)
        blocks = np.array([basis @ y[a : a + 8, b : b + 8] @ basis.T for a in range(0, SIDE, 8) for b in range(0, SIDE, 8)])
        inner = np.abs(blocks[:, 1:, 1:]).ravel()
        assert row["dct_avg_dc"] == pytest.approx((blocks[:, 0, 0] ** 2).mean()) and row["dct_std"] == pytest.approx(inner.std())
        grey = np.clip(y * 64, 0, 63).astype(int)
        contrast = [((a - b) ** 2).mean() for d in (1, 2) for a, b in ((grey[:, :-d], grey[:, d:]), (grey[:-d, :-d], grey[d:, d:]), (grey[:-d], grey[d:]), (grey[:-d, d:], grey[d:, :-d]))]
        assert row["texture_contrast"] == pytest.approx(np.mean(contrast))
        alike = [np.corrcoef(planes[a].ravel(), planes[b].ravel())[0, 1] for a, b in (("red", "green"), ("green", "blue"))]
        assert row["chroma_rg_corr"] == pytest.approx(alike[0], abs=1e-4) and row["chroma_gb_corr"] == pytest.approx(alike[1], abs=1e-4)


def test_feature_table_is_the_vectors(spark, sf):
    names = list(P.feature_columns())
    vectors = {r.id: r.features for r in plans.feature_vectors(spark, sf).collect()}
    long = {(r.id, r.name): r.value for r in plans.feature_table(spark, sf).collect()}
    assert len(long) == 120 * len(vectors) and all(long[i, n] == x for i, v in vectors.items() for n, x in zip(names, v))


@pytest.mark.parametrize("kind", list(P.VARIANTS))
def test_variants(spark, sf, pixels, kind):
    rows = getattr(plans, f"{kind}_variants")(spark, sf).collect()
    found = {(r.id, r.variant): r for r in rows}
    assert len(found) == len(rows) == len(pixels) * {"tta": 5, "demo": 4, "benchmark": 4, "augmented": 2}[kind]
    for i, image in pixels.items():
        h, w = image.shape[:2]
        same = found[i, "full" if kind == "tta" else "pristine"]
        assert (same.height, same.width, same.sha256) == (h, w, hashlib.sha256(image.tobytes()).hexdigest())
        cuts = {}
        if kind == "tta":
            ch, cw = max(8, int(h * 0.85)), max(8, int(w * 0.85))
            cuts = {"top": image[:ch, :cw], "bottom": image[h - ch :, w - cw :]}
        elif kind == "demo":
            cuts = {"crop": image[h // 8 : h - h // 8, w // 8 : w - w // 8]}
        elif kind == "benchmark":
            cuts = {"screenshot": np.pad(image, [(40, 40), (0, 0), (0, 0)], constant_values=245)}
        for name, own in cuts.items():
            assert (found[i, name].height, found[i, name].width, found[i, name].sha256) == (*own.shape[:2], hashlib.sha256(own.tobytes()).hexdigest())


def test_variants_are_measured_in_the_same_pass(spark, sf):
    """Features of variants made in the pass are those of variants made before it."""
    rows = plans.images(spark, sf).where("id < 40")
    one = {(r.id, r.variant): r for r in P.extract(rows, SIDE, "tta").collect()}
    two = {(r.id, r.variant): r for r in P.extract(P.variants(rows, "tta"), SIDE).collect()}
    assert set(one) == set(two) and len(one) == 200
    for k, r in one.items():
        assert r.features == two[k].features and (r.height, r.width) == (two[k].height, two[k].width)


def test_hashes_and_saliency(spark, sf, pixels):
    hashes = {r.id: r.hash for r in plans.perceptual_hashes(spark, sf).collect()}
    basis = S.cosines(32)
    for i, image in pixels.items():
        small = np.round(S.resized(np.round(P.planes_of(image.transpose(2, 0, 1).astype(float), SIDE)["gray"] * 255)[None], 32, 32))[0]
        low = (basis @ small @ basis.T)[:8, :8].ravel()
        bits = "".join("01"[int(x)] for x in low > np.median(low))
        assert hashes[i] & (2**64 - 1) == int(bits, 2)
    rows = plans.tile_saliency(spark, sf).collect()
    assert len(rows) == 16 * len(pixels) and all(0 <= r.score <= 1 for r in rows)


def test_upright(spark, sf, pixels):
    turns = {1: lambda x: x, 2: np.fliplr, 3: lambda x: np.rot90(x, 2), 4: np.flipud, 5: lambda x: np.rot90(np.fliplr(x), 3), 6: lambda x: np.rot90(x, 3), 7: lambda x: np.rot90(np.fliplr(x)), 8: np.rot90}
    for r in plans.upright_images(spark, sf).collect():
        want = turns[r.id % 8 + 1](pixels[r.id])
        assert r.orientation == 1 and (r.height, r.width, r.sha256) == (*want.shape[:2], hashlib.sha256(want.tobytes()).hexdigest())


def test_arbitration_asks_only_in_doubt(spark, sf, pixels):
    rows = {r.id: r for r in plans.arbitration(spark, sf).collect()}
    assert set(rows) == set(pixels) and any(r.flags for r in rows.values())
    assert all(not r.flags and not r.suspicious for r in rows.values() if r.p in (0.0, 0.9))


def test_synthetic_spectra(spark, sf, pixels):
    """One image a page; the flat spectrum of odd seeds has more of its power far out."""
    made = P.synthetic(spark.range(24).select("id"), SIDE).collect()
    share = {0: [], 1: []}
    for r in made:
        y = np.frombuffer(bytes(r.pixels), np.uint8).reshape(SIDE, SIDE, 3)[:, :, 0] / 255
        power = np.abs(np.fft.fftshift(np.fft.fft2(y - y.mean()))) ** 2
        far = np.hypot(*np.mgrid[-SIDE // 2 : SIDE // 2, -SIDE // 2 : SIDE // 2]) > SIDE / 4
        share[r.label].append(power[far].sum() / power.sum())
    assert min(share[1]) > max(share[0])
    assert {r.id for r in plans.synthetic_images(spark, sf).collect()} == set(pixels)


def test_fits_over_labelled_documents(spark, sf):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall())
    matrix = plans.training_matrix(spark, sf).collect()
    assert sorted((r.id, r.variant) for r in matrix) == sorted((i, v) for i in labels for v in ("pristine", "degraded")) and all(r.label == labels[r.id] and len(r.features) == 120 for r in matrix)
    scored = {r.id: r for r in plans.image_out_of_fold(spark, sf).collect()}
    assert set(scored) == set(labels) and {r.fold for r in scored.values()} == {0, 1}
    # A score tells classes apart better than chance: junk has another texture than prose.
    pairs = [(scored[a].p, scored[b].p) for a, b in combinations(labels, 2) if labels[a] != labels[b]]
    signs = [(1 if labels[a] else -1) for a, b in combinations(labels, 2) if labels[a] != labels[b]]
    assert np.mean([s * (x - y) > 0 for (x, y), s in zip(pairs, signs)]) > 0.6
    tta = plans.tta_scores(spark, sf).collect()
    assert {r.id for r in tta} == set(labels) and all(r.variants == 5 and 0 <= r.p <= 1 for r in tta)


def test_rows_that_are_no_images(spark):
    rows = [(1, None, 4, 4, 3, "a"), (2, bytes(12), 2, 2, 3, "b"), (3, bytes(5), 2, 2, 3, None), (4, bytes(4), 2, 2, 1, "c"), (5, b"", 0, 0, 3, "d"), (6, bytes(48), None, 4, 3, "e")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "id int, pixels binary, height int, width int, channels int, number string, features double, variant string").drop("variant", "number")
    found = {r.id: r for r in P.measured(df, ["means", "hash"], 16).collect()}
    assert {i for i, r in found.items() if r.plane__means is None} == {1, 3, 5, 6} and found[4].plane__means.y == 0.0
    assert P.measured(df.where("false"), ["means"], 16).collect() == []
    asked = P.measured(df, ["means"], 16, when=F.col("id") == 2).collect()
    assert [r.id for r in asked if r.plane__means is not None] == [2]
