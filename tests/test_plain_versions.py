"""Operators without SQL beside plain loops, and the cases that tables don't hold."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import signal as S
from glintframe.functions.numeric import lit
from glintframe.operators import embeddings as B
from glintframe.operators import evaluation as E
from glintframe.operators import manifest as M
from glintframe.operators import models
from glintframe.operators import narrative as N
from glintframe.operators import planes as P
from glintframe.operators import verdict as V
from glintframe.plans import embeddings as embedding_plans
from glintframe.plans import manifest as manifest_plans
from glintframe.session import with_checkpoints
from glintframe.sources import files, stores
from glintframe.streaming import jobs

SMALL = models.Config(trees=5, tree_depth=4, boosts=3, boost_depth=3, waves=16, iterations=20)


def test_near_duplicates_as_a_loop_drops_them(spark, sf):
    hashes = sorted((r.vec_id, r.hash) for r in manifest_plans.near_hashes(spark, sf).collect())
    kept: list[tuple[int, int]] = []
    for i, h in hashes:
        if all(bin((h ^ own) & (2**64 - 1)).count("1") > 4 for _, own in kept):
            kept.append((i, h))
    found = {r.vec_id for r in manifest_plans.near_dup_greedy(spark, sf).collect()}
    assert found == {i for i, _ in kept} and len(found) < len(hashes)
    assert {r.vec_id for r in manifest_plans.near_dup_arrivals(spark, sf).collect()} == found


def test_near_duplicate_chain(spark):
    """Each row is near the one before: every other one stays, in many rounds."""
    with_checkpoints(spark)
    ids = spark.range(41).select(F.col("id"))
    pairs = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r.id for r in M.greedy_keep(ids, pairs, "id", "id").collect()) == list(range(0, 41, 2))


def test_unknown_clusters_as_a_loop_finds_them(spark, sf):
    found = embedding_plans.vectors(spark, sf).select("vec_id", "embedding").orderBy("vec_id").collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in found]
    all_vectors, free, want = np.stack([v for _, v in rows]), set(range(len(rows))), set()
    for at, (seed, v) in enumerate(rows):
        if at in free:
            near = [i for i in np.flatnonzero(((all_vectors - v) ** 2).sum(axis=1) < 1.2**2) if i in free]
            if len(near) >= 5:
                want |= {(seed, rows[i][0]) for i in near}
                free -= set(near)
    assert {tuple(r) for r in embedding_plans.unknown_clusters(spark, sf).collect()} == want


@pytest.mark.parametrize("epsilon", [0.05, 0.3, 1.5])
def test_radius_join_misses_no_pair(spark, epsilon):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    vectors = np.concatenate([base + 0.05 * rng.normal(size=base.shape) for _ in range(12)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    far = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(far < epsilon)) if a != b}
    found = [tuple(r) for r in B.within(df, epsilon).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_verdicts_at_the_edges(spark):
    """The gate 0.37: at and below it, the ambiguous band of 0.05, and thresholds that can't be used."""
    cases = [(0.37, "uncertain"), (0.3699, "uncertain"), (0.32, "uncertain"), (0.3199, "authentic"), (0.5, "ai"), (0.4999, "uncertain"), (0.0, "authentic"), (1.0, "ai")]
    df = spark.createDataFrame(cases, "p double, want string")
    assert all(r.want == r.verdict_state for r in V.with_verdict(df, threshold=lit(0.37)).collect())
    bounds = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5), (float("inf"), 0.5), (0.5, 0.5), (0.99, 0.5), (0.01, 0.05), (0.2, 0.2)], "t double, want double")
    assert all(r.want == r.got for r in bounds.select("want", V.clamp_threshold(F.col("t")).alias("got")).collect())


def test_curves_of_few_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.4, 0)], "p double, y int")
    roc = sorted((r.fpr, r.tpr) for r in E.roc_curve(df).collect())
    assert np.allclose(roc, [(0, 0), (0, 1 / 3), (0, 2 / 3), (1 / 3, 2 / 3), (1 / 3, 1), (1, 1)])
    assert (1.0, 0.0, None) in {(r.precision, r.recall, r.threshold) for r in E.pr_curve(df).collect()}
    one = spark.createDataFrame([(0.9, 1), (0.2, 1)], "p double, y int")
    assert E.roc_auc(one).first()[0] == 0.5 and E.fpr_threshold(one, 0.05).first().threshold == 0.2
    none = df.where("false")
    assert E.roc_auc(none).first()[0] == 0.5 and E.binary_metrics(none, 0.5).first().n == 0


def test_percentiles_are_interpolated(spark):
    values = [3.0, 1.0, 10.0, 7.0, 7.0, None]
    found = E.latency_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    kept = [v for v in values if v is not None]
    assert tuple(found) == pytest.approx(tuple(np.percentile(kept, [50, 95, 99])))
    assert tuple(E.latency_percentiles(spark.createDataFrame([], "v double"), "v").first()) == (None, None, None)


def test_manifest_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.manifest_csv(spark, f"{tmp_path}/none")
    (tmp_path / "a.csv").write_text("path,label\nx,1\n")
    with pytest.raises(files.ManifestError, match="image_path"):
        files.manifest_csv(spark, f"{tmp_path}/a.csv")
    (tmp_path / "b.csv").write_text('image_path,label\n"a,b.png",1\n,0\nc.png,1.0\n')
    rows, dead = files.manifest_csv(spark, f"{tmp_path}/b.csv")
    assert [(r.image_path, r.label) for r in rows.collect()] == [("a,b.png", 1), ("c.png", 1)] and [r.reason for r in dead.collect()] == ["no path"]
    with pytest.raises(files.ManifestError):
        files.require_two_classes(rows)


def png(pixels: np.ndarray) -> bytes:
    """An uncompressed-filter PNG of (height, width, 3) red-green-blue bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    pixels = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "A.PNG").write_bytes(png(pixels))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    (tmp_path / "c.txt").write_bytes(b"text")
    names = sorted(r.path.rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path)).select("path").collect())
    assert names == ["A.PNG", "b.jpg"]
    good, broken = files.decoded(spark, str(tmp_path))
    (image,) = good.collect()
    assert (image.height, image.width, image.channels) == (5, 7, 3)
    assert bytes(image.pixels) == pixels[:, :, ::-1].tobytes()
    assert broken.count() == 2


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    stores.export_signed(rows, f"{tmp_path}/x")
    assert sorted(map(tuple, stores.import_verified(spark, f"{tmp_path}/x", "id long, name string").collect())) == [(1, "a"), (2, None)]
    for file in (tmp_path / "x" / "rows").glob("*.json"):
        file.write_text(file.read_text().replace('"a"', '"b"'))
    for crc in (tmp_path / "x" / "rows").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="proof"):
        stores.import_verified(spark, f"{tmp_path}/x", "id long, name string")
    with pytest.raises(FileNotFoundError):
        stores.read_report(spark, f"{tmp_path}/none")
    assert stores.report_history(spark, f"{tmp_path}/none", "accuracy double").count() == 0


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, into, at = (f"{tmp_path}/{n}" for n in ("in", "out", "at"))
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i, "x" * (400 if i == 1 else 5)) for i in part], "id long, text string").write.mode("append").parquet(folder)
        stream = jobs.outcomes(jobs.arrivals(spark, folder, "id long, text string"), F.when(F.length("text") > 300, "too long"), {"size": F.length("text")})
        seen = []
        assert jobs.poll(jobs.run_job(stream, into, at), seen.append)
        assert seen[-1]["active"] is False
    rows = {r.id: (r.status, r.size, r.error) for r in spark.read.parquet(into).collect()}
    assert rows == {i: ("error", None, "too long") if i == 1 else ("done", 5, None) for i in range(5)}


def test_poll_gives_up(spark):
    class Never:
        recentProgress, isActive = [], True

        def awaitTermination(self, seconds: float) -> bool:
            return False

    assert jobs.poll(Never(), timeout=0.05, every=0.01) is False


def test_planes_by_plain_numpy(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (32, 32)).astype(float) / 255
    df = spark.createDataFrame([(1, image.ravel().tolist())], "id long, y array<double>").withColumns({c: F.col("y") for c in ("gray", "red", "green", "blue")})
    row = dict(zip(P.feature_columns(), P.extract(df).first().features))
    assert len(row) == 120
    size = np.abs(np.fft.rfft2(image - image.mean()))
    r = np.hypot(*np.mgrid[:32, :17])
    far = size[r > 2] ** 2
    assert row["fft_flatness"] == pytest.approx(np.exp(np.log(far + 1e-12).mean()) / far.mean(), rel=1e-6)
    assert row["fft_high_freq_ratio"] == pytest.approx((size[-8:, -8:] ** 2).sum() / (size**2).sum(), rel=1e-6)
    basis = S.cosines(8)
    blocks = np.array([basis @ image[y : y + 8, x : x + 8] @ basis.T for y in range(0, 32, 8) for x in range(0, 32, 8)])
    assert np.allclose(basis @ basis.T, np.eye(8)) and row["dct_avg_dc"] == pytest.approx((blocks[:, 0, 0] ** 2).mean())
    inner = np.abs(blocks[:, 1:, 1:]).ravel()
    assert row["dct_std"] == pytest.approx(inner.std()) and row["dct_kurtosis"] == pytest.approx(((inner - inner.mean()) ** 4).mean() / inner.var() ** 2 - 3, rel=1e-6)
    assert row["chroma_rg_corr"] == 1.0
    grey = np.clip(image * 64, 0, 63).astype(int)
    props = []
    for d in (1, 2):
        for dy, dx in ((0, d), (d, d), (d, 0), (d, -d)):
            pairs = [(grey[y, x], grey[y + dy, x + dx]) for y in range(32 - dy) for x in range(32) if 0 <= x + dx < 32]
            props.append((np.mean([(a - b) ** 2 for a, b in pairs]), np.mean([abs(a - b) for a, b in pairs])))
    assert row["texture_contrast"] == pytest.approx(np.mean([p[0] for p in props])) and row["texture_dissimilarity"] == pytest.approx(np.mean([p[1] for p in props]))


def test_wavelet_keeps_the_energy_of_long_signals():
    """An orthogonal transform: inside a long signal, away from its mirrored ends, energy is kept; a constant has no detail."""
    x = np.zeros((1, 256, 256))
    x[0, 100:156, 100:156] = np.random.default_rng(2).normal(size=(56, 56))
    average, details = S.wavelet(x, 3)
    assert (average**2).sum() + sum((b**2).sum() for level in details for b in level) == pytest.approx((x**2).sum())
    _, flat = S.wavelet(np.ones((1, 40, 40)), 2)
    assert max(np.abs(b).max() for level in flat for b in level) < 1e-9


def test_ensemble_learns_and_lasts(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, ["a", "b", "c", None][i % 4 if i % 8 else 3], (rng.normal(size=4) + 2 * (i % 2)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y int, generator string, features array<double>")
    oof = models.out_of_fold(df, SMALL, k=2).persist()
    assert oof.count() == 240 and E.roc_auc(oof).first()[0] > 0.9
    assert {len(r.members) for r in oof.select("members").collect()} == {4}
    with pytest.raises(ValueError, match="two classes"):
        models.fit(df.where("y = 1"), SMALL)
    held = {r.generator: r for r in models.leave_one_out(df, SMALL).collect()}
    assert set(held) <= {"a", "b", "c", "unknown"} and sum(r.n for r in held.values()) == 240
    trained = models.train(df, SMALL, k=2)
    models.save(trained, spark, f"file://{tmp_path}/model")
    again = models.load(spark, f"file://{tmp_path}/model")
    some = df.withColumn("features", F.when(F.col("id") > 3, F.col("features")).when(F.col("id") > 1, F.array(lit(1.0))))
    a, b = ({r.id: (r.p, r.status, r.error) for r in t.score(some).collect()} for t in (trained, again))
    assert a == b and [a[i][1:] for i in range(4)] == [("error", "no features")] * 2 + [("error", "wrong number of features")] * 2 and all(0 <= a[i][0] <= 1 for i in range(4, 240))


def test_calibration_is_monotone_and_falls_back(spark):
    rng = np.random.default_rng(5)
    soft = [(i, float(p), int(rng.random() < p)) for i, p in enumerate(rng.random(400))]
    df = spark.createDataFrame(soft, "id long, p double, y int")
    grid = spark.createDataFrame([(i / 50,) for i in range(51)], "p double")
    for method in ("isotonic", "sigmoid"):
        found = models.calibrate(df, method=method)
        values = [r.c for r in grid.select("p", found.apply(F.col("p")).alias("c")).orderBy("p").collect()]
        assert found.method == method and all(x <= y + 1e-12 for x, y in zip(values, values[1:])) and 0 <= values[0] and values[-1] <= 1
    steps = spark.createDataFrame([(i, 0.1 + 0.8 * (i % 2) + i * 1e-6, i % 2) for i in range(100)], "id long, p double, y int")
    assert models.calibrate(steps).method == "sigmoid"
    with pytest.raises(ValueError, match="method"):
        models.calibrate(df, method="other")


def test_family_heads_as_a_loop_fits_them(spark):
    rows = [(i / 100, i % 4) for i in range(101)]
    found = models.family_weights(spark.createDataFrame(rows, "p double, family int"), "p", "family", 4)
    x, fam = np.array([[1.0, p] for p, _ in rows]), np.array([f for _, f in rows])
    for k in range(4):
        w = np.zeros(2)
        for _ in range(800):
            w -= 0.15 * x.T @ (1 / (1 + np.exp(-x @ w)) - (fam == k)) / len(x)
        assert found[k] == pytest.approx(tuple(w))
    assert models.family_weights(spark.createDataFrame([(0.5, 1)], "p double, family int"), "p", "family", 4) is None
    assert models.family_columns(["fft_a", "dct_b", "fft_c", "other"]) == {"fft": [0, 2], "dct": [1]}


def test_metadata_tags_that_do_not_fit(spark):
    entry = lambda tag, kind, n, slot: struct.pack(">HHI", tag, kind, n) + slot
    body = N.EXIF + b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 4)
    body += entry(0x0132, 2, 20, b"\0\0\1\0") + entry(0x920A, 4, 1, struct.pack(">I", 35)) + entry(0x0001, 3, 1, b"\0\1\0\0") + entry(0x8827, 3, 1, b"\1\0\0\0")
    df = spark.createDataFrame([(1, bytearray(b"\xff\xd8\xff" + body)), (2, bytearray(b"\xff\xd8\xff" + body[:9])), (3, None), (4, bytearray(b""))], "id long, content binary")
    rows = {r.id: r for r in N.provenance(df, "content").collect()}
    assert rows[1].exif == {"datetime": "00000100", "focal_length": "35", "iso_speed": "256"} and rows[1].has_exif and not rows[1].void
    assert rows[2].exif == {} and rows[2].void and rows[2].penalty == 0.1


def test_settings_by_type():
    from glintframe.settings import Settings, load

    said = {"GLINTFRAME_IMAGE_SIZE": "64", "GLINTFRAME_VERBOSE": "Yes", "GLINTFRAME_SUPPORTED_FORMATS": ".a, .b,", "GLINTFRAME_THRESHOLD_FPR_TARGET": "0.1", "OTHER": "x"}
    found = load(said)
    assert (found.image_size, found.verbose, found.supported_formats, found.threshold_fpr_target) == (64, True, (".a", ".b"), 0.1) and load({}) == Settings()


def test_orientations_as_they_are_defined(spark):
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    rows = [(way, image.tobytes(), 2, 3, 3, way) for way in range(1, 9)]
    df = spark.createDataFrame(rows, "id int, pixels binary, height int, width int, channels int, orientation int")
    mirrored, turn = image[:, ::-1], lambda x, k: np.rot90(x, -k)  # clockwise quarter turns
    want = {1: image, 2: mirrored, 3: turn(image, 2), 4: image[::-1], 5: turn(mirrored, 1), 6: turn(image, 1), 7: turn(mirrored, 3), 8: turn(image, 3)}
    for r in P.upright(df).collect():
        assert (r.height, r.width) == want[r.id].shape[:2] and bytes(r.pixels) == want[r.id].tobytes() and r.orientation == 1
    head = b"\xff\xd8Exif\0\0II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    files_ = spark.createDataFrame([(1, bytearray(head)), (2, bytearray(b"")), (3, None), (4, bytearray(head[:14]))], "id int, content binary")
    assert {r.id: r.o for r in files_.select("id", P.orientation("content").alias("o")).collect()} == {1: 6, 2: 1, 3: 1, 4: 1}


def test_arbiter_sees_light_edges_and_skin(spark):
    from glintframe.operators import arbiter as A

    mask = np.zeros((60, 60), bool)
    mask[5:15, 5:15] = mask[30:33, 30:33] = True
    assert sorted(A.regions(mask)) == [4, 81] and A.regions(np.zeros((4, 4), bool)) == [] and sorted(A.regions(A.opened(mask, 2))) == [81]
    step = np.zeros((32, 32))
    step[:, 16:] = 255.0
    assert A.edges(step).sum(axis=1).max() == 1 and not A.edges(np.zeros((8, 8))).any()
    hand = np.zeros((64, 64))
    hand[10:50, 2:30] = 0.8
    flat, low = np.zeros((64, 64)), hand * 0.6
    rows = [(1, 0.5, hand, low), (2, 0.5, flat, flat), (3, 0.9, flat, flat)]
    df = spark.createDataFrame([(i, p, a.ravel().tolist(), a.ravel().tolist(), b.ravel().tolist(), b.ravel().tolist()) for i, p, a, b in rows], "id int, p double, gray array<double>, red array<double>, green array<double>, blue array<double>")
    found = {r.id: r for r in A.arbitrate(df).collect()}
    assert A.LABELS["asymmetry"] in {f.label for f in found[1].flags} and found[1].suspicious
    assert [f.label for f in found[2].flags] == [A.LABELS["none"]] and found[3].flags == [] and not found[3].suspicious
