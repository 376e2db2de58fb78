"""Image files: decoders beside those of the JVM, folders as data sources, and rows from files to verdicts."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import codecs
from glintframe.operators import models as M
from glintframe.operators import planes as P
from glintframe.operators.analysis import analyze
from glintframe.plans import planes as plans
from glintframe.sources import contents


def picture(h: int, w: int, seed: int = 0) -> np.ndarray:
    """Smooth colours with a little noise, blue-green-red."""
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    planes = [127 + 90 * np.sin(x / (7 + k) + k) * np.cos(y / (9 - k)) + rng.normal(0, 3, (h, w)) for k in range(3)]
    return np.clip(np.stack(planes, axis=2), 0, 255).astype(np.uint8)


def jvm_written(spark, image: np.ndarray, kind: str, path: str, grey: bool = False) -> bytes:
    """The bytes that the JVM's own encoder makes of an image."""
    jvm = spark.sparkContext._jvm
    h, w = image.shape[:2]
    made = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 5)
    argb = (image[:, :, 2].astype(int) << 16 | image[:, :, 1].astype(int) << 8 | image[:, :, 0]).ravel().tolist()
    array = spark.sparkContext._gateway.new_array(jvm.int, len(argb))
    for i, v in enumerate(argb):
        array[i] = v
    made.setRGB(0, 0, w, h, array, 0, w)
    assert jvm.javax.imageio.ImageIO.write(made, kind, jvm.java.io.File(path))
    with open(path, "rb") as file:
        return file.read()


@pytest.mark.parametrize("kind", ["png", "bmp", "jpg"])
@pytest.mark.parametrize("shape", [(8, 8), (23, 37), (40, 17)])
def test_decoders_read_what_the_jvm_writes(spark, tmp_path, kind, shape):
    image = picture(*shape)
    found = codecs.decode(jvm_written(spark, image, kind, f"{tmp_path}/x.{kind}"))
    if kind != "jpg":
        assert np.array_equal(found, image)
        return
    (row,) = spark.read.format("image").load(f"{tmp_path}/x.jpg").select("image.*").collect()
    theirs = np.frombuffer(bytes(row.data), np.uint8).reshape(*shape, 3).astype(int)
    assert np.abs(found.astype(int) - theirs).max() <= 6 and np.abs(found.astype(int) - theirs).mean() < 1  # rounding inside of decoders is free


def test_grey_jpeg(spark, tmp_path):
    image = np.repeat(picture(20, 30)[:, :, :1], 3, axis=2)
    found = codecs.decode(jvm_written(spark, image, "jpg", f"{tmp_path}/g.jpg", grey=True))
    (row,) = spark.read.format("image").load(f"{tmp_path}/g.jpg").select("image.*").collect()
    theirs = np.frombuffer(bytes(row.data), np.uint8).reshape(20, 30, -1)[:, :, :1].astype(int)
    assert np.abs(found - theirs).max() <= 2


def png_of(rows: list[bytes], w: int, h: int, depth: int, colour: int, palette: bytes = b"", interlaced: int = 0) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced))
    return codecs.MAGIC["png"] + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_filters_and_forms():
    image = picture(9, 11)[:, :, ::-1]  # red, green, blue
    flat = image.reshape(9, 33).astype(int)
    rows = []
    for y in range(9):
        kind = y % 5
        up = flat[y - 1] if y else np.zeros(33, int)
        left = np.concatenate([[0, 0, 0], flat[y][:-3]])
        corner = np.concatenate([[0, 0, 0], up[:-3]])
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        guess = [np.zeros(33, int), left, up, (left + up) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    assert np.array_equal(codecs.decode(png_of(rows, 11, 9, 8, 2)), image[:, :, ::-1])
    grey = np.arange(16, dtype=np.uint8).reshape(2, 8) % 2
    assert np.array_equal(codecs.decode(png_of([b"\0" + np.packbits(r).tobytes() for r in grey], 8, 2, 1, 0))[:, :, 0], grey * 255)
    places = np.array([[0, 1, 2, 3], [3, 2, 1, 0]])
    packed = [b"\0" + bytes([sum(int(v) << (6 - 2 * i) for i, v in enumerate(r))]) for r in places]
    palette = np.array([[10, 20, 30], [40, 50, 60], [70, 80, 90], [1, 2, 3]], np.uint8)
    assert np.array_equal(codecs.decode(png_of(packed, 4, 2, 2, 3, palette.tobytes())), palette[places][:, :, ::-1])
    wide = (picture(3, 5).astype(np.uint16) * 256 + 7).astype(">u2")
    assert np.array_equal(codecs.decode(png_of([b"\0" + r.tobytes() for r in wide[:, :, ::-1]], 5, 3, 16, 2)), picture(3, 5))
    small = picture(8, 8)[:, :, ::-1]
    passes = [b"\0" + row.tobytes() for y0, dy, x0, dx in codecs.PASSES for row in small[y0::dy, x0::dx]]
    assert np.array_equal(codecs.decode(png_of(passes, 8, 8, 8, 2, interlaced=1)), small[:, :, ::-1])


def test_bmp_with_palette_and_top_down():
    palette = bytes(range(64))
    body = bytes([0, 1, 2, 0, 3, 4, 5, 0])
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", 14 + 40 + 64 + 8, 0, 118, 40, 3, -2, 1, 8, 0, 8, 0, 0, 16, 0)
    want = np.frombuffer(palette, np.uint8).reshape(-1, 4)[:, :3][np.array([[0, 1, 2], [3, 4, 5]])]
    assert np.array_equal(codecs.decode(head + palette + body), want)


@pytest.mark.parametrize("cut", [2, 30, 200, 500])
def test_broken_files_say_so(spark, tmp_path, cut):
    for kind in ("png", "bmp", "jpg"):
        data = jvm_written(spark, picture(40, 40), kind, f"{tmp_path}/{cut}.{kind}")
        with pytest.raises(codecs.CodecError):
            codecs.decode(data[:cut])
    for data in (b"", b"GIF89a....", b"RIFF\0\0\0\0WEBPVP8 ", b"\xff\xd8\xff\xc2\0\x11\x08"):
        with pytest.raises(codecs.CodecError):
            codecs.decode(data)


def test_folders_of_images(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    image = picture(12, 20)
    (folder / "deep" / "A.PNG").write_bytes(codecs.encode(image))
    (folder / "b.jpg").write_bytes(b"no image")
    (folder / "c.txt").write_bytes(codecs.encode(image))
    (folder / "d.png").write_bytes(b"")
    (folder / "e.bmp").write_bytes(codecs.encode_bmp(picture(60, 60)))
    (folder / ".hidden.png").write_bytes(codecs.encode(image))
    turned = jvm_written(spark, image, "jpg", str(folder / "f.jpg"))
    exif = b"Exif\0\0II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    (folder / "f.jpg").write_bytes(turned[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + turned[2:])
    rows = {r.path.rsplit("/", 1)[1]: r for r in contents.images(spark, str(folder), most="8000", split="500").collect()}
    assert {k: r.reason for k, r in rows.items()} == {"A.PNG": None, "b.jpg": "no image that can be decoded", "d.png": "empty file", "e.bmp": "file is too large", "f.jpg": None}
    assert bytes(rows["A.PNG"].pixels) == image.tobytes() and (rows["A.PNG"].height, rows["A.PNG"].width) == (12, 20)
    assert (rows["f.jpg"].height, rows["f.jpg"].width, rows["f.jpg"].orientation) == (20, 12, 6)
    assert bytes(rows["f.jpg"].pixels) == np.ascontiguousarray(np.rot90(codecs.decode(turned), 3)).tobytes()
    (tmp_path / "none").mkdir()
    assert contents.images(spark, str(tmp_path / "none")).collect() == []


def test_rows_as_files(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}", bytes([i]) * i) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    (tmp_path / "out").mkdir()
    contents.write_contents(df, str(tmp_path / "out"))
    found = {r.path.split("/out/")[1]: bytes(r.content) for r in contents.contents(spark, str(tmp_path / "out")).collect()}
    assert found == dict(rows)
    bad = spark.createDataFrame([("../x", b"1")], "path string, content binary")
    with pytest.raises(Exception, match="relative path"):
        contents.write_contents(bad, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["d0", "d1", "d2"] and not (tmp_path / "x").exists()


def test_from_files_to_verdicts(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, picture(24, 24, i).tobytes() if i % 2 else rng.integers(0, 256, 24 * 24 * 3, np.uint8).tobytes(), 24, 24, 3) for i in range(60)]
    vectors = plans.stored(P.extract(spark.createDataFrame(rows, "id int, y int, pixels binary, height int, width int, channels int"), 32).select("id", "y", "features"), "vectors")
    trained = M.train(vectors, plans.SMALL, by=None, k=2)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(70, 76):
        image = picture(30, 22, i) if i % 2 else rng.integers(0, 256, (30, 22, 3), np.uint8)
        (folder / f"{i}.png").write_bytes(codecs.encode(image))
    (folder / "bad.png").write_bytes(b"nothing")
    files = contents.images(spark, str(folder), content="true")
    found = {r.path.rsplit("/", 1)[1]: r for r in analyze(files, trained, side=32, probe=4, told=2, stored=lambda df: plans.stored(df, "described")).collect()}
    assert len(found) == 7 and found["bad.png"].status == "error" and found["bad.png"].error == "no image that can be decoded" and found["bad.png"].narrative is None
    for name, r in found.items():
        assert r.sha256 == hashlib.sha256((folder / name).read_bytes()).hexdigest()
        if name == "bad.png":
            continue
        assert (r.height, r.width, r.status, r.void) == (30, 22, "done", True) and len(r.members) == 4 and sum(r.families) == pytest.approx(1)
        agreement = min(1, max(0, 1 - np.std(r.members) / 0.5))
        split = agreement < 0.5 and r.p < 0.9
        want = "uncertain" if split or 0.45 - 1e-9 <= r.p < 0.5 else "ai" if r.p >= 0.5 else "authentic"
        assert r.agreement == pytest.approx(agreement, abs=1e-4) and r.verdict_state == want and r.is_ai == (r.p >= 0.5 and not split)
        assert len(r.evidence) <= 2 and r.severity.startswith("[") and "Provenance Void" in r.narrative and all(f.label for f in r.flags)
    told = {name: found[f"{name}.png"].p for name in range(70, 76)}
    assert max(told[i] for i in (70, 72, 74)) < min(told[i] for i in (71, 73, 75))


def test_queries(spark, sf):
    rows = plans.analyzed_files(spark, sf).collect()
    reasons = {r.id % 10: r.error for r in rows}
    assert reasons == {0: None, 1: None, 2: None, 3: "empty file", 4: "no decoder for webp", 5: "a png chunk is broken", 6: "file is too large", 7: "no image that can be decoded", 9: None}
    assert all((r.p is None) == (r.error is not None) for r in rows) and len(rows) == 225
    good = [r for r in rows if r.error is None]
    assert all(0 <= r.p <= 1 and r.narrative and len(r.evidence) == 3 for r in good)
    assert plans.loaded_images(spark, sf).where(F.col("reason").isNull()).count() == len(good)


def test_members_of_archives(spark, tmp_path):
    import zipfile

    from glintframe.sources import archives

    folder = tmp_path / "zips"
    folder.mkdir()
    rng = np.random.default_rng(0)
    want = {}
    for k in range(2):
        with zipfile.ZipFile(folder / f"{k}.ZIP", "w") as archive:
            for i in range(300):
                data = rng.integers(0, 4, int(rng.integers(0, 400)), np.uint8).tobytes()
                archive.writestr(f"d/{i}.bin", data, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
                want[f"{k}.ZIP", f"d/{i}.bin"] = data
            archive.writestr("../out.bin", b"x")
            archive.writestr("slow.bin", b"y" * 100, zipfile.ZIP_BZIP2)
    data = bytearray((folder / "0.ZIP").read_bytes())
    with zipfile.ZipFile(folder / "0.ZIP") as archive:
        info = archive.getinfo("d/7.bin")
    data[info.header_offset + 36 + 3] ^= 85
    (folder / "0.ZIP").write_bytes(data)
    (folder / "bad.zip").write_bytes(b"nothing")
    df = archives.members(spark, str(folder), split="5000")
    assert df.rdd.getNumPartitions() > 8
    rows = {(r.archive.rsplit("/", 1)[1], r.name): r for r in df.collect()}
    assert rows.pop(("bad.zip", None)).reason.startswith("not a zip")
    assert rows["0.ZIP", "d/7.bin"].reason.startswith("broken") and rows.pop(("0.ZIP", "d/7.bin")).content is None and want.pop(("0.ZIP", "d/7.bin")) is not None
    for k in range(2):
        assert rows.pop((f"{k}.ZIP", "../out.bin")).reason.startswith("a name outside") and rows.pop((f"{k}.ZIP", "slow.bin")).reason == "packing method 12"
    assert {k: bytes(r.content) for k, r in rows.items()} == want and all(r.reason is None for r in rows.values())
    pins = spark.createDataFrame([("1.ZIP", hashlib.sha256((folder / "1.ZIP").read_bytes()).hexdigest().upper()), ("0.ZIP", "0" * 64)], "file string, sha256 string")
    state = {(r.archive.rsplit("/", 1)[1], r.reason): r.n for r in archives.members(spark, str(folder), pins).groupBy("archive", "reason").agg(F.count("*").alias("n")).collect()}
    assert state["0.ZIP", "the archive's checksum is another"] == 302 and state["1.ZIP", None] == 300


def test_many_small_archives_in_few_partitions(spark, tmp_path):
    import zipfile

    from glintframe.sources import archives

    folder = tmp_path / "zips"
    folder.mkdir()
    want = {}
    for k in range(1500):
        with zipfile.ZipFile(folder / f"{k}.zip", "w") as archive:
            for i in range(2):
                want[f"{k}.zip", f"{i}.bin"] = data = f"{k} {i} ".encode() * 20
                archive.writestr(f"{i}.bin", data)
    (folder / "bad.zip").write_bytes(b"nothing")
    (folder / "empty.zip").write_bytes(b"")
    df = archives.members(spark, str(folder), split="100")
    digests = archives.digests(spark, str(folder))
    # A group may end early, before an archive that doesn't fit, so there may be twice as many.
    assert max(df.rdd.getNumPartitions(), digests.rdd.getNumPartitions()) <= 2 * archives.PARTITIONS
    rows = {(r.archive.rsplit("/", 1)[1], r.name): r for r in df.collect()}
    assert all(rows.pop((name, None)).reason.startswith("not a zip") for name in ("bad.zip", "empty.zip"))
    assert {k: bytes(r.content) for k, r in rows.items()} == want
    found = {r.archive.rsplit("/", 1)[1]: r.sha256 for r in digests.collect()}
    assert len(found) == 1502 and all(found[p.name] == hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir())
