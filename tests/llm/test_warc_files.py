"""Archives rewritten as files: streamed, any member read alone by its sidecar's line, broken ones left out."""

from __future__ import annotations

import gzip
import json
import random

from glintframe.llm import warc, warc_files


def test_streams_of_any_size(spark, tmp_path):
    random.seed(2)
    root, into = tmp_path / "in", tmp_path / "out"
    (root / "deep").mkdir(parents=True)
    want = {}
    for name, n in (("a.warc.gz", 300), ("deep/b.warc.gz", 3), ("empty.warc.gz", 0)):
        parts = []
        for i in range(n):
            body = random.randbytes(random.choice([0, 10, 5000, 700_000 if i % 100 == 0 else 50]))
            parts.append(warc.record("response", f"{i}", f"http://x/{i}", body, {}))
            want.setdefault(name, []).append(parts[-1])
        data = gzip.compress(b"".join(parts)) if name != "deep/b.warc.gz" else b"".join(gzip.compress(p) for p in parts)  # one of many members, too
        (root / name).write_bytes(data)
    whole = (root / "a.warc.gz").read_bytes()
    (root / "cut.warc.gz").write_bytes(whole[: len(whole) // 2])
    (root / "no.warc.gz").write_bytes(b"no gzip")
    (root / "other.txt").write_bytes(b"x")
    rows = warc_files.rewrite(spark, f"file://{root}", f"file://{into}").collect()
    broken = {r.archive: r.reason for r in rows if r.reason}
    assert set(broken) == {"cut.warc.gz", "no.warc.gz"} and not (into / "cut.warc.gz").exists() and not list(into.rglob(".*"))
    for name, parts in want.items():
        own = [r for r in rows if r.archive == name]
        data = (into / name).read_bytes()
        entries = [json.loads(line) for line in (into / f"{name[:-8]}.idx").read_text().splitlines()]
        assert [(r.offset, r.length) for r in own] == [(e["offset"], e["length"]) for e in entries] and sum(e["length"] for e in entries) == len(data)
        assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries] == parts
        assert gzip.decompress(data) == b"".join(parts)
    assert (into / "empty.warc.gz").read_bytes() == b""
    (tmp_path / "none").mkdir()
    assert warc_files.rewrite(spark, f"file://{tmp_path}/none", f"file://{into}").collect() == []


def test_same_places_as_rows(spark, tmp_path):
    """A file gives the members that ``normalise`` gives of its content as a row."""
    (tmp_path / "in").mkdir()
    data = gzip.compress(b"".join(warc.record("response", str(i), "u", b"x" * i, {}) for i in range(50)))
    (tmp_path / "in" / "a.warc.gz").write_bytes(data)
    rows = warc_files.rewrite(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    plain = warc.index(warc.normalise(spark.createDataFrame([("a", data)], "archive string, content binary"))).collect()
    assert sorted((r.record_id, r.offset, r.length) for r in rows) == sorted((r.record_id, r.offset, r.length) for r in plain)
