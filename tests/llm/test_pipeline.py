"""Each stage works on all that the one before kept; its decisions take effect."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline as P
from glintframe.llm.common import table, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = []
    for n, (_, stage) in enumerate(P.STAGES, 1):
        before = docs
        docs = stage(spark, docs, sf)
        if n < len(P.STAGES):
            assert docs.columns == before.columns
            docs = written(docs, f"test-{n}")
        seen.append(docs)
    told, exact, near, mixed, packed = seen
    lower = lambda r: (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = defaultdict(int)
    for r in told.collect():
        best[lower(r)] = max(best[lower(r)], r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(best.values())

    shingles = {}
    for r in exact.collect():
        words = WORDS.findall(lower(r))
        shingles[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    by_shingle = defaultdict(list)
    for i, own in shingles.items():
        for s in own:
            by_shingle[s].append(i)
    kept = {r.doc_id for r in near.collect()}
    missed = links = 0
    for i, own in shingles.items():
        near_ids = {j for s in own for j in by_shingle[s] if j > i}
        for j in near_ids:
            both = len(own & shingles[j])
            if both >= 0.8 * (len(own) + len(shingles[j]) - both):
                links += 1
                missed += i in kept and j in kept
    assert links and not missed
    clean = {i for i, own in shingles.items() if all(len(by_shingle[s]) == 1 for s in own)}
    assert clean <= kept
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= kept
    assert packed.groupBy("doc_id").count().count() == mixed.select("doc_id").distinct().count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk string, uid string"


def tables(spark, folder, rows) -> str:
    spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (1, 0, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_hard_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, columns named like those that stages add."""
    own = {"aa": "abra kadabra simsala ", "bb": "zuzu mizu wuzu kuzu "}
    rows = [(i, own[lang] * (3 + i), lang, ["s", "t", None][i % 3], 5) for i, lang in enumerate(["aa", "bb"] * 10)]
    rows += [(3, own["bb"] * 6, "bb", "t", 5)] * 3 + [(None, None, None, None, None), (50, "", "aa", "s", 0), (51, " \n", None, "s", 2), (None, own["aa"] * 40, "aa", None, None)]
    rows += [(60, own["aa"] * 20_000, "aa", "s", 1), (60, own["aa"].upper() * 20_000, "aa", "s", 1), (61, "123 456", None, None, 7)]
    folder = tables(spark, tmp_path / "t", rows)
    packed = P.run(spark, folder).collect()
    kept = {r.doc_id for r in packed}
    assert kept and kept <= {r[0] for r in rows} and not kept & {50, 51, 61}
    parts = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(length <= 2048 for *_, length in parts)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(parts, parts[1:]))


def test_no_rows(spark, tmp_path):
    assert P.run(spark, tables(spark, tmp_path / "t", [])).collect() == []


def test_a_second_run_leaves_the_first_ones_result(spark, tmp_path):
    own = {"aa": "abra kadabra simsala ", "bb": "zuzu mizu wuzu kuzu "}
    rows = [(i, own[lang] * (3 + i), lang if i % 4 else None, "s", 5) for i, lang in enumerate(["aa", "bb"] * 10)]
    folder = tables(spark, tmp_path / "t", rows)
    first, second = P.run(spark, folder), P.run(spark, folder)
    a, b = ({(r.doc_id, r.piece) for r in df.collect()} for df in (first, second))
    assert a == b and a
