"""Spelling variants beside a plain version: whole tables, skewed blocks, hard rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from glintframe.llm import queries as Q
from glintframe.llm import variants

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows: list[tuple], least: int = 3, length: int = 5, damage: int = 97) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near(words) -> dict[str, set[str]]:
    cut: dict[str, set[str]] = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut.setdefault(key, set()).add(w)
    return {w: {b for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for b in cut[key] if apart(w, b)} for w in words}


def plain(words: dict[str, int]) -> list[tuple]:
    close = near(words)
    form = {w: min(close[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(close[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows(df) -> list[tuple]:
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_query_same_as_plain(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    found = rows(Q.op12_spelling_variants(spark, sf))
    assert found == plain(counts(docs)) and any(w != r for w, _, r, *_ in found)


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_skewed_blocks_lose_no_pair(spark, block):
    random.seed(block)
    words = {"".join(random.choices("abé", k=random.randint(1, 7))) for _ in range(500)} | {"x" * k for k in (40, 41, 42)}
    words |= {"prefix" + "".join(random.choices("abc", k=5)) for _ in range(80)} | {"".join(random.choices("abc", k=5)) + "suffix" for _ in range(80)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = [tuple(r) for r in variants.near_pairs(df, block).collect()]
    assert sorted(found) == sorted((a, b) for a, own in near(words).items() for b in own)


def test_hard_rows(spark):
    long = "a" * 5000 + " " + "ÀÉÿ×" * 200
    texts = ["Hello hello HELLO hellO helo", "İstanbul ſtraße ÀÉÎÕÜ àéîõü 中文 abcde", None, "", long, long, " \t", "hello-hello'hello"] * 4
    docs = [(None if i == 3 else i % 9, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in docs], "doc_id long, text string, word string, n long, form string")
    for damage in (1, 2, 97):
        found = rows(variants.variant_groups(df, least=1, length=1, damage=damage))
        assert found == plain(counts(docs, 1, 1, damage))
    assert rows(variants.variant_groups(df.where("false"))) == []
