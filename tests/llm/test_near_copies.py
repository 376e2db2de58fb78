"""Near copies: links that a group's first pass doesn't compare, and texts of few words."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from glintframe.llm import simhash_wide as W


def pages(pairs: int = 60, alone: int = 280) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Pages with a template in common, alike at 0.78; planted pairs have four words more in common: 0.81."""
    rng = random.Random(11)
    word = lambda: f"w{rng.getrandbits(40):x}"
    template = [word() for _ in range(204)]
    rows, planted = [], []
    for n in range(pairs):
        shared = [word() for _ in range(4)]
        planted.append((2 * n, 2 * n + 1))
        rows += [(i, " ".join(template + shared + [word() for _ in range(24)])) for i in planted[-1]]
    rows += [(2 * pairs + n, " ".join(template + [word() for _ in range(28)])) for n in range(alone)]
    return rows, planted


def test_pairs_within_a_template(spark):
    rows, planted = pages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in W.drop_near_copies(docs).collect()}
    assert kept == {i for i, _ in rows} - {b for _, b in planted}


def test_large_groups_of_mixed_similarity(spark):
    """Four families of 150 texts, edited a little or a lot: the components are those of all pairs compared."""
    rng, rows = random.Random(23), []
    for family in range(4):
        base = [f"f{family}w{rng.getrandbits(30):x}" for _ in range(260)]
        for _ in range(150):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 12])):
                words[rng.randrange(len(words))] = f"x{rng.getrandbits(40):x}"
            rows.append((len(rows), " ".join(words)))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a // 150 * 150, a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in W.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    want = {i for i in range(len(rows)) if find(i) == i}
    assert kept == want and 4 < len(want) < 600


def test_prefix_pairs_miss_none(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(40) for _ in range(60)]
    sets = [sorted({*rng.sample(base, rng.randint(30, 60)), *[rng.getrandbits(40) for _ in range(rng.randint(0, 8))]}) for _ in range(150)]
    df = spark.createDataFrame([(i, i // 2, s) for i, s in enumerate(sets)], "uid long, root long, shingles array<long>")
    pairs = W.prefix_pairs(df, 0.8)
    found = {tuple(r) for r in W.linked(pairs, df, 0.8).collect()}
    like = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if i // 2 != j // 2 and like(sets[i], sets[j])}
    assert want and found == want
    assert pairs.where(F.col("a") >= F.col("b")).isEmpty()


def test_few_different_words(spark):
    """1200 words over a vocabulary of 10: the pairs of neighbouring words say little, the shingles all."""
    rng = random.Random(3)
    rows = []
    for n in range(5):
        logs = [f"v{n}x{rng.randrange(10)}" for _ in range(1200)]
        prose = [f"p{n}x{rng.getrandbits(30)}" for _ in range(285)]
        rows += [(2 * n, " ".join(logs)), (2 * n + 1, " ".join(logs + prose))]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(shingles[::2], shingles[1::2]))
    kept = W.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 8]
