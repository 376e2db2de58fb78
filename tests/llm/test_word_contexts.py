"""The model over whole words: contexts with one ending told apart, beside a sampler of single customers, sums of probabilities, hard rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_pitman_yor import Plain, check_plain_columns, tokens

from glintframe.llm import pitman_yor as PY
from glintframe.llm import queries as Q
from glintframe.llm import word_contexts as WC
from glintframe.llm.common import shared_dir


def is_held(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_words_of_one_ending_are_contexts_of_their_own(spark, tmp_path):
    held = [i for i in range(3000) if is_held(i)][:2]
    train = [i for i in range(400) if not is_held(i)]
    docs = [(i, "north south" if i % 2 else "mouth earth") for i in train]
    docs += [(held[0], "north south"), (held[1], "mouth south")]  # both words end in th
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in Q.op11_pitman_yor(spark, str(tmp_path)).collect()}
    assert found[held[0]].score > found[held[1]].score + 1


def follows(lexicon, follow, n):
    w, words = random.choice(lexicon), []
    for _ in range(n):
        words.append(w)
        w = random.choice(follow[w]) if random.random() < 0.7 else random.choice(lexicon)
    return " ".join(words)


def test_like_a_sampler_of_single_customers(spark):
    random.seed(5)
    lexicon = sorted({"".join(random.choices("abcdé", k=random.randint(1, 4))) for _ in range(60)})
    follow = {w: random.choices(lexicon, k=4) for w in lexicon}
    docs = [(i, follows(lexicon, follow, 25)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.id: r for r in WC.scores(df, df.doc_id % 4 == 0, burn=6, samples=6).collect()}
    check_plain_columns(found.values(), docs, lambda i: i % 4 == 0)
    pairs_of = lambda text: list(zip([None, *tokens(text)[:-1]], tokens(text)))
    train = [x for i, text in docs if i % 4 for x in pairs_of(text)]
    pairs = Counter(train)
    roots = Counter(w for _, w in pairs)
    discounts = []
    for counts in (roots, pairs):
        n1, n2 = (sum(x == k for x in counts.values()) for k in (1, 2))
        discounts.append(min(0.95, max(0.05, n1 / max(n1 + 2 * n2, 1))))
    model = Plain(discounts, len(roots), 1)
    for c, w in train:
        model.seat(1, c, w)
    total, samples = defaultdict(float), 0
    for step in range(20):
        for c, w in train:
            model.leave(1, c, w)
            model.seat(1, c, w)
        if step >= 10:
            samples += 1
            for i, text in docs:
                if i % 4 == 0:
                    for k, (c, w) in enumerate(pairs_of(text)):
                        total[i, k] += model.p(1, c, w)
    plain = defaultdict(float)
    for (i, _), p in total.items():
        plain[i] += math.log10(p / samples)
    a, b = (sum(x) / 26 / len(plain) for x in (plain.values(), (found[i].score for i in plain)))
    assert abs(a - b) < 0.01
    assert max(abs(plain[i] - found[i].score) / 26 for i in plain) < 0.05


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b b b c", "", None, "é a ü", "x " * 300 + "y", "a b c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "false AS held", "text")
    found = WC.fit(WC._scanned(df, 1 << 20))
    rows = defaultdict(list)
    for r in found.rows().collect():
        rows[r.bucket].append(r.asDict())
    fitted = dict(discounts=found.discounts, words=found.words, totals=[(step, totals) for step, _, totals in found.kept])
    models = [WC.Model(own, fitted) for own in rows.values()]
    known = np.concatenate([m.words for m in models])
    assert len(known) == found.words == 8
    asked = np.append(known, np.uint64(12345))  # and one that was never seen
    for before in asked:
        total = 0.0
        for m in [*models, WC.Model([], fitted)]:
            words = m.words if len(m.words) else np.array([12345], np.uint64)
            of = next((x for x in models if before in x.words), m if before not in known else None) or models[0]
            _, _, weight, _ = of.answers(np.array([before]), np.ones(1, int), np.array([before]) & WC.MASK)
            count, root, _, share = m.answers(words, np.ones(len(words), int), np.full(len(words), before & WC.MASK))
            own, _, _, _ = of.answers(np.array([before]), np.ones(1, int), np.array([before]) & WC.MASK)
            pairs = np.arange(len(words)) << 32 | len(words)
            total += WC.probabilities(pairs, np.append(count, own), np.c_[root, np.zeros(len(root))], np.c_[np.zeros_like(root), weight], share.copy()).sum()
        assert total == pytest.approx(1.0)


def test_hard_rows_in_any_chunks(spark):
    long = "word " * 30_000 + "w" * 5000 + " é" * 10
    docs = [(1, None), (2, ""), (3, "one two\tTHREE\x0bfour"), (3, "one two\tTHREE\x0bfour"), (None, "one"), (5, long), (6, long.upper()), (7, "\x00 \x00 a"), (9, "中文   x y")]
    df = spark.createDataFrame([(i, t, "a", 1, b"x") for i, t in docs], "doc_id long, text string, id string, chunk long, words binary")
    held = PY.held_out(df.doc_id)
    found = WC.scores(df, held).collect()
    check_plain_columns(found, docs, is_held)
    again = WC.scores(df.repartition(5), held, chunk=10).collect()
    order = lambda rows: sorted((str(r.id), r.n_tokens, r.held_out, r.n_known, round(r.score, 3)) for r in rows)
    assert order(found) == order(again)
    assert WC.scores(df.where("false"), held).collect() == []
    untrained = WC.scores(df, df.doc_id.isNull() | (df.doc_id > 0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 == r.base_score for r in untrained)


def test_numbers_in_planes():
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31], np.uint64)
    assert (WC.unpacked(WC.packed(numbers, np.uint64), np.uint64) == numbers).all()
    assert (WC._keys(WC._packed_keys(numbers << np.uint64(8))) == numbers << np.uint64(8)).all()


def test_disk_held_at_the_end(spark, monkeypatch):
    """Files of all steps that are still there when the scores have been written: scratch tables and shuffles."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(20_000)])
    docs = [(i, " ".join(words[np.minimum(rng.zipf(1.3, 1000), 20_000) - 1])) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    sc = spark.sparkContext
    tops = [Path(shared_dir(spark).removeprefix("file:"), "glintframe"), *(Path(d.getPath()) for d in sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    sizes = lambda: {f: f.stat().st_size for top in tops for f in top.rglob("*") if f.is_file()}
    before, held, discard = set(sizes()), [], WC.discard

    def watched(*tables):
        held.append(sum(size for f, size in sizes().items() if f not in before))
        discard(*tables)

    monkeypatch.setattr(WC, "discard", watched)
    found = WC.scores(df, df.doc_id % 7 == 2).collect()
    n = sum(r.n_tokens for r in found)
    assert n == 500 * 1001
    assert held[-1] < 11 * n


def test_places_in_gaps():
    places, known = np.array([0, 0, 3, 3, 9, 10**6]), np.array([True, True, False, True, True, True])
    assert WC.from_gaps(WC.gaps(places, known)).tolist() == [0, 0, -1, 3, 9, 10**6]
    assert WC.from_gaps(WC.gaps(places, np.zeros(6, bool))).tolist() == [-1] * 6
    assert len(WC.from_gaps(WC.gaps(places[:0], known[:0]))) == 0


def test_words_in_the_order_of_contexts():
    words = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (WC.turned_back(WC.turned(words)) == words).all()
    ordered = WC.turned_back(np.sort(WC.turned(words)))
    assert (np.diff((ordered & WC.MASK).astype(np.int64)) >= 0).all() and (np.diff(WC.bucket(ordered)) >= 0).all()


def test_words_of_one_hash_share_a_restaurant(spark):
    first, second = "w1689633", "w2670489"
    a, b = (PY._tokens([w])[0][0] for w in (first, second))
    assert a != b and a & WC.MASK == b & WC.MASK
    docs = [(i, f"{first if i % 2 else second} north " * 30) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = WC.scores(df, df.doc_id > 17).collect()
    assert all(r.base_score < r.score < 0 for r in found)
    together = {i: r.score for r in found for i in [r.id]}
    assert together[18] == pytest.approx(together[19], rel=0.02)
