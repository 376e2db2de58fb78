"""The Pitman-Yor model beside plain versions: counts and base scores, tables by their exact law, a sampler of single customers."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from glintframe.llm import pitman_yor as PY
from glintframe.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[str | None]:
    return [*WORD.findall((text or "").translate(LOWER)), None]


def contexts(words: list[str | None]) -> list[bytes]:
    return [b"", *[w.encode()[-2:] for w in words[:-1]]]


def check_plain_columns(found, docs, held) -> None:
    count = Counter(w for i, text in docs if not held(i) for w in tokens(text))
    n, v = sum(count.values()), len(count)
    rows = sorted(found, key=lambda r: (str(r.id), r.n_tokens))
    for r, (i, text) in zip(rows, sorted(docs, key=lambda d: (str(d[0]), len(tokens(d[1])))), strict=True):
        own = tokens(text)
        assert (r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0 or not n


def test_query(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    found = Q.op11_pitman_yor(spark, sf).withColumnRenamed("doc_id", "id").collect()
    check_plain_columns(found, docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in found if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.2
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def law(c: int, a: float, d: float) -> np.ndarray:
    """Probabilities of 1..c tables, by the recursion of the generalised Stirling numbers in logarithms."""
    s = np.full(c + 2, -np.inf)
    s[1] = 0.0
    for k in range(1, c):
        t = np.arange(1, k + 2)
        s[t] = np.logaddexp(s[t - 1], s[t] + np.log(np.maximum(k - d * t, 1e-300)))
    w = s[1 : c + 1] + np.arange(1, c + 1) * math.log(a)
    w = np.exp(w - w.max())
    return w / w.sum()


@pytest.mark.parametrize("c", [2, 7, 128, 129, 400, 1500])
@pytest.mark.parametrize("a", [0.001, 0.3, 2.0, 30.0])
@pytest.mark.parametrize("d", [0.3, 0.8])
def test_tables_by_their_law(c, a, d):
    want = law(c, a, d)
    rng = np.random.default_rng(c)
    got = PY.tables(np.full(20_000, c), np.full(20_000, a), d, rng.random(20_000), rng.random(20_000))
    assert got.min() >= 1 and got.max() <= c
    t = np.arange(1, c + 1)
    mean = (want * t).sum()
    deviation = math.sqrt((want * t * t).sum() - mean**2)
    # Beyond EXACT customers the limits of the law are drawn from: a table or two, or a tenth.
    slack = 4 * deviation / math.sqrt(20_000) + (0 if c <= PY.EXACT else 0.1 * mean + 0.3)
    assert abs(got.mean() - mean) <= slack
    if c <= PY.EXACT:
        assert np.abs(np.bincount(got, minlength=c + 1)[1:] / 20_000 - want).sum() < 0.08


class Plain:
    """Every customer sits at a table of its own restaurant's list; Gibbs takes each up and seats it again."""

    def __init__(self, discounts, words: int, seed: int) -> None:
        self.d, self.words, self.rng = discounts, words, random.Random(seed)
        self.rooms = defaultdict(lambda: defaultdict(list))
        self.n, self.t = Counter(), Counter()

    def p(self, level: int, context: bytes, word) -> float:
        if level < 0:
            return 1 / (self.words + 1)
        room, d = (level, context), self.d[level]
        own = self.rooms[room][word] if word in self.rooms[room] else []
        up = self.p(level - 1, context[1:] if level == 2 and len(context) == 2 else (context if level == 2 else b""), word)
        return (sum(own) - d * len(own) + (1 + d * self.t[room]) * up) / (1 + self.n[room])

    def up(self, level: int, context: bytes) -> bytes:
        return context[-1:] if level == 2 else b""

    def seat(self, level: int, context: bytes, word) -> None:
        if level < 0:
            return
        room, d = (level, context), self.d[level]
        own = self.rooms[room][word]
        weights = [size - d for size in own] + [(1 + d * self.t[room]) * self.p(level - 1, self.up(level, context), word)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        self.n[room] += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.t[room] += 1
            self.seat(level - 1, self.up(level, context), word)

    def leave(self, level: int, context: bytes, word) -> None:
        if level < 0:
            return
        room = (level, context)
        own = self.rooms[room][word]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.n[room] -= 1
        if not own[k]:
            own.pop(k)
            self.t[room] -= 1
            self.leave(level - 1, self.up(level, context), word)


def test_like_a_sampler_of_single_customers(spark):
    random.seed(5)
    lexicon = ["".join(random.choices("abcdé", k=random.randint(1, 4))) for _ in range(60)]
    follow = {w: random.choices(lexicon, k=4) for w in lexicon}
    docs = []
    for i in range(120):
        w, words = random.choice(lexicon), []
        for _ in range(25):
            words.append(w)
            w = random.choice(follow[w]) if random.random() < 0.7 else random.choice(lexicon)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.id: r for r in PY.scores(df, df.doc_id % 4 == 0, burn=6, samples=6).collect()}
    check_plain_columns(found.values(), docs, lambda i: i % 4 == 0)
    train = [(c, w) for i, text in docs if i % 4 for c, w in zip(contexts(tokens(text)), tokens(text))]
    pairs = Counter(train)
    parents = Counter((c[-1:], w) for c, w in pairs)
    roots = Counter(w for _, w in parents)
    discounts = []
    for counts in (roots, parents, pairs):
        n1, n2 = (sum(x == k for x in counts.values()) for k in (1, 2))
        discounts.append(min(0.95, max(0.05, n1 / max(n1 + 2 * n2, 1))))
    model = Plain(discounts, len(roots), 1)
    for c, w in train:
        model.seat(2, c, w)
    total, samples = defaultdict(float), 0
    for step in range(20):
        for c, w in train:
            model.leave(2, c, w)
            model.seat(2, c, w)
        if step >= 10:
            samples += 1
            for i, text in docs:
                if i % 4 == 0:
                    for k, (c, w) in enumerate(zip(contexts(tokens(text)), tokens(text))):
                        total[i, k] += model.p(2, c, w)
    plain = defaultdict(float)
    for (i, _), p in total.items():
        plain[i] += math.log10(p / samples)
    a, b = (sum(x) / 26 / len(plain) for x in (plain.values(), (found[i].score for i in plain)))
    assert abs(a - b) < 0.01
    assert max(abs(plain[i] - found[i].score) / 26 for i in plain) < 0.05


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b b b c", "", None, "é a ü", "x " * 300 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "false AS held", "text")
    kept, totals = PY.fit(PY._scanned(df, 1 << 20))
    rows = [r.asDict() for r in kept.where("kind = 0").collect()]
    models = [PY.Model({k: bytes(r[k]) for k in PY.EMPTY}, totals) for r in rows]
    for key in (0, ord("a") << 8, 0x4142, 0xA9C3):
        known = sum(m.probability(np.arange(len(m.own.words)), np.full(len(m.own.words), key)).sum() for m in models)
        unknown = models[0].probability(np.array([-1]), np.array([key]))[0]
        assert known + unknown == pytest.approx(1.0)


def test_hard_rows_in_any_chunks(spark):
    long = "word " * 30_000 + "w" * 5000 + " é" * 10
    docs = [(1, None), (2, ""), (3, "one two\tTHREE\x0bfour"), (3, "one two\tTHREE\x0bfour"), (None, "one"), (5, long), (6, long.upper()), (7, "\x00 \x00 a"), (9, "中文   x y")]
    df = spark.createDataFrame([(i, t, "a", 1, b"x") for i, t in docs], "doc_id long, text string, id string, chunk long, words binary")
    held = PY.held_out(df.doc_id)
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    found = PY.scores(df, held).collect()
    check_plain_columns(found, docs, is_held)
    again = PY.scores(df.repartition(5), held, chunk=10).collect()
    order = lambda rows: sorted((str(r.id), r.n_tokens, r.held_out, r.n_known, round(r.score, 3)) for r in rows)
    assert order(found) == order(again)
    assert PY.scores(df.where("false"), held).collect() == []
    untrained = PY.scores(df, df.doc_id.isNull() | (df.doc_id > 0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 == r.base_score for r in untrained)
