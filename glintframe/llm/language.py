"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it has a binary n-gram classifier (log odds of hashed byte
trigrams between the languages with that bit and those without).  A text's margins
for all bits are decoded to the codeword of least loss, where a bit weighs as much as its
classifier separates; near ties are flagged as ambiguous.

Fitting counts trigrams of a bounded sample: about ``per_language`` labelled documents of each
language, chosen by a hash of the id, so a frequent language costs no more than a rare one.
What reaches the driver are counts by language and by (language, trigram bucket).

Defined cases: a null text or one without a letter is ``und`` with score 0; a null label
isn't learned from; a null id hashes as the empty string; with nothing to learn from all
is ``und``; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

BUCKET_BITS = 16
BLOCK = 1 << 20
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the whole lower-cased text, a block at a time."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data) - 2, BLOCK):
        part = data[at : at + BLOCK + 2].astype(np.uint32)
        gram = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        yield (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each language: all distinct splits of up to 7 languages, else the best-separated of seeded random codes."""
    if n == 0:
        return np.zeros((0, 0), np.float32)
    if n <= 7:
        splits = np.arange(1, 2 ** max(0, n - 1))
        return np.array([[1 if not k or not (s >> (k - 1)) & 1 else -1 for s in splits] for k in range(n)], np.float32).reshape(n, -1)
    rng = np.random.default_rng(7)
    codes = [rng.choice([-1.0, 1.0], (n, 15 * int(np.ceil(np.log2(n))))).astype(np.float32) for _ in range(50)]
    return max(codes, key=lambda c: -np.max(c @ c.T - 2 * c.shape[1] * np.eye(n)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit, log odds
    trust: np.ndarray  # by bit
    gain: float  # how fast a margin becomes certain
    ambiguous_below: float  # least lead of the first language over the second

    def decode(self, margins: np.ndarray, grams: int) -> tuple[str, float, bool]:
        sure = self.gain * np.sqrt(min(grams, 400))
        loss = (np.logaddexp(0, -self.codes * margins * sure) * self.trust).sum(axis=1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        lead = share[order[0]] - (share[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(share[order[0]]), bool(lead < self.ambiguous_below)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        total, grams = np.zeros(self.weights.shape[1]), 0
        for part in buckets(text):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            grams += len(part)
        return self.decode(total / max(1, grams), grams)


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows (lang, text) of each language, by a hash of the id; no sort, no shuffle of texts."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # as many rows as languages
    if not counts:
        return labelled.select("lang", "text").where("false")
    u = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keep = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["n"]))]), F.col("lang"))
    return labelled.where(u < keep).select("lang", "text")


def fit(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 5000, smoothing: float = 0.5, gain: float = 1.0, ambiguous_below: float = 0.2) -> Model:
    """Learns from the rows of ``docs`` where ``train`` holds.  per_language: bound of the sample."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = own.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for part in buckets(text.as_py()):
                    sums += np.bincount(part, minlength=1 << BUCKET_BITS)
        for lang, sums in own.items():
            at = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])

    counted = sample(rows, per_language).mapInArrow(count, "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    names = found.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    where = {lang: k for k, lang in enumerate(languages)}
    counts = np.full((len(languages), 1 << BUCKET_BITS), smoothing)
    if languages:
        counts[[where[x] for x in names], found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    share = counts / counts.sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((1 << BUCKET_BITS, codes.shape[1]), np.float32)
    trust = np.zeros(codes.shape[1])
    for bit in range(codes.shape[1]):
        ones, zeros = share[codes[:, bit] > 0].mean(axis=0), share[codes[:, bit] < 0].mean(axis=0)
        odds = np.log(ones) - np.log(zeros)
        weights[:, bit] = odds
        trust[bit] = ((ones - zeros) * odds).sum()
    trust = trust / trust.mean() if len(trust) else trust
    return Model(languages, codes, weights, trust, gain, ambiguous_below)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous; nothing but the text is looked at."""
    added = ("lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("ambiguous", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [f.name for f in schema.fields])

    (text_as,) = fresh(docs, "language__text")
    return docs.select(*kept, F.col(text_col).cast("string").alias(text_as)).mapInArrow(run, schema)
