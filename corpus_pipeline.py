"""The corpus pipeline: language, exact copies, near copies, mixture, packing.

Each stage takes what the one before kept, as a table with the columns of ``documents``; the
last returns where each piece of each document lies in the packed sequences.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm import exact, language, mixing, packing, simhash_wide
from glintframe.llm.common import collected, delete, discard, table, written
from glintframe.llm.queries import labelled, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[..., DataFrame]
#: Scratch tables of the stage that was called last by itself, outside ``run``.
_alone: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Stage:
    """A stage called with ``docs``, the written result of the one before, whose scratch tables (``before``) are then deleted.

    The first stage deletes nothing: what another run has returned is read lazily and stays until the driver ends.
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, before: list[str] | None = None) -> DataFrame:
        before = _alone if before is None else before
        if work.__name__ != STAGES[0][1].__name__:
            delete(spark, *before)
        with collected() as made:
            out = work(spark, docs.select(*COLUMNS), sf_dir)
        before[:] = made
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is told; those without a letter (null and empty ones too), or between two languages, go.  A null lang becomes the one told."""
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    told = language.predict(docs, model)
    kept = told.where((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; a null text equals an empty one, of equal rows one stays."""
    return exact.drop_exact_duplicates(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the one with the least id; texts without a word are near none."""
    return simhash_wide.drop_near_copies(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; labels weigh the choice.  A null source is a source."""
    labels = table(spark, sf_dir, "labels")
    return mixing.mixture(docs, lambda slim: (labelled(slim, labels, "id"), F.col("label__quality")))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated ones each time, in sequences; a null text is an empty one."""
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixture),
    ("best-fit packing", pack),
]

#: Language ID, fingerprints and token ids are no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, scratch = table(spark, sf_dir, "documents"), [], []
    for n, (name, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir, scratch)
        if n < len(STAGES):
            docs = written(docs, f"pipeline-{n}")
            discard(*before)
            before = [docs]
    return docs
