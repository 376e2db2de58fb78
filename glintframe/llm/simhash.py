"""SimHash near-duplicates, linked by pigeonring filtering.

A fingerprint of 64 bits is cut into four segments on a ring.  If two fingerprints differ in
at most 3 bits, some segment starts a chain whose first l segments differ in at most
floor(3 l / 4) bits together, for every l: 0, 1, 2, 3 (pigeonring principle).  The first two
links of the chain are the join key: the first segment as it is, the second as it is or with
one bit changed.  To meet each pair once, only the fingerprint that has a 0 there flips it.
So a key has 32 bits, and the third and fourth budgets, checked in the join, leave pairs that
are within distance.  Nothing is capped.

Fingerprints are made unique first, so copies, however many, never meet in a join.  Links
between unique fingerprints are closed to components by alternating star contractions.

Defined cases: a null or wordless text has fingerprint 0, linked like any other; fewer words
than a shingle has make one shingle; null ids are ignored when a component is named (null
only if all its ids are); repeated rows stay; an empty table gives an empty result.  The
result has only the id, so no column of the input can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, WORD, written
from .components import components

SEGMENTS, SEGMENT_BITS, DISTANCE = 4, 16, 3
#: Shingles hashed at a time, whatever a text's length.
BLOCK = 1 << 16
_words = re.compile(WORD).findall


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """Of each bit: 1 if set in over half of the hashes of all shingles."""
    words = _words(text.translate(ASCII_LOWER)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : min(n, at + BLOCK) + width - 1]
        shingles = map(" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [" ".join(words)]
        hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42) -> DataFrame:
    """id and its text's fingerprint as a signed long ``fp``: one pass, no shuffle."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py(), width, seed) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def links(unique: DataFrame) -> DataFrame:
    """Pairs (a, b) of the unique fingerprints in ``fp`` that differ in at most 3 bits."""
    fp = F.col("fp")
    starts = F.explode(
        F.array(*[F.struct(F.lit(i).alias("start"), _segment(fp, i).alias("first"), _segment(fp, i + 1).alias("second")) for i in range(SEGMENTS)])
    )
    chains = unique.select("fp", starts.alias("c")).select(
        "fp", ((F.col("c.start").cast("long") * 65536 + F.col("c.first")) * 65536 + F.col("c.second")).alias("chain")
    )
    flips = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda j: F.getbit(F.col("chain"), j) == 0)
    near = F.transform(flips, lambda j: F.col("chain") + F.pow(F.lit(2.0), j).cast("long"))
    probes = chains.select(F.col("fp").alias("a"), F.col("chain").alias("exact"), F.explode(F.concat(F.array("chain"), near)).alias("key"))
    stored = chains.select(F.col("fp").alias("b"), F.col("chain").alias("key"))
    start = F.floor(F.col("key") / F.lit(2**32))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    budget = F.lit(False)
    for i in range(SEGMENTS):
        so_far = F.bit_count(_segment(apart, i + 1)) + F.bit_count(_segment(apart, i + 2))
        budget = F.when(start == i, so_far <= 2).otherwise(budget)
    exact = F.col("exact") == F.col("key")
    found = probes.join(stored, "key").where(budget & (F.bit_count(apart) <= DISTANCE) & (~exact | (F.col("a") < F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: id, ``fp`` and component_id, the smallest id linked to it through any chain of links."""
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed), "simhash-fp")
    unique = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    unique = written(unique, "simhash-unique")
    closed = components(written(links(unique.select("fp")), "simhash-links"))
    rooted = unique.join(closed.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-rooted")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select(F.col("fp").alias("own"), "component_id")
    named = written(named, "simhash-names")
    return fps.join(named, F.col("fp") == F.col("own")).select("id", "fp", "component_id")
