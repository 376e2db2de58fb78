"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from glintframe.llm import editcounts, exact, flac, language, mixing, packing, pii, simhash, simhash_wide, urls, warc
from glintframe.llm.queries import URL_RULES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, fp string, host string, pii string, times string"
LONG = "alpha beta gamma " * 40_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13),
    (4, "ONE two Three", "fr", None, 13), (None, "one two three", None, "b", 13), (5, LONG, "en", "a", len(LONG)), (6, " \t\n", None, "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "h", "p", "t") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def apply(name: str, df):
    if name == "mix":
        return mixing.mix(df)
    if name == "pii":
        return pii.pseudonymise(df, key="k")
    if name == "urls":
        return urls.filter_urls(df, URL_RULES, url_col="text")
    if name == "counts":
        edits = F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit("x").alias("insert")))
        return editcounts.apply_edits(editcounts.count_trees(df.withColumn("edits", edits), tokenizer(), carry=["edits"]), tokenizer())
    if name == "simhash":
        return simhash.near_duplicates(df)
    if name == "wide":
        return simhash_wide.drop_near_copies(df)
    if name == "flac":
        return flac.digest(flac.encode(df))
    if name == "exact":
        return exact.exact_duplicates(df, columns=df.columns)
    if name == "language":
        return language.predict(df, language.fit(df, F.lit(True)))
    if name == "warc":
        return warc.read_members(warc.archive(df.withColumn("url", F.lit(None).cast("string")), id_col="doc_id", payload_col="text"))
    return packing.pack(packing.pieces(df, tokenizer()))


NAMES = ["mix", "pii", "urls", "counts", "simhash", "wide", "flac", "exact", "language", "warc", "pack"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, name):
    assert apply(name, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("wide", "pack")])
def test_a_row_for_each(docs, name):
    assert apply(name, docs).count() == len(ROWS)


def test_exact_keeps_one_of_each(docs):
    rows = apply("exact", docs).collect()
    kept = [r for r in rows if r.kept]
    assert sorted((r.doc_id, r.group_size) for r in kept) == [(2, 2), (4, 4), (5, 1), (6, 1)]
    assert {r.keep_id for r in rows if r.group_size == 4} == {4}


def test_exact_tells_clashing_digests_apart(docs):
    rows = exact.exact_duplicates(docs, digest=lambda text: F.lit(b"same")).collect()
    assert sorted((r.doc_id, r.group_size) for r in rows if r.kept) == [(2, 2), (4, 4), (5, 1), (6, 1)]


def test_exact_in_many_batches(docs):
    rows = exact.exact_duplicates(docs.repartition(5), files_per_batch=1).collect()
    assert sorted((r.doc_id, r.group_size) for r in rows if r.kept) == [(2, 2), (4, 4), (5, 1), (6, 1)]


def test_simhash_empty_is_zero(docs):
    rows = apply("simhash", docs).collect()
    assert {r.fp for r in rows if r.id in (1, 2, 6)} == {0}
    assert {r.component_id for r in rows if r.id in (3, 4)} == {3}


def test_language_of_nothing(docs):
    assert {r.lang_pred for r in apply("language", docs).collect() if r.doc_id in (1, 2, 6)} == {"und"}


def test_near_copies_one_of_each_stays(spark):
    words = [f"w{i}" for i in range(400)]
    near = list(words)
    near[200] = "changed"
    rows = [(10, " ".join(words)), (11, " ".join(near)), (12, " ".join(reversed(words))), (13, None), (14, None), (15, "w1 w2 w3")]
    kept = simhash_wide.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [10, 12, 13, 14, 15]


def test_pii_keeps_formats(spark):
    text = "card 4111111111111111, +1 (017) 555-7713, a.b@x.example.com, 2020-02-29, 31.12.1999, DE89370400440532013000, 10.0.0.1, 078-05-1120; 4111111111111112 30.02.2020 stay"
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.pseudonymise(df, key="k").collect()}
    assert found[1].text == found[2].text != text and found[3].text is None and found[4].text == ""
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", s))
    assert shape(found[1].text.split("DE")[0]) == shape(text.split("DE")[0]) and found[1].text.endswith("; 4111111111111112 30.02.2020 stay")
    digits = [int(c) for c in re.search(r"card (\d{16})", found[1].text)[1]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    other = {r.doc_id: r for r in pii.pseudonymise(df, key="another").collect()}
    assert other[1].text != found[1].text


def test_flac_rejects_broken_frames(spark, docs):
    media = flac.encode(docs.where("doc_id = 5"))
    name = next(f.name for f in media.schema.fields if f.dataType.simpleString() == "binary")
    broken = media.withColumn(name, F.concat(F.expr(f"substring({name}, 1, length({name}) - 9)"), F.lit(b"\x00\x01\x02"), F.expr(f"substring({name}, length({name}) - 5, 6)")))
    with pytest.raises(Exception, match="ValueError"):
        flac.digest(broken).collect()


def test_packing_of_a_hot_length(spark):
    cut = spark.range(5000).select(F.when(F.col("id") < 3000, 700).otherwise(F.col("id") % 2048 + 1).cast("long").alias("length"))
    placed = packing.pack(cut)
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"), F.count("*").alias("k"), F.countDistinct("offset").alias("places"))
    assert placed.count() == 5000 and bins.where("n > 2048 or n <> top or k <> places").count() == 0


def test_pii_key_is_in_no_plan(spark, docs):
    found = pii.pseudonymise(docs, key="a-very-secret-key")
    said = found._jdf.queryExecution().toString() + found._jdf.queryExecution().executedPlan().treeString()
    assert "a-very-secret-key" not in said and found.columns.count("pii") == 1 and "pii__key" not in found.columns
