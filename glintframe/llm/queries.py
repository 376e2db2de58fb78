"""The registered queries: thin, each over its whole table through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import editcounts, exact, flac, language, mixing, packing, pii, pitman_yor, simhash, trie, urls, variants, warc, word_contexts
from .common import table

LABEL_QUALITY = {1: 2.0, 0: 0.5}


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with label__quality, the sampling weight of a document's label; unlabelled ones weigh 1."""
    best = labels.groupBy(F.col("doc_id").alias("label__id")).agg(F.max("quality").alias("label__value"))
    weight = F.when(F.col("label__value") == 1, LABEL_QUALITY[1]).when(F.col("label__value") == 0, LABEL_QUALITY[0]).otherwise(1.0)
    joined = docs.join(best, F.col(id_col) == F.col("label__id"), "left")
    return joined.withColumn("label__quality", weight).drop("label__id", "label__value")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    docs = labelled(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, size=F.col("words"), quality=F.col("label__quality"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH label AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
doc AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0)
      / (CASE l.q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM documents d LEFT JOIN label l ON d.doc_id = l.doc_id),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM doc GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((r - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (
  SELECT source, source_size,
    coalesce(least(cap, (max(CASE WHEN level <= cap / w THEN level END) OVER ()) * w), cap) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM doc d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN through - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""

#: The registered query's key; a deployment passes its own.
PII_KEY = "glintframe-registered-query"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, key=PII_KEY)
    counts = [F.coalesce(F.element_at("pii", kind), F.lit(0)).alias(kind) for kind in pii.KINDS]
    return found.select("doc_id", "text", *counts)


#: Pages whose file is a number below this, divisible by three, are blocked by a rule each.
URL_NUMBERS = 9000
#: Host rules by longest match, then token rules that block, a line of a filter list for each of some thousand files, and lines that allow.
URL_RULES = [
    *(urls.host_rule(name, urls.ALLOW) for name in ("org/", "com/fr/")),
    *(urls.host_rule(name, urls.BLOCK) for name in ("example.org/es/", "example.org/en/1", "com/de/")),
    *(urls.word_rule(*words) for words in (("casino",), ("free", "bets"), ("cheap", "pills"), ("spam", "farm"), ("ads", "track"), ("poker",), ("porn",), ("viagra",))),
    *(urls.filter_rule(f"/{k}.html|") for k in range(0, URL_NUMBERS, 3)),
    urls.filter_rule("||tracker.example.*^"), urls.filter_rule("@@||example.net^*/66*.html|"), urls.filter_rule("utm_source=popup"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, strpos(url, '://') AS s FROM pages),
q AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN s > 0 THEN substr(url, s + 3) ELSE '' END AS rest FROM p),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
  ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
fit AS (
  SELECT h.page_id, h.url, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM h JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath) GROUP BY ALL)
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.verdict, CASE WHEN regexp_matches(h.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*\.)?example\.net[^A-Za-z0-9_.%-].*/66[^\n]*\.html$') THEN 'allow'
  WHEN regexp_matches(h.host || chr(10) || h.path || chr(10) || h.url,
  '(^|[^A-Za-z0-9])(casino|free[-._/]bets|cheap[-._/]pills|spam[-._/]farm|ads[-._/]track|poker|porn|viagra)($|[^A-Za-z0-9])')
  OR regexp_matches(h.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*\.)?tracker\.example\.([^\n]*[^A-Za-z0-9_.%-]|[^\n]*$)') OR contains(h.url, 'utm_source=popup')
  OR (try_cast(regexp_extract(h.url, '/([1-9][0-9]{0,3}|0)\.html$', 1) AS INT) < 9000 AND try_cast(regexp_extract(h.url, '/([1-9][0-9]{0,3}|0)\.html$', 1) AS INT) % 3 = 0)
  THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit ON h.page_id IS NOT DISTINCT FROM fit.page_id AND h.url = fit.url
"""


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted, then revised in three places: its middle, its start and its end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    places = [(F.floor(n / 2), 12, "revised, "), (F.lit(0), 0, "Draft 2: "), (n + 64, 0, " End.")]
    edits = F.array(*[F.struct(at.cast("long").alias("start"), F.lit(k).cast("long").alias("length"), F.lit(x).alias("insert")) for at, k, x in places])
    trees = editcounts.count_trees(docs.withColumn("edits", edits), tokenizer(), carry=["edits"])
    return editcounts.apply_edits(trees, tokenizer()).select("doc_id", "tokens_before", "n_tokens", "reencoded")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(flac.encode(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read_members(warc.archive(pages))
    return found.select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h, n >= 100) AS first_id FROM q)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_contexts.scores(table(spark, sf_dir, "documents"), pitman_yor.held_out(F.col("doc_id")))
    return found.withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of a conversation's number is spelled out: bytes, and the eight bits of each.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT c, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 6 AS h FROM t),
r AS (
  SELECT c.c, 0 AS part, b.pos, b.role, b.text FROM c JOIN t b ON b.c = c.c - c.c % 100 AND b.pos < c.h
  UNION ALL SELECT c.c, 1, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.pos >= c.h),
arr AS (SELECT c, list({'r': role, 't': text} ORDER BY part, pos) AS a FROM r GROUP BY c),
whole AS (SELECT c.c, coalesce(arr.a, []) AS a FROM c LEFT JOIN arr ON c.c = arr.c),
path AS (SELECT c, a[1:d] AS p, d, len(a) = d AS ends FROM (SELECT c, a, unnest(range(len(a) + 1)) AS d FROM whole)),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '') AS ids,
    CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].t) ELSE 0 END AS own FROM path GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS up, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
leaf AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON node.p = kids.up AND node.d = kids.d),
below AS (SELECT p[1:e] AS p, e, sum(own) AS saved, sum((k = 0)::INT) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM leaf) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, x.k AS n_children, below.leaves::BIGINT AS n_leaves,
  below.saved::BIGINT AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM leaf x JOIN below ON x.p = below.p AND x.d = below.e LEFT JOIN node u ON u.p = x.p[1:x.d - 1] AND u.d = x.d - 1
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_url_filters": op3_url_filters,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_flac": op6_flac,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_pitman_yor": op11_pitman_yor,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_mixing": OP1_SQL,
    "op3_url_filters": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op13_prefix_trie": OP13_SQL,
}
