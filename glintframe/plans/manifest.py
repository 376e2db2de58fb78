"""Registered queries: manifests made of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import let
from glintframe.operators import manifest as M
from glintframe.plans.registry import Registry
from glintframe.session import stored, with_checkpoints, workspace
from glintframe.sources.hash_index import HashIndex
from glintframe.tables import table

reg = Registry()


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: /source/lang/name.ext."""
    kinds = F.element_at(F.array(*map(F.lit, ("gan.PNG", "photo.jpg", "sd15.webp", "note.txt", "flux.bmp"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), kinds)
    return table(spark, d, "documents").select("doc_id", path.alias("image_path"), "source", "lang", "n_chars")


PATHS_SQL = """paths AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '_' || ['gan.PNG','photo.jpg','sd15.webp','note.txt','flux.bmp'][(doc_id % 5 + 1)::INT] AS image_path, source, lang, n_chars FROM documents)"""


@reg(f"WITH {PATHS_SQL} SELECT doc_id, lower(regexp_extract(image_path, '(\\.[^./]+)$', 1)) AS extension FROM paths WHERE lower(regexp_extract(image_path, '(\\.[^./]+)$', 1)) IN ('.jpg','.jpeg','.png','.webp','.bmp')")
def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).where(M.supported(F.col("image_path"))).select("doc_id", M.extension(F.col("image_path")).alias("extension"))


HINT = "(" + " OR ".join(f"contains(lower(image_path), '{h}')" for h in M.FAKE_HINTS) + ")"
GEN = "CASE " + " ".join(f"WHEN contains(t, '{g}') THEN '{g}'" for g in M.GENERATORS) + " END"


@reg(f"""WITH {PATHS_SQL}, t AS (SELECT doc_id, image_path, unnest(string_split(lower(image_path), '/')) AS t, generate_subscripts(string_split(lower(image_path), '/'), 1) AS i FROM paths),
g AS (SELECT doc_id, arg_max({GEN}, i) FILTER (({GEN}) IS NOT NULL) AS g FROM t GROUP BY doc_id)
SELECT p.doc_id, {HINT}::INT AS label, CASE WHEN contains(image_path, 'cifake') THEN 'cifake' ELSE coalesce(g, 'unknown') END AS generator FROM paths p JOIN g ON p.doc_id = g.doc_id""")
def classify_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("image_path")
    return paths(spark, d).select("doc_id", M.path_label(path).alias("label"), M.path_generator(path).alias("generator"))


@reg("SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return M.keep_first(table(spark, d, "documents").select("text", "doc_id", "source"), "text", "doc_id")


@reg("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS position FROM events GROUP BY user_id")
def upsert_keep_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return M.upsert_keep_last(e.withColumn("at", F.col("event_id")), "user_id", "at").drop("at")


@reg("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT *, greatest(1, floor(n * 15e-2))::BIGINT AS k FROM n)
SELECT lang, source, 'val' AS split, least(k, n) AS n FROM k UNION ALL SELECT lang, source, 'test', least(k, n - k) FROM k WHERE n > k UNION ALL SELECT lang, source, 'train', n - 2 * k FROM k WHERE n > 2 * k""")
def stratified_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    split = M.stratified_split(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")
    return split.groupBy("lang", "source", "split").agg(F.count("*").alias("n"))


@reg("""WITH l AS (SELECT doc_id, ['real','AI ','1','0.0','Camera','generated-ai','x'][(doc_id % 7 + 1)::INT] AS raw FROM documents)
SELECT doc_id, CASE WHEN lower(trim(raw)) IN ('real','0','authentic','camera') THEN 0 WHEN lower(trim(raw)) IN ('ai','fake','1','generated-ai') THEN 1 ELSE trunc(try_cast(lower(trim(raw)) AS DOUBLE))::INT END AS label,
CASE WHEN lower(trim(raw)) IN ('1','true','yes','ai') THEN true WHEN lower(trim(raw)) IN ('0','false','no','real') THEN false ELSE trunc(try_cast(lower(trim(raw)) AS DOUBLE))::INT <> 0 END AS is_ai FROM l""")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("real", "AI ", "1", "0.0", "Camera", "generated-ai", "x"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", M.normal_label(raw).alias("label"), M.parse_ai(raw).alias("is_ai"))


@reg("SELECT text, min(id) AS id, arg_min(origin, id) AS origin FROM (SELECT text, item_id AS id, 'benchmark' AS origin FROM benchmark UNION ALL SELECT text, doc_id + 1000000, 'documents' FROM documents) GROUP BY text")
def manifest_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "benchmark").select("text", F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    b = table(spark, d, "documents").select("text", (F.col("doc_id") + 1000000).alias("id"), F.lit("documents").alias("origin"))
    return M.keep_first(M.union_manifests(a, b), "text", "id")


@reg("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def holdout_antijoin(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("a\\"), F.col("doc_id").cast("string"))
    train = table(spark, d, "documents").select("doc_id", key.alias("path"))
    return M.exclude(train, table(spark, d, "labels").select(F.regexp_replace(key, r"\\", "/").alias("path")), "path").select("doc_id")


@reg("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def leakage_semi(spark: SparkSession, d: str) -> DataFrame:
    return M.overlap(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@reg("""SELECT count(*) AS rows_in, count(*) FILTER (doc_id IS NOT NULL AND quality IS NOT NULL) AS rows_kept, min(quality) AS low, max(quality) AS high FROM labels""")
def manifest_validate(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("image_path"), F.col("quality").cast("string").alias("label"))
    clean = M.validate(raw)
    return raw.agg(F.count("*").alias("rows_in")).crossJoin(clean.agg(F.count("*").alias("rows_kept"), F.min("label").alias("low"), F.max("label").alias("high")))  # one row each


def tile_hashes(spark: SparkSession, d: str) -> DataFrame:
    """64-bit sign hashes of embeddings: a bit for each component above the median."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    middle = let(F.array_sort(e), lambda s: (F.element_at(s, 32) + F.element_at(s, 33)) / 2)  # sorted once a row
    bits = let(middle, lambda m: F.aggregate(F.transform(e, lambda x: (x > m).cast("long")), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b)))
    return table(spark, d, "embeddings").select("vec_id", bits.alias("hash"))


HASH_SQL = """med AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
srt AS (SELECT vec_id, e, (list_sort(e)[32] + list_sort(e)[33]) / 2 AS m FROM med),
bits AS (SELECT vec_id, list_aggregate(list_transform(e, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), 'string_agg', '') AS b FROM srt),
hashes AS (SELECT vec_id, b::BIT AS h FROM bits)"""


@reg(f"WITH {HASH_SQL} SELECT vec_id, bit_count(h)::INT AS ones, b AS bits FROM hashes JOIN bits USING (vec_id)")
def phash_tile(spark: SparkSession, d: str) -> DataFrame:
    h = tile_hashes(spark, d)
    return h.select("vec_id", F.bit_count("hash").alias("ones"), F.lpad(F.conv(F.hex("hash"), 16, 2), 64, "0").alias("bits"))


#: Near hashes planted beside those of the tiles: two bits of every third are turned, five of every ninth.
NEAR_SQL = f"""{HASH_SQL}, near AS (SELECT vec_id, h FROM hashes UNION ALL SELECT vec_id + 1000000, xor(h, lpad('101', 64, '0')::BIT) FROM hashes WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id + 2000000, xor(h, lpad('11111', 64, '0')::BIT) FROM hashes WHERE vec_id % 9 = 0)"""


def near_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = tile_hashes(spark, d)
    turned = lambda step, more, mask: h.where(F.col("vec_id") % step == 0).select((F.col("vec_id") + more).alias("vec_id"), F.col("hash").bitwiseXOR(F.lit(mask).cast("long")).alias("hash"))
    return stored(h.unionByName(turned(3, 1_000_000, 0b101)).unionByName(turned(9, 2_000_000, 0b11111)), "hashes")


@reg(f"WITH {NEAR_SQL} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM near a JOIN near b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 4")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.hamming_pairs(near_hashes(spark, d), "vec_id", "hash", 4)


@reg()
def near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Greedy in id order: no SQL; tests compare it with a loop."""
    with_checkpoints(spark)
    h = near_hashes(spark, d)
    return M.greedy_keep(h, M.hamming_pairs(h, "vec_id", "hash", 4), "vec_id", "vec_id").select("vec_id")


@reg()
def near_dup_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The same greedy choice of three arrivals, each met with an index that lasts instead of with the rows before it."""
    with_checkpoints(spark)
    h = near_hashes(spark, d)
    index = HashIndex(spark, workspace(spark, "index"))
    for part in (F.col("vec_id") < 300, F.col("vec_id").between(300, 999_999), F.col("vec_id") > 999_999):
        index.add(h.where(part), "vec_id", "hash")
    return index.rows().select(F.col("id").alias("vec_id"))


@reg("""SELECT b.item_id, count(d.doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON b.text = d.text GROUP BY b.item_id""")
def leakage_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "benchmark")
    same = table(spark, d, "documents").select("doc_id", F.col("text").alias("own"))
    return held.join(same, F.col("text") == F.col("own"), "left").groupBy("item_id").agg(F.count("doc_id").alias("documents"))


@reg("SELECT doc_id, 'img.' || doc_id AS image_id, lang AS state FROM documents")
def holdout_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Image and state of each row of a holdout, from its path."""
    path = F.concat(F.lit("bench\\"), "lang", F.lit("/img."), "doc_id", F.lit(".png"))
    rows = table(spark, d, "documents").select("doc_id", path.alias("path"), "lang")
    return rows.select("doc_id", M.path_stem(F.col("path")).alias("image_id"), M.path_parent(F.col("path")).alias("state"))
