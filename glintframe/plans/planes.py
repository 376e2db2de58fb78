"""Registered queries: image planes and feature vectors.

Images are the given rows' bytes as rasters: those of ``pages``, and of labelled ``documents`` where an ensemble is fitted.  Pixel
transforms have no SQL: the tests hold them against plain numpy, image by image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit
from glintframe.operators import arbiter as A
from glintframe.operators import models as M
from glintframe.operators import narrative as N
from glintframe.operators import planes as P
from glintframe.operators import verdict as V
from glintframe.operators.analysis import analyze
from glintframe.plans.registry import Registry, rounded
from glintframe.session import stored, workspace
from glintframe.sources.contents import images as load_images
from glintframe.sources.contents import write_contents
from glintframe.sources.raster import raster
from glintframe.tables import table

reg = Registry()
SIDE = 64
SMALL = M.Config(trees=10, tree_depth=4, boosts=5, boost_depth=3, waves=32, iterations=50)


def images(spark: SparkSession, d: str) -> DataFrame:
    """(id, pixels, height, width, channels): the bytes of each page."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    return spread(raster(pages, F.col("content")).drop("content"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(id, y, generator, pixels, height, width, channels): the bytes of each labelled document, its quality and its source."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("generator"), F.col("text").cast("binary").alias("content"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    return spread(raster(docs.join(labels, "id"), F.col("content")).drop("content"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in three tasks a core at least, so that no core is idle for long while the last ones end: an image costs far more work than its bytes cost to move."""
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


@reg("""WITH p AS (SELECT page_id AS id, encode(coalesce(html, '')) AS b FROM pages),
w AS (SELECT id, b, greatest(8, ceil(sqrt(octet_length(b) / 3e0)))::INT AS width FROM p),
h AS (SELECT id, b, width, greatest(8, ceil(octet_length(b) / (width * 3e0)))::INT AS height FROM w)
SELECT id, height, width, sha256(b || repeat('\x00'::BLOB, (3 * width * height - octet_length(b))::INT)) AS sha256 FROM h""")
def raster_images(spark: SparkSession, d: str) -> DataFrame:
    """Each page's bytes as an image: no byte is left out."""
    return images(spark, d).select("id", "height", "width", F.sha2("pixels", 256).alias("sha256"))


@reg()
def synthetic_images(spark: SparkSession, d: str) -> DataFrame:
    """An image from each page's number as its seed."""
    made = P.synthetic(table(spark, d, "pages").select(F.col("page_id").alias("id")), SIDE)
    return made.select("id", "label", "height", "width", F.sha2("pixels", 256).alias("sha256"))


@reg()
def preprocessed_planes(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each plane, letterboxed to 48 pixels."""
    return P.measured(images(spark, d), ["means"], 48).select("id", "height", "width", "plane__means.*")


@reg()
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    return P.extract(images(spark, d), SIDE).select("id", "features")


@reg()
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """One row for each feature and image, by name."""
    names = F.array(*[F.lit(n) for n in P.feature_columns()])
    return P.extract(images(spark, d), SIDE).select("id", F.inline(F.arrays_zip(names.alias("name"), F.col("features").alias("value"))))


@reg("SELECT vec_id, '64,8,db4,3,24,18' AS signature FROM embeddings WHERE vec_id % 3 <> 0")
def feature_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose features, by content and settings, no cache table has."""
    rows = table(spark, d, "embeddings").select("vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"), F.lit(P.signature(side=SIDE)).alias("signature"))
    cached = rows.where("vec_id % 3 = 0").select("sha256", "signature")
    return P.missing(rows, cached).select("vec_id", "signature")


@reg("SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 64")
def feature_cache_bounded(spark: SparkSession, d: str) -> DataFrame:
    return P.bounded(table(spark, d, "embeddings").select("vec_id"), "vec_id", 64)


def varied(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = P.variants(images(spark, d), kind, "id" if kind == "augmented" else None)
        return rows.select("id", "variant", "number", "height", "width", F.sha2("pixels", 256).alias("sha256"))

    query.__name__ = f"{kind}_variants"
    return query


tta_variants, demo_variants, benchmark_variants, augmented_variants = (reg()(varied(kind)) for kind in P.VARIANTS)


@reg()
def training_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The rows that an ensemble is fitted to: each labelled image and its degraded form."""
    return P.extract(labelled(spark, d), SIDE, "augmented", "id").select("id", F.col("y").alias("label"), "variant", "features")


@reg()
def image_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    """Images from pixels to out-of-fold scores."""
    rows = stored(P.extract(labelled(spark, d), SIDE).select("id", "y", "features"), "vectors")
    return rounded(M.out_of_fold(rows, SMALL, k=2).select("id", "y", "fold", "p"), "p")


@reg()
def tta_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled image's five variants scored by an ensemble fitted to the images, and their mean.  The first variant is the image itself."""
    rows = stored(P.extract(labelled(spark, d), SIDE, "tta").select("id", "y", "number", "features"), "vectors")
    ensemble = M.fit(rows.where("number = 0"), SMALL)
    scored = ensemble.members(rows).select("id", F.col("number").alias("variant"), "members").withColumn("raw", M.average(F.col("members")))
    return rounded(V.tta_average(scored).select("id", "variants", "p"), "p")


@reg()
def perceptual_hashes(spark: SparkSession, d: str) -> DataFrame:
    return P.perceptual_hash(images(spark, d), "hash", SIDE).select("id", "hash")


@reg()
def tile_saliency(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of each image's tiles, and how far they are from the natural one and from the image's mean."""
    slopes = P.tile_slopes(images(spark, d), "id", SIDE)
    return N.saliency(slopes, "id").select("id", "tile", "saliency", "inconsistency", "score")


@reg()
def arbitration(spark: SparkSession, d: str) -> DataFrame:
    rows = images(spark, d).withColumn("p", (F.col("id") % 10) / lit(10.0))
    return A.arbitrate(rows, side=SIDE).select("id", "p", "flags", "suspicious")


@reg()
def upright_images(spark: SparkSession, d: str) -> DataFrame:
    rows = images(spark, d).withColumn("orientation", (F.col("id") % 8 + 1).cast("int"))
    return P.upright(rows).select("id", "orientation", "height", "width", F.sha2("pixels", 256).alias("sha256"))


#: Bytes beyond which the files of the queries are refused.
MOST = 1_000_000
#: What becomes of a page's file, by the last digit of its number: three kinds that can't be read, one that is too large, one without an image's name.
FILE_SQL = f"""p AS (SELECT page_id, page_id % 10 AS k, encode(coalesce(html, '')) AS b FROM pages),
w AS (SELECT *, greatest(8, ceil(sqrt(octet_length(b) / 3e0)))::INT AS width FROM p),
h AS (SELECT *, greatest(8, ceil(octet_length(b) / (width * 3e0)))::INT AS height FROM w),
f AS (SELECT page_id, CASE WHEN k = 9 THEN 'x' || page_id || '.BMP' ELSE 'deep/x' || page_id || '.png' END AS name, k, width, height,
  CASE k WHEN 3 THEN 'empty file' WHEN 4 THEN 'no decoder for webp' WHEN 5 THEN 'a png chunk is broken' WHEN 6 THEN 'file is too large' WHEN 7 THEN 'no image that can be decoded' END AS reason,
  sha256(b || repeat('\x00'::BLOB, (3 * width * height - octet_length(b))::INT)) AS sha256 FROM h WHERE k <> 8)"""


def page_files(spark: SparkSession, d: str) -> str:
    """A folder with a file for each page: mostly good images, a BMP, and files that can't be used."""
    into = workspace(spark, "files")
    P.as_files(images(spark, d), "id").write.parquet(f"{into}/rows")
    digit, i = F.col("id") % 10, F.col("id").cast("string")
    rows = spark.read.parquet(f"{into}/rows")
    content = (
        F.when(digit == 3, F.lit(b"")).when(digit == 4, F.lit(b"RIFF\0\0\0\0WEBPVP8 ")).when(digit == 5, F.substring("png", 1, 50))
        .when(digit == 6, F.rpad("png", F.lit(MOST + 1), F.lit(b"\0"))).when(digit == 7, F.lit(b"no image")).when(digit == 9, F.col("bmp")).otherwise(F.col("png"))
    )
    name = F.when(digit == 8, F.concat(F.lit("x"), i, F.lit(".txt"))).when(digit == 9, F.concat(F.lit("x"), i, F.lit(".BMP"))).otherwise(F.concat(F.lit("deep/x"), i, F.lit(".png")))
    write_contents(rows.select(name.alias("path"), content.alias("content")), f"{into}/files")
    return f"{into}/files"


def page_number() -> Column:
    return F.regexp_extract("path", "x([0-9]+)[.][A-Za-z]+$", 1).cast("long")


@reg(f"""WITH {FILE_SQL} SELECT page_id AS id, name, CASE WHEN reason IS NULL THEN height END AS height, CASE WHEN reason IS NULL THEN width END AS width,
CASE WHEN reason IS NULL THEN sha256 END AS sha256, reason FROM f""")
def loaded_images(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as image files, good and bad, and read again: pixels or the reason."""
    found = load_images(spark, page_files(spark, d), most=str(MOST))
    name = F.regexp_extract("path", "/files/(.*)$", 1)
    return found.select(page_number().alias("id"), name.alias("name"), "height", "width", F.sha2("pixels", 256).alias("sha256"), "reason")


@reg()
def analyzed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of pages, from bytes to verdicts, by an ensemble trained on the images of labelled documents."""
    rows = stored(P.extract(labelled(spark, d), SIDE).select("id", "y", "features"), "vectors")
    trained = M.train(rows, SMALL, by=None, k=2)
    files = load_images(spark, page_files(spark, d), most=str(MOST), content="true")
    keep = lambda df: stored(df, "described")
    return analyze(files.withColumn("id", page_number()).drop("path"), trained, "id", SIDE, probe=6, told=3, stored=keep)
