"""Registered queries: fitting and judging the score ensemble over features of the labelled documents.

Fits have no SQL; what is computed from their scores has, in the tests.  The registered sizes of the members are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import finite, ratio
from glintframe.operators import evaluation as E
from glintframe.operators import models as M
from glintframe.plans.registry import Registry, rounded
from glintframe.session import stored, workspace
from glintframe.tables import scored, table

reg = Registry()
ROUND = "floor(({}) * 1e6 + 5e-1) / 1e6"
SMALL = M.Config(trees=10, tree_depth=5, boosts=5, boost_depth=3, waves=32, iterations=50)
NAMES = ["fft_length", "fft_letters", "dct_digits", "dct_spaces", "noise_upper", "noise_marks", "wavelet_words", "wavelet_lines"]


def featured(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with eight numbers that say what their text is made of: id, y, generator (their language, of which there are a few), features."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    share = lambda pattern: ratio(n - F.length(F.regexp_replace(text, pattern, "")), n)
    values = [F.log1p(n), share("[A-Za-z]+"), share("[0-9]+"), share(" +"), share("[A-Z]+"), share("[.,;:!?]+"), ratio(n, F.size(F.split(text, " "))), share("\\n+")]
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("generator"), F.array(*[finite(v.cast("double")) for v in values]).alias("features"))
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), "generator", "features")


@reg()
def ensemble_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    """Five folds, each scored by the four members fitted to the others."""
    oof = M.out_of_fold(featured(spark, d), SMALL)
    return oof.select("id", "y", "fold", "members", "p")


@reg()
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return M.fold_metrics(M.out_of_fold(featured(spark, d), SMALL))


@reg()
def leave_one_generator_out(spark: SparkSession, d: str) -> DataFrame:
    """Each language held out once."""
    return M.leave_one_out(featured(spark, d), SMALL)


@reg()
def trained_scores(spark: SparkSession, d: str) -> DataFrame:
    """A whole training run, saved, loaded, and used on a manifest with rows that can't be scored."""
    rows, into = stored(featured(spark, d), "featured"), workspace(spark, "model")
    M.save(M.train(rows, SMALL, k=2), spark, into)
    manifest = rows.withColumn("features", F.when(F.col("id") % 10 > 0, F.col("features")))
    return M.load(spark, into).score(manifest).select("id", "y", "members", "p", "status", "error")


@reg()
def cross_dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """An ensemble fitted to the even ids, judged on the odd ones by the evaluation report."""
    rows = stored(featured(spark, d), "featured")
    other = M.fit(rows.where("id % 2 = 0"), SMALL).members(rows.where("id % 2 = 1"))
    judged = other.select("y", "generator", M.average(F.col("members")).alias("p"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    return E.evaluation_report(judged, 0.05, table(spark, d, "events").select("value"))


@reg()
def feature_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What each of its features adds to the score of a document, a row for each: the score less that without it."""
    rows = stored(featured(spark, d), "featured")
    found = M.contributions(M.fit(rows, SMALL), rows, "id", probe=None, keep=None)
    return found.select("id", "feature", "value", "delta", "place")


@reg()
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("id", "y", "p")
    return rows.withColumn("calibrated", M.calibrate(rows, method="isotonic").apply(F.col("p")))


@reg()
def sigmoid_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("id", "y", "p")
    return rows.withColumn("calibrated", M.calibrate(rows, method="sigmoid").apply(F.col("p")))


@reg()
def stacked_meta(spark: SparkSession, d: str) -> DataFrame:
    oof = M.out_of_fold(featured(spark, d), SMALL, k=2)
    return oof.select("id", "y", "p", M.fit_meta(oof).score(F.col("members")).alias("meta"))


@reg()
def family_ablation(spark: SparkSession, d: str) -> DataFrame:
    return M.ablation(featured(spark, d), NAMES, SMALL)


@reg()
def family_heads(spark: SparkSession, d: str) -> DataFrame:
    """Logistic heads of the first four languages as families, fitted by gradient steps."""
    rows = scored(spark, d)
    names = F.array(*[F.lit(r[0]) for r in rows.select("state").distinct().orderBy("state").limit(4).collect()])
    family = (F.array_position(names, F.col("state")) - 1).cast("int")
    weights = M.family_weights(rows.withColumn("family", family).where("family >= 0"), "p", "family", 4)
    return spark.createDataFrame([(n, *w) for n, w in enumerate(weights or [])], "family int, intercept double, slope double")


@reg(f"""WITH v AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings),
e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1),
c AS (SELECT v.feature, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 16), 15) ELSE 0 END AS bin, label, count(*) AS n FROM v JOIN e ON v.feature = e.feature GROUP BY ALL),
t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS a, sum(n) OVER (PARTITION BY feature, label) AS b FROM c),
m AS (SELECT feature, greatest(0e0, sum(n / t * ln(n * t / (a * b)))) AS mi FROM t GROUP BY 1)
SELECT feature, {ROUND.format('mi')} AS mutual_information, row_number() OVER (ORDER BY mi DESC, feature)::INT AS place FROM m QUALIFY place <= 8""")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return rounded(M.top_features(vectors, 8, label="label"), "mutual_information")
