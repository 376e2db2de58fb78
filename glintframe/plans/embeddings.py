"""Registered queries: the embedding store and weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit, round6
from glintframe.operators import embeddings as B
from glintframe.operators import weak as W
from glintframe.plans.evaluation import r6
from glintframe.plans.registry import Registry, rounded
from glintframe.session import with_checkpoints, workspace
from glintframe.sources.snapshots import Snapshots
from glintframe.streaming import centroids as C
from glintframe.streaming import jobs
from glintframe.tables import SCORED_SQL, scored, table

reg = Registry()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


E_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@reg(f"""WITH {E_SQL}, p AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, list_cosine_similarity(q.v, b.v) AS s FROM e q, e b WHERE q.vec_id % 20 = 0)
SELECT query_id, neighbour_id, {r6("s")} AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS r FROM p) WHERE r <= 5""")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    with_checkpoints(spark)
    v = vectors(spark, d)
    return rounded(B.nearest(v, v.where("vec_id % 20 = 0")), "similarity")


CENTRE_SQL = f"""{E_SQL}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
c AS (SELECT label AS cluster, list(x ORDER BY i) AS c FROM m GROUP BY label)"""


@reg(f"WITH {CENTRE_SQL}, n AS (SELECT label, count(*) AS n FROM e GROUP BY 1) SELECT cluster, n, {r6('c[1]')} AS first, {r6('list_sum(c)')} AS total FROM c JOIN n ON cluster = label")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = B.centroids(vectors(spark, d))
    total = F.aggregate("centroid", lit(0.0), lambda s, x: s + x)
    return c.select("cluster", "n", round6(F.col("centroid")[0]).alias("first"), round6(total).alias("total"))


@reg(f"""WITH {CENTRE_SQL}, i AS (SELECT cluster, count(*) AS n, avg(list_distance(v, c) ** 2) AS variance, avg(list_distance(v, c)) AS md FROM e JOIN c ON label = cluster GROUP BY cluster),
s AS (SELECT a.cluster, min(list_distance(a.c, b.c)) AS separation FROM c a JOIN c b ON a.cluster <> b.cluster GROUP BY a.cluster),
h AS (SELECT i.cluster, n, variance, coalesce(separation, 0) AS separation, CASE WHEN n < 2 THEN 1e0 ELSE 1e0 / (1e0 + md) END AS cohesion FROM i LEFT JOIN s ON i.cluster = s.cluster)
SELECT cluster, n, {r6("variance")} AS variance, {r6("separation")} AS separation, {r6("cohesion")} AS cohesion,
{r6("coalesce((separation - (1 - cohesion)) / nullif(greatest(separation, 1 - cohesion), 0), 0)")} AS silhouette, {r6("variance / separation")} AS davies_bouldin FROM h""")
def cluster_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.cluster_health(vectors(spark, d)), "variance", "separation", "cohesion", "silhouette", "davies_bouldin")


@reg(f"WITH {E_SQL}, n AS (SELECT a.vec_id, count(*) AS neighbours FROM e a JOIN e b ON list_distance(a.v, b.v) < 12e-1 GROUP BY 1) SELECT vec_id, neighbours FROM n WHERE neighbours >= 5")
def core_points(spark: SparkSession, d: str) -> DataFrame:
    return B.core_points(vectors(spark, d), 1.2)


@reg("SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND vec_id % 7 <> 0")
def checked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the wrong length are left out."""
    v = vectors(spark, d)
    some = v.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return B.checked(some, "embedding", 64).select("vec_id")


@reg(f"""WITH {E_SQL}, k AS (SELECT v, CASE WHEN label % 2 = 0 THEN 'GAN' ELSE 'Diffusion' END || '_m' || (vec_id % 3) AS cluster FROM e), u AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k),
m AS (SELECT cluster, i, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT cluster, count(*) AS n FROM k GROUP BY 1)
SELECT m.cluster, n, {r6('sum(x)')} AS total FROM m JOIN n ON m.cluster = n.cluster GROUP BY m.cluster, n""")
def family_model_clusters(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.col("label") % 2 == 0, "GAN").otherwise("Diffusion")
    rows = vectors(spark, d).withColumns({"family": family, "model": F.concat(F.lit("m"), F.col("vec_id") % 3)})
    found = B.clusters(rows, "family", "model")
    return found.select("cluster", "n", round6(F.aggregate("centroid", lit(0.0), lambda s, x: s + x)).alias("total"))


@reg("SELECT vec_id FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 1")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.col("label") % 2 == 0, "GAN").otherwise("Diffusion")
    rows = vectors(spark, d).withColumns({"family": family, "model": F.concat(F.lit("m"), F.col("vec_id") % 3)})
    return B.members(rows, "family", "model", "GAN_m1").select("vec_id")


@reg("SELECT label AS seed, vec_id AS member, 'GAN_new' AS cluster, 'GAN' AS family, 'new' AS model FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5")
def promoted_representatives(spark: SparkSession, d: str) -> DataFrame:
    return B.promote(vectors(spark, d).select(F.col("label").alias("seed"), F.col("vec_id").alias("member")), "GAN_new", "GAN", "new")


@reg()
def unknown_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy in id order: no SQL; tests compare it with a loop."""
    with_checkpoints(spark)
    return B.unknown_clusters(vectors(spark, d), 1.2)


@reg(f"""SELECT event_type, count(*) AS n, {r6("avg(value)")} AS avg_value, {r6("stddev_pop(value)")} AS std_value, {r6("avg(user_id)")} AS avg_user, {r6("stddev_pop(user_id)")} AS std_user FROM events GROUP BY 1""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    f = B.fingerprint(table(spark, d, "events"), "event_type", {"value": F.col("value"), "user": F.col("user_id")})
    return rounded(f, "avg_value", "std_value", "avg_user", "std_user")


SIGN_SQL = f"""{SCORED_SQL}, g AS (SELECT generator, avg((p > 3e-1)::INT) AS checkerboard, avg(p) AS attention, 1 - avg(p * p) AS light, avg(p) AS cdcs, avg(size / 1e4) AS fractal FROM scored GROUP BY 1),
s AS (SELECT *, list_filter([CASE WHEN checkerboard > 3e-1 THEN 'checkerboard' END, CASE WHEN attention > 7e-1 THEN 'attention-maps' END, CASE WHEN light > 4e-1 THEN 'lighting-inconsistency' END], lambda x: x IS NOT NULL) AS artifacts FROM g)"""


def signatures(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    s = scored(spark, d)
    means = s.groupBy("generator").agg(F.avg("p").alias("cdcs"), F.avg(F.col("size") / lit(1e4)).alias("fractal"))
    return B.artifact_signature(s, "generator", p, p, p * p).join(means, "generator")


@reg(f"WITH {SIGN_SQL} SELECT generator, {r6('checkerboard')} AS checkerboard, {r6('attention')} AS attention, {r6('light')} AS light, array_to_string(artifacts, ',') AS artifacts FROM s")
def artifact_signature(spark: SparkSession, d: str) -> DataFrame:
    s = signatures(spark, d).select("generator", "checkerboard", "attention", "light", F.array_join("artifacts", ",").alias("artifacts"))
    return rounded(s, "checkerboard", "attention", "light")


@reg(f"""WITH {SIGN_SQL}, c AS (SELECT a.generator AS a, b.generator AS b, greatest(0e0, 1e0 - (0e0 + CASE WHEN abs(a.cdcs - b.cdcs) > 2e-1 THEN 15e-2 ELSE 0e0 END + CASE WHEN abs(a.checkerboard - b.checkerboard) > 3e-1 THEN 1e-1 ELSE 0e0 END
+ CASE WHEN abs(a.fractal - b.fractal) > 2e-1 THEN 1e-1 ELSE 0e0 END + CASE WHEN NOT list_has_any(a.artifacts, b.artifacts) AND len(a.artifacts) + len(b.artifacts) > 0 THEN 15e-2 ELSE 0e0 END)) AS s FROM s a JOIN s b ON a.generator <> b.generator)
SELECT a, b, {r6("s")} AS similarity, s >= 7e-1 AS alike FROM c""")
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.compare_models(signatures(spark, d), "generator"), "similarity")


@reg("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts)::INT AS version FROM events")
def version_upsert(spark: SparkSession, d: str) -> DataFrame:
    return B.versions(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts").drop("ts")


@reg("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM embeddings")
def label_unknown_cluster(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("vec_id", "label")
    return B.relabel(v, v.where("vec_id % 10 = 0").select("vec_id", F.lit(99).alias("label")), "vec_id", "label")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Scores as detector predictions; those of even ids have a user's label."""
    s = scored(spark, d)
    even, p = F.col("id") % 2 == 0, F.col("p")
    return s.select(
        "id", "generator", F.when(p >= 0.5, "modelA").otherwise("modelB").alias("model"), p.alias("confidence"), (lit(0.5) + p / lit(4.0)).alias("calibration"), (lit(1.0) - p).alias("cdcs"),
        F.when(even, F.when(F.col("y") == 1, "modelA").otherwise("modelB")).alias("user_model"),
        F.when(even, F.when(F.col("toxic") == 1, "Real").otherwise("GAN")).alias("user_family"),
        F.when(even, (F.col("size") % 101).cast("double")).alias("user_confidence"), F.when(even, (F.col("id") % 4) / lit(4.0)).alias("user_accuracy"),
    )


SIGNAL_SQL = f"""{SCORED_SQL}, sig AS (SELECT id, generator, CASE WHEN p >= 5e-1 THEN 'modelA' ELSE 'modelB' END AS model, p AS confidence, 5e-1 + p / 4e0 AS calibration, 1e0 - p AS cdcs,
CASE WHEN id % 2 = 0 THEN CASE WHEN y = 1 THEN 'modelA' ELSE 'modelB' END END AS um, CASE WHEN id % 2 = 0 THEN CASE WHEN toxic = 1 THEN 'Real' ELSE 'GAN' END END AS uf,
CASE WHEN id % 2 = 0 THEN (size % 101)::DOUBLE END AS uc, CASE WHEN id % 2 = 0 THEN (id % 4) / 4e0 END AS ua FROM scored),
w AS (SELECT *, calibration * (CASE WHEN confidence > 9e-1 THEN 12e-1 ELSE 1e0 END) * (CASE WHEN cdcs > 7e-1 THEN 115e-2 ELSE 1e0 END) * 7e-1 AS dw, uc / 100 * coalesce(nullif(ua, 0), 5e-1) * 3e-1 AS uw FROM sig),
x AS (SELECT *, confidence * (dw / (dw + uw)) AS ds, uc / 100 * (uw / (dw + uw)) AS us FROM w),
f AS (SELECT *, CASE WHEN um IS NULL OR us <= ds THEN model ELSE um END AS fused_model, CASE WHEN um IS NULL THEN confidence WHEN model = um THEN least((ds + us) * 11e-1, 1e0) ELSE ds + us END AS fc FROM x),
n AS (SELECT *, CASE WHEN um IS NULL THEN 0 WHEN model <> um AND confidence > 85e-2 AND uc > 85 THEN 8e-1 WHEN cdcs > 8e-1 AND uf = 'Real' THEN 7e-1 WHEN cdcs < 3e-1 AND uf IN ('Diffusion','GAN','Transformer') THEN 6e-1 ELSE 0 END AS nc FROM f)"""


@reg(f"WITH {SIGNAL_SQL} SELECT id, fused_model, {r6('fc')} AS fused_confidence, {r6('CASE WHEN um IS NULL THEN 1e0 ELSE dw / (dw + uw) END')} AS detector_weight, {r6('CASE WHEN um IS NULL THEN 0e0 ELSE uw / (dw + uw) END')} AS user_weight FROM f")
def fuse_signals(spark: SparkSession, d: str) -> DataFrame:
    f = W.fuse(signals(spark, d)).select("id", "fused_model", "fused_confidence", "detector_weight", "user_weight")
    return rounded(f, "fused_confidence", "detector_weight", "user_weight")


@reg(f"""WITH {SIGNAL_SQL} SELECT id, nc > 0 AS noisy, nc::DOUBLE AS noise_confidence, CASE WHEN um IS NULL THEN 'No user label' WHEN nc = 8e-1 THEN 'Strong disagreement between high-confidence detector and user'
WHEN nc = 7e-1 THEN 'High CDCS (AI-like) conflicts with Real label' WHEN nc = 6e-1 THEN 'Low CDCS (Real-like) conflicts with AI label' ELSE 'Signals are consistent' END AS noise_reason FROM n""")
def label_noise(spark: SparkSession, d: str) -> DataFrame:
    return W.noise(signals(spark, d)).select("id", "noisy", "noise_confidence", "noise_reason")


@reg(f"""WITH {SIGNAL_SQL} SELECT id, {r6('''greatest(0e0, least(1e0, 5e-1 + CASE WHEN confidence > 9e-1 THEN 2e-1 ELSE 0e0 END + CASE WHEN uc > 85 THEN 15e-2 ELSE 0e0 END + CASE WHEN model = um THEN 2e-1 ELSE 0e0 END
+ CASE WHEN cdcs > 8e-1 OR cdcs < 2e-1 THEN 15e-2 ELSE 0e0 END - 3e-1 * nc - CASE WHEN fc < 6e-1 THEN 2e-1 ELSE 0e0 END))''')} AS quality FROM n""")
def label_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.quality(W.noise(W.fuse(signals(spark, d)))).select("id", "quality"), "quality")


@reg(f"""WITH {SIGNAL_SQL}, v AS (SELECT n.*, e.vec_id IS NOT NULL AND id % 5 <> 0 AS ok FROM n LEFT JOIN embeddings e ON n.id = e.vec_id)
SELECT id, ok AS success, CASE WHEN NOT ok THEN 'Invalid embedding dimension: expected 64' END AS error, CASE WHEN ok THEN {r6('''greatest(0e0, least(1e0, 5e-1 + CASE WHEN confidence > 9e-1 THEN 2e-1 ELSE 0e0 END + CASE WHEN uc > 85 THEN 15e-2 ELSE 0e0 END
+ CASE WHEN model = um THEN 2e-1 ELSE 0e0 END + CASE WHEN cdcs > 8e-1 OR cdcs < 2e-1 THEN 15e-2 ELSE 0e0 END - 3e-1 * nc - CASE WHEN fc < 6e-1 THEN 2e-1 ELSE 0e0 END))''')} END AS quality FROM v""")
def submitted_signals(spark: SparkSession, d: str) -> DataFrame:
    """Training signals with their vectors; every fifth vector is too short."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")).alias("vector"))
    done = W.submit(signals(spark, d).join(v, "id", "left"), "vector", 64)
    return rounded(done.select("id", "success", "error", "quality"), "quality")


EMA_SQL = f"""r AS (SELECT user_id, (event_type = 'purchase')::INT AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS later FROM events),
a AS (SELECT user_id AS "user", count(*) AS labels, sum(hit)::BIGINT AS hits, sum(1e-1 * pow(9e-1, later) * hit) + 5e-1 * pow(9e-1, count(*)) AS acc FROM r GROUP BY 1)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    return W.user_accuracy(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "purchase")


@reg(f'WITH {EMA_SQL} SELECT "user", labels, hits, {r6("acc")} AS accuracy FROM a')
def user_ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(users(spark, d), "accuracy")


@reg(f'WITH {EMA_SQL} SELECT "user", labels, hits, {r6("acc")} AS accuracy FROM a WHERE labels >= 10 ORDER BY acc DESC, "user" LIMIT 10')
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.leaderboard(users(spark, d)), "accuracy")


@reg(f'WITH {EMA_SQL} SELECT "user", labels FROM a ORDER BY labels DESC, "user" LIMIT 10')
def top_contributors(spark: SparkSession, d: str) -> DataFrame:
    return W.contributors(users(spark, d)).select("user", "labels")


@reg(f"""WITH {CENTRE_SQL}, n AS (SELECT label, count(*) AS n FROM e GROUP BY 1) SELECT cluster, n, {r6('c[1]')} AS first, {r6('list_sum(c)')} AS total FROM c JOIN n ON cluster = label""")
def centroid_stream(spark: SparkSession, d: str) -> DataFrame:
    """Centroids kept as state while vectors arrive in three parts, the first ids last, some of them twice."""
    arrived, root, at = (workspace(spark, name) for name in ("vectors", "centroids", "checkpoint"))
    v = vectors(spark, d).select("vec_id", "label", "embedding")
    part = F.col("vec_id") % 3
    for own in (v.where(part == 2), v.where(part == 1), v.where((part == 0) | (F.col("vec_id") % 5 == 1))):
        own.write.mode("append").parquet(arrived)
        C.keep(jobs.arrivals(spark, arrived, v.schema), root, at, "vec_id", "label", "embedding").awaitTermination()
    c = C.read(C.store(spark, root, v.schema["label"].dataType.simpleString()))
    total = F.aggregate("centroid", lit(0.0), lambda s, x: s + x)
    return c.select("cluster", "n", round6(F.col("centroid")[0]).alias("first"), round6(total).alias("total"))


@reg("""SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label, (CASE WHEN vec_id % 10 = 0 THEN 2 WHEN vec_id % 4 = 0 THEN 3 ELSE 1 END)::BIGINT AS version
FROM embeddings WHERE vec_id % 7 <> 3""")
def store_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A store that lasts: rows put, some put again twice at once, some relabelled, some taken out."""
    v = vectors(spark, d).select("vec_id", "label")
    kind = v.schema["label"].dataType.simpleString()
    store = Snapshots(spark, workspace(spark, "store"), ["vec_id"], f"vec_id {v.schema['vec_id'].dataType.simpleString()}, label {kind}", 16)
    again = v.where("vec_id % 4 = 0 and vec_id % 10 <> 0")
    store.upsert(v)
    store.upsert(again.unionByName(again))
    store.upsert(v.where("vec_id % 10 = 0").withColumn("label", F.lit(99).cast(kind)))
    store.delete(v.where("vec_id % 7 = 3"))
    return store.read()
