"""Registered queries: verdicts and evaluation over the labelled score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit, round6
from glintframe.operators import evaluation as E
from glintframe.operators import verdict as V
from glintframe.plans.registry import Registry, rounded
from glintframe.streaming.watch import with_peak_memory
from glintframe.tables import SCORED_SQL, scored, table

reg = Registry()
R6 = "floor(({}) * 1e6 + 5e-1) / 1e6"


def r6(sql: str) -> str:
    return R6.format(sql)


def members(p):
    """Four member probabilities around a score."""
    return F.array(p, p * p, F.sqrt(p), (p + lit(1.0)) / lit(2.0))


MEMBERS_SQL = "m AS (SELECT *, [p, p * p, sqrt(p), (p + 1e0) / 2e0] AS members FROM scored)"
AVG_SQL = "(members[1] + members[2] + members[3] + members[4]) / 4"
CLAMP_SQL = "CASE WHEN t IS NULL OR isnan(t) OR t >= 5e-1 THEN 5e-1 ELSE greatest(t, 5e-2) END"
STATE_SQL = "CASE WHEN p >= t AND p >= 5e-1 THEN 'ai' WHEN p >= t THEN 'uncertain' WHEN p >= t - 5e-2 - 1e-9 THEN 'uncertain' ELSE 'authentic' END"


@reg(f"""WITH {SCORED_SQL}, v AS (SELECT p, 37e-2 AS t FROM scored), s AS (SELECT p, {STATE_SQL} AS verdict_state FROM v)
SELECT verdict_state, count(*) AS n, {r6("avg(p)")} AS mean_p FROM s GROUP BY 1""")
def verdict_states(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.verdict_mix(V.with_verdict(scored(spark, d), threshold=lit(0.37))), "mean_p")


@reg(f"""WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 1e2 END AS t FROM events)
SELECT event_id, {r6(CLAMP_SQL)} AS threshold FROM e""")
def verdict_clamp(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_type") != "error", F.col("value") / lit(100.0))
    return rounded(table(spark, d, "events").select("event_id", V.clamp_threshold(t).alias("threshold")), "threshold")


@reg(f"""WITH {SCORED_SQL}, {MEMBERS_SQL}, a AS (SELECT id, p, members, {AVG_SQL} AS avg4 FROM m),
g AS (SELECT *, greatest(0e0, least(1e0, 1e0 - sqrt(((members[1]-avg4)**2 + (members[2]-avg4)**2 + (members[3]-avg4)**2 + (members[4]-avg4)**2) / 4) / 5e-1)) AS agreement, 5e-1 AS t FROM a)
SELECT id, {r6("agreement")} AS agreement, CASE WHEN agreement < 5e-1 AND p < 9e-1 THEN 'uncertain' ELSE {STATE_SQL} END AS verdict_state,
  CASE WHEN agreement < 5e-1 AND p < 9e-1 THEN false ELSE p >= t END AS is_ai FROM g""")
def agreement_gate(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d).withColumn("agreement", V.agreement(members(F.col("p"))))
    return rounded(V.agreement_gate(V.with_verdict(df)).select("id", "agreement", "verdict_state", "is_ai"), "agreement")


SOFT_SQL = """z AS (SELECT id, p, [3e0 - 6e0*p, -1e0 + 2e0*p, -25e-1 + 45e-1*p, -2e0 + 3e0*p] AS z FROM scored),
x AS (SELECT id, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM z),
s AS (SELECT id, list_transform(x, lambda v: v / (x[1] + x[2] + x[3] + x[4])) AS s FROM x)"""


@reg(f"""WITH {SCORED_SQL}, {SOFT_SQL}
SELECT id, {r6("s[1]")} AS real_share, {r6("s[2]")} AS diffusion, {r6("s[3]")} AS gan, {r6("s[4]")} AS other FROM s""")
def attribution_softmax(spark: SparkSession, d: str) -> DataFrame:
    s = V.attribution(F.col("p"))
    names = ("real_share", "diffusion", "gan", "other")
    return scored(spark, d).select("id", *[round6(s[i]).alias(n) for i, n in enumerate(names)])


@reg(f"""WITH {SCORED_SQL}, {SOFT_SQL}
SELECT id, ['real','diffusion','gan','other'][list_position(s, list_max(s))] AS family, {r6("list_max(s)")} AS probability FROM s""")
def attribution_argmax(spark: SparkSession, d: str) -> DataFrame:
    top = scored(spark, d).select("id", V.top_family(F.col("p")).alias("top"))
    return rounded(top.select("id", "top.family", "top.probability"), "probability")


@reg(f"""WITH {SCORED_SQL}, v AS (SELECT id, unnest(range(5)) AS variant, p FROM scored)
SELECT id, count(*) AS variants, {r6("least(1e0, greatest(0e0, avg(p + (variant - 2) * 1e-1)))")} AS p FROM v GROUP BY id""")
def tta_average(spark: SparkSession, d: str) -> DataFrame:
    variants = scored(spark, d).select("id", "p", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("variant"))
    raw = F.col("p") + (F.col("variant") - 2) * lit(0.1)
    averaged = V.tta_average(variants.withColumn("raw", raw).withColumn("members", members(F.col("p"))))
    return rounded(averaged.select("id", "variants", "p"), "p")


@reg(f"""WITH {SCORED_SQL}, {MEMBERS_SQL}
SELECT id, {r6(AVG_SQL)} AS average, ({AVG_SQL}) >= 5e-1 AS is_fake,
  {r6("1e0 / (1e0 + exp(-(-2e0 + 1e0*members[1] + 5e-1*members[2] + 15e-1*members[3] + 1e0*members[4])))")} AS stacked FROM m""")
def ensemble_scores(spark: SparkSession, d: str) -> DataFrame:
    m = members(F.col("p"))
    df = scored(spark, d).select("id", V.average(m).alias("average"), (V.average(m) >= 0.5).alias("is_fake"), V.stacked(m, -2.0, (1.0, 0.5, 1.5, 1.0)).alias("stacked"))
    return rounded(df, "average", "stacked")


@reg(f"""WITH {SCORED_SQL}, {MEMBERS_SQL}, c AS (SELECT id, unnest(range(4)) AS feature, unnest(members) - 5e-1 AS value, (unnest(members) - 5e-1) * (unnest(range(4)) - 15e-1) AS delta FROM m),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS r FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(delta) DESC, feature) AS q FROM a WHERE r <= 3)
SELECT id, feature::INT AS feature, {r6("delta")} AS delta, row_number() OVER (PARTITION BY id ORDER BY delta DESC, feature)::INT AS place FROM b WHERE q <= 2""")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    values = scored(spark, d).select("id", F.posexplode(F.transform(members(F.col("p")), lambda x: x - 0.5)).alias("feature", "value"))
    values = values.withColumn("delta", F.col("value") * (F.col("feature") - lit(1.5)))
    return rounded(V.contributions(values, "id", 3, 2).select("id", "feature", "delta", "place"), "delta")


SUMS = "sum((p >= {0})::INT * y)::BIGINT AS tp, sum((p >= {0})::INT * (1 - y))::BIGINT AS fp, sum((p < {0})::INT * y)::BIGINT AS fn, sum((p < {0})::INT * (1 - y))::BIGINT AS tn"
RATES = f"""{r6("coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)")} AS accuracy, {r6("coalesce(tp / nullif(tp + fp, 0), 0)")} AS precision,
{r6("coalesce(tp / nullif(tp + fn, 0), 0)")} AS recall, {r6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)")} AS f1,
{r6("coalesce(fp / nullif(fp + tn, 0), 0)")} AS fpr, {r6("coalesce(fn / nullif(fn + tp, 0), 0)")} AS fnr, {r6("coalesce(tn / nullif(tn + fp, 0), 0)")} AS specificity"""
RATE_NAMES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "specificity")


@reg(f"WITH {SCORED_SQL}, o AS (SELECT count(*) AS n, {SUMS.format('5e-1')} FROM scored) SELECT n, tp, fp, fn, tn, {RATES} FROM o")
def metrics_binary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.binary_metrics(scored(spark, d), 0.5), *RATE_NAMES)


@reg(f"WITH {SCORED_SQL} SELECT y, (p >= 5e-1)::INT AS pred, count(*) AS n FROM scored GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(scored(spark, d), 0.5)


@reg(f"WITH {SCORED_SQL}, o AS (SELECT state, count(*) AS n, {SUMS.format('5e-1')} FROM scored GROUP BY ROLLUP (state)) SELECT state, n, tp, fp, fn, tn, {RATES} FROM o")
def state_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.state_rollup(scored(spark, d), 0.5), *RATE_NAMES)


@reg(f"WITH {SCORED_SQL}, o AS (SELECT generator, count(*) AS n, {SUMS.format('5e-1')} FROM scored GROUP BY generator) SELECT generator, n, tp, fp, fn, tn, {RATES} FROM o")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.binary_metrics(scored(spark, d), 0.5, ["generator"]), *RATE_NAMES)


CURVE = f"""WITH {SCORED_SQL}, c AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM scored GROUP BY p),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an,
  lead(pos) OVER w AS pos_next, lead(neg) OVER w AS neg_next, row_number() OVER w AS r FROM c WINDOW w AS (ORDER BY p DESC))"""


@reg(f"""{CURVE} SELECT {r6('p')} AS threshold, {r6('fp / an')} AS fpr, {r6('tp / ap')} AS tpr FROM k
WHERE r = 1 OR pos_next IS NULL OR pos <> pos_next OR neg <> neg_next UNION ALL SELECT 'infinity'::DOUBLE, 0, 0""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.roc_curve(scored(spark, d)), "fpr", "tpr").withColumn("threshold", F.when(F.col("threshold") <= 1, round6(F.col("threshold"))).otherwise(F.col("threshold")))


@reg(f"{CURVE} SELECT {r6('p')} AS threshold, {r6('tp / (tp + fp)')} AS precision, {r6('tp / ap')} AS recall FROM k UNION ALL SELECT NULL, 1, 0")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.pr_curve(scored(spark, d)), "threshold", "precision", "recall")


def coarse(spark: SparkSession, d: str) -> DataFrame:
    """Scores to two decimals, so that many tie."""
    return scored(spark, d).withColumn("p", F.floor(F.col("p") * 100) / lit(100.0))


@reg(f"""WITH {SCORED_SQL}, q AS (SELECT y, floor(p * 100) / 1e2 AS p FROM scored),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM q)
SELECT {r6("(sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y))")} AS roc_auc FROM r""")
def roc_auc_midrank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.roc_auc(coarse(spark, d)), "roc_auc")


@reg(f"{CURVE} SELECT {r6('min(p) FILTER (fp / an <= 5e-2)')} AS unclamped, {r6('least(5e-1, coalesce(min(p) FILTER (fp / an <= 5e-2), 5e-1))')} AS threshold FROM k")
def fpr_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.fpr_threshold(scored(spark, d), 0.05), "unclamped", "threshold")


@reg(f"{CURVE} SELECT {r6('min(p) FILTER (fp / an <= 2e-1)')} AS threshold FROM k")
def threshold_descending(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.threshold_descending(scored(spark, d), 0.2), "threshold")


@reg(f"""WITH {SCORED_SQL}, b AS (SELECT floor(p * 15) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS h FROM scored GROUP BY 1)
SELECT (SELECT count(*) FROM scored) AS n, {r6("sum(abs(a - h) * n) FILTER (bin < 15) / (SELECT count(*) FROM scored)")} AS ece FROM b""")
def ece_15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.calibration_error(scored(spark, d), 15), "ece")


@reg(f"""WITH {SCORED_SQL}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS h FROM scored GROUP BY 1)
SELECT (SELECT count(*) FROM scored) AS n, {r6("sum(abs(a - h) * n) / (SELECT count(*) FROM scored)")} AS ece FROM b""")
def ece_10_closed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.calibration_error(scored(spark, d), 10, closed=True), "ece")


@reg(f"WITH {SCORED_SQL} SELECT count(*) AS n, {r6('avg((y - p) * (y - p))')} AS brier FROM scored")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.brier(scored(spark, d)), "brier")


@reg(f"WITH {SCORED_SQL} SELECT id, {r6('CASE WHEN p <= 0 OR p >= 1 THEN p ELSE 1e0 / (1e0 + exp(-ln(p / (1e0 - p)) / 15e-1)) END')} AS scaled FROM scored")
def temperature_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scored(spark, d).select("id", E.temperature_scaled(F.col("p"), lit(0.25)).alias("scaled")), "scaled")


@reg(f"WITH {SCORED_SQL} SELECT CASE WHEN least(size, 1200) < 512 THEN 'small' WHEN least(size, 1200) >= 1024 THEN 'large' ELSE 'medium' END AS bucket, count(*) AS n FROM scored GROUP BY 1")
def resolution_buckets(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(E.resolution_bucket(F.col("size"), F.lit(1200)).alias("bucket")).agg(F.count("*").alias("n"))


@reg(f"SELECT {r6('quantile_cont(value, 5e-1)')} AS p50, {r6('quantile_cont(value, 95e-2)')} AS p95, {r6('quantile_cont(value, 99e-2)')} AS p99 FROM events")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.latency_percentiles(table(spark, d, "events"), "value"), "p50", "p95", "p99")


@reg(f"WITH {SCORED_SQL}, o AS (SELECT count(*) AS n, {SUMS.format('5e-1')} FROM scored) SELECT n, {r6('fp / (fp + tn)')} AS fpr, {r6('tp / (tp + fn)')} AS recall, fp / (fp + tn) <= 2e-2 AND tp / (tp + fn) >= 8e-1 AS passed FROM o")
def holdout_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.holdout_gate(scored(spark, d), 0.5), "fpr", "recall")


@reg(f"""WITH {SCORED_SQL}, h AS (SELECT state, count(*) AS n, avg((y = (p >= 5e-1)::INT)::INT) AS accuracy, avg(p) AS roc_auc, avg(abs(y - p)) AS ece, quantile_cont(size, 95e-2) AS lat FROM scored GROUP BY state),
r AS (SELECT *, row_number() OVER (ORDER BY state DESC) AS r FROM h), b AS (SELECT * FROM r WHERE r = 2), c AS (SELECT * FROM r WHERE r = 1)
SELECT 'accuracy' AS metric, {r6("b.accuracy")} AS base, {r6("c.accuracy")} AS current, c.accuracy - b.accuracy < -2e-2 AS regressed FROM b, c
UNION ALL SELECT 'roc_auc', {r6("b.roc_auc")}, {r6("c.roc_auc")}, c.roc_auc - b.roc_auc < -1e-2 FROM b, c
UNION ALL SELECT 'ece', {r6("b.ece")}, {r6("c.ece")}, c.ece - b.ece > 5e-2 FROM b, c
UNION ALL SELECT 'latency_p95', {r6("b.lat")}, {r6("c.lat")}, b.lat > 0 AND c.lat > b.lat * 15e-1 FROM b, c""")
def drift_check(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("int")
    history = scored(spark, d).groupBy("state").agg(
        F.avg(hit).alias("accuracy"), F.lit(None).cast("double").alias("f1"), F.avg("p").alias("roc_auc"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("ece"),
        F.lit(None).cast("double").alias("fpr_at_threshold"), F.percentile("size", F.lit(0.95)).alias("latency_p95"),
    )
    return rounded(E.drift(history, "state"), "base", "current")


@reg(f"""WITH {SCORED_SQL}, q AS (SELECT y, p AS a, floor(p * 4) / 4e0 AS b FROM scored),
ra AS (SELECT y, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS r, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS s FROM q),
u AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)) AS m, (sum(s) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)) AS a FROM ra)
SELECT {r6("m")} AS meta_auc, {r6("a")} AS average_auc, m >= a + 5e-3 AS keep_meta FROM u""")
def meta_gate(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d).withColumn("coarse", F.floor(F.col("p") * 4) / lit(4.0)).withColumn("fine", F.col("p"))
    return rounded(E.meta_gate(df, "fine", "coarse"), "meta_auc", "average_auc")


@reg(f"""WITH {SCORED_SQL}, e AS (SELECT min(size) AS lo, max(size) AS hi FROM scored),
c AS (SELECT least(floor((size - lo) / (hi - lo) * 16), 15) AS bin, y, count(*) AS n FROM scored, e GROUP BY 1, 2),
t AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bin) AS x, sum(n) OVER (PARTITION BY y) AS yy FROM c)
SELECT {r6("greatest(0e0, sum(n / t * ln(n * t / (x * yy))))")} AS mutual_information FROM t""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.mutual_information(scored(spark, d), "size"), "mutual_information")


def pairs(metrics: dict[str, str]) -> str:
    return ", ".join(f"{{'metric': '{name}', 'value': ({sql})::DOUBLE}}" for name, sql in metrics.items())


F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
OVERALL = {
    "n": "n", "accuracy": "(tp + tn) / n", "precision": "coalesce(tp / nullif(tp + fp, 0), 0)", "recall": "coalesce(tp / nullif(tp + fn, 0), 0)", "f1": F1,
    "fpr": "coalesce(fp / nullif(fp + tn, 0), 0)", "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn",
}
SLICE = {"n": "n", "accuracy": "(tp + tn) / n", "f1": F1}


@reg(f"""{CURVE}, th AS (SELECT least(5e-1, coalesce(min(p) FILTER (fp / an <= 5e-2), 5e-1)) AS t FROM k),
s AS (SELECT *, CASE WHEN least(size, 1200) < 512 THEN 'small' WHEN least(size, 1200) >= 1024 THEN 'large' ELSE 'medium' END AS bucket, (p >= t)::INT AS hit
  FROM scored, th),
g AS (SELECT generator, bucket, grouping_id(generator, bucket) AS level, count(*) AS n, sum(hit * y) AS tp, sum(hit * (1 - y)) AS fp, sum((1 - hit) * y) AS fn,
  sum((1 - hit) * (1 - y)) AS tn FROM s GROUP BY GROUPING SETS ((), (generator), (bucket))),
auc AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r, y FROM scored),
bins AS (SELECT floor(p * 15) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS h FROM scored GROUP BY 1),
u AS (SELECT 'overall' AS part, '' AS key, unnest([{pairs(OVERALL)}]) AS m FROM g WHERE level = 3
  UNION ALL SELECT 'generator', generator, unnest([{pairs(SLICE)}]) FROM g WHERE level = 1
  UNION ALL SELECT 'resolution', bucket, unnest([{pairs(SLICE)}]) FROM g WHERE level = 2
  UNION ALL SELECT 'overall', '', {{'metric': 'threshold', 'value': t::DOUBLE}} FROM th
  UNION ALL SELECT 'overall', '', {{'metric': 'roc_auc', 'value': ((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)))::DOUBLE}} FROM auc
  UNION ALL SELECT 'overall', '', {{'metric': 'ece', 'value': (sum(abs(a - h) * n) FILTER (bin < 15) / sum(n))::DOUBLE}} FROM bins
  UNION ALL SELECT 'latency', '', unnest([{{'metric': 'p50', 'value': quantile_cont(value, 5e-1)}}, {{'metric': 'p95', 'value': quantile_cont(value, 95e-2)}}, {{'metric': 'p99', 'value': quantile_cont(value, 99e-2)}}]) FROM events)
SELECT part, key, m.metric AS metric, {r6('m.value')} AS value FROM u""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d).withColumns({"width": F.col("size"), "height": F.lit(1200)})
    return rounded(E.evaluation_report(df, 0.05, table(spark, d, "events").select("value")), "value")


@reg()
def report_with_memory(spark: SparkSession, d: str) -> DataFrame:
    """The same report, and the memory that the executors needed at most until it was made."""
    df = scored(spark, d).withColumns({"width": F.col("size"), "height": F.lit(1200)})
    report = rounded(E.evaluation_report(df, 0.05, table(spark, d, "events").select("value")), "value")
    return with_peak_memory(report)


SHARP = "CASE WHEN p <= 0 OR p >= 1 THEN p ELSE 1e0 / (1e0 + exp(-ln(p / (1e0 - p)) / 15e-1)) END"


@reg(f"""WITH {SCORED_SQL}, b AS (SELECT 'before' AS stage, y, p FROM scored UNION ALL SELECT 'after', y, {SHARP} FROM scored),
c AS (SELECT stage, floor(p * 15) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS h, sum((y - p) * (y - p)) AS loss FROM b GROUP BY 1, 2)
SELECT stage, {r6("sum(abs(a - h) * n) FILTER (bin < 15) / sum(n)")} AS ece, {r6("sum(loss) / sum(n)")} AS brier FROM c GROUP BY stage""")
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d).withColumn("scaled", E.temperature_scaled(F.col("p"), lit(0.25)))
    return rounded(E.calibration_report(df, "p", "scaled"), "ece", "brier")


@reg(f"""WITH {SCORED_SQL}, r AS (SELECT generator, y, rank() OVER (PARTITION BY generator ORDER BY p) + (count(*) OVER (PARTITION BY generator, p) - 1) / 2e0 AS r FROM scored),
a AS (SELECT generator, coalesce((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0), 5e-1) AS roc_auc FROM r GROUP BY generator)
SELECT generator, {r6("roc_auc")} AS roc_auc FROM a ORDER BY a.roc_auc, generator LIMIT 1""")
def worst_holdout(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.worst_holdout(E.roc_auc_by(scored(spark, d), "generator")), "roc_auc")


@reg(f"""WITH {SCORED_SQL}, {MEMBERS_SQL}, a AS (SELECT id, {AVG_SQL} AS average, CASE WHEN id % 3 = 0 THEN NULL ELSE members[4] END AS meta FROM m)
SELECT id, {r6("coalesce(meta, average)")} AS raw FROM a""")
def raw_score(spark: SparkSession, d: str) -> DataFrame:
    m = members(F.col("p"))
    meta = F.when(F.col("id") % 3 != 0, m[3])
    return rounded(scored(spark, d).select("id", V.raw_score(m, meta).alias("raw")), "raw")


@reg(f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 1e2 END AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 2e2 END AS b FROM events),
e AS (SELECT event_id, coalesce(a, b) AS t FROM r) SELECT event_id, {r6(CLAMP_SQL)} AS threshold FROM e""")
def resolve_threshold(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.when(F.col("event_id") % n != 0, F.col("value") / lit(s)) for n, s in ((4, 100.0), (3, 200.0)))
    return rounded(table(spark, d, "events").select("event_id", V.resolve_threshold(a, b).alias("threshold")), "threshold")


@reg(f"""WITH {SCORED_SQL}, o AS (SELECT CASE WHEN starts_with(generator, 'src0') OR starts_with(generator, 'web') THEN 'proxy' ELSE 'genuine' END AS kind, count(*) AS n, {SUMS.format('5e-1')} FROM scored GROUP BY 1)
SELECT kind, n, tp, fp, fn, tn, {RATES} FROM o""")
def genuine_and_proxy(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d).withColumn("kind", E.kind_by_prefix(F.col("generator"), ("src0", "web")))
    return rounded(E.binary_metrics(df, 0.5, ["kind"]), *RATE_NAMES)
