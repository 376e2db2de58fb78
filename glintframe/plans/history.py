"""Registered queries: audit history, live metrics, batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit, round6
from glintframe.operators import history as H
from glintframe.plans.evaluation import r6
from glintframe.streaming import jobs
from glintframe.plans.registry import Registry, rounded
from glintframe.tables import SCORED_SQL, scored, table

reg = Registry()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@reg("SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY event_id DESC LIMIT 50")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    last = H.recent(events(spark, d), 50, "event_id")
    return last.select("event_id", "event_type", H.payload_number(F.col("props"), "k").cast("long").alias("k"))


@reg(f"SELECT count(*) AS total, {r6('coalesce(avg(value), 0)')} AS mean_latency, coalesce(sum((event_type = 'purchase')::BIGINT), 0)::BIGINT AS hits FROM events")
def history_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.stats(events(spark, d), F.col("event_type") == "purchase", "value"), "mean_latency")


@reg(f"""WITH {SCORED_SQL} SELECT id, substr(generator || '/' || id, 1, 512) AS source, CASE WHEN p >= 5e-1 THEN 'ai' ELSE 'authentic' END AS verdict FROM scored""")
def history_rows(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d).withColumns({"source": F.concat_ws("/", "generator", "id"), "is_ai": F.col("p") >= 0.5, "verdict_state": F.lit("")})
    return H.history_row(df).select("id", "source", "verdict")


@reg("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT max(n) AS n, max(value) FILTER (r = n // 2) AS p50, max(value) FILTER (r = least(n - 1, floor(n * 95e-2))) AS p95 FROM s""")
def metrics_snapshot_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return H.nearest_rank(events(spark, d), "value")


@reg("""WITH n AS (SELECT count(*) AS n FROM events), k AS (SELECT CASE WHEN n <= 2000 THEN n ELSE n - ceil((n - 2000) / 1e3)::BIGINT * 1000 END AS k FROM n)
SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= (SELECT k FROM k)""")
def bounded_latency(spark: SparkSession, d: str) -> DataFrame:
    return H.bounded_sample(events(spark, d).select("event_id", "value"), "event_id")


@reg("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def keep_last_by_user(spark: SparkSession, d: str) -> DataFrame:
    return H.keep_last(events(spark, d).select("user_id", "event_id"), 5, "event_id", ["user_id"])


@reg("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def keep_last_100(spark: SparkSession, d: str) -> DataFrame:
    return H.keep_last(events(spark, d).select("event_id"), 100, "event_id")


@reg(f"""SELECT count(*) AS n, sum((event_type = 'purchase')::BIGINT)::BIGINT AS ai, sum((event_type = 'view')::BIGINT)::BIGINT AS authentic, {r6("avg(value)")} AS mean_latency,
{r6("sum((event_type = 'purchase')::BIGINT) * 1e2 / greatest(count(*), 1)")} AS ai_percent FROM events""")
def kpi_strip(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return rounded(H.kpis(events(spark, d), kind == "purchase", kind == "view", "value"), "mean_latency", "ai_percent")


@reg(f"WITH {SCORED_SQL}, b AS (SELECT least(9, floor(p * 100 / 100 * 10))::BIGINT AS bin FROM scored WHERE p >= 5e-1) SELECT r.bin, count(b.bin) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON r.bin = b.bin GROUP BY r.bin")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return H.histogram(scored(spark, d).where("p >= 0.5"), F.col("p") * 100)


@reg("SELECT event_id, value, (row_number() OVER (ORDER BY ts) - 1)::INT AS place FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 60)")
def latency_trend(spark: SparkSession, d: str) -> DataFrame:
    return H.trend(events(spark, d).select("event_id", "value", "ts"), "ts").drop("ts")


@reg("""SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'green' ELSE 'grey' END AS style FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 12)""")
def narrative_severity_join(spark: SparkSession, d: str) -> DataFrame:
    styles = spark.createDataFrame([("error", "red"), ("purchase", "green")], "event_type string, style string")
    return H.with_style(H.recent(events(spark, d), H.FEED_ROWS, "event_id").select("event_id", "event_type"), styles, "event_type", "grey")


@reg("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def verdict_mix(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@reg("""SELECT conv_id, turn, role, substr(text, 1, 40) AS head, CASE WHEN length(text) = 0 THEN '' WHEN role = 'assistant' THEN 'ai' ELSE 'authentic' END AS verdict,
floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 23)::BIGINT AS page FROM conversations""")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    verdict = F.when(F.length("text") == 0, "").when(F.col("role") == "assistant", "ai").otherwise("authentic")
    return H.pages(c, "turn", "conv_id").select("conv_id", "turn", "role", F.substring("text", 1, 40).alias("head"), verdict.alias("verdict"), "page")


@reg(f"""SELECT conv_id, count(*) AS n, sum((NOT (length(text) > 300))::BIGINT)::BIGINT AS done, sum((length(text) > 300)::BIGINT)::BIGINT AS errors,
{r6("sum((NOT (length(text) > 300))::BIGINT) / count(*)")} AS share FROM conversations GROUP BY conv_id""")
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.job_progress(table(spark, d, "conversations"), "conv_id", F.length("text") > 300), "share")


@reg("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS index FROM conversations QUALIFY index < 64")
def batch_submit(spark: SparkSession, d: str) -> DataFrame:
    """The first 64 files of a job, numbered; what is over its limit is left out, as the service does."""
    return jobs.submitted(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@reg(f"SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, {r6('avg(value)')} AS mean_value FROM events GROUP BY ALL")
def daily_mix(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type")
    return df.agg(F.count("*").alias("n"), round6(F.avg(F.col("value") * lit(1.0))).alias("mean_value"))
