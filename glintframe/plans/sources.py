"""Registered queries: what was written is read back, and compared with SQL over the tables it came from."""

from __future__ import annotations

import io
import time
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import lit
from glintframe.operators import manifest as M
from glintframe.plans.registry import Registry, rounded
from glintframe.session import workspace
from glintframe.sources import archives, files, stores
from glintframe.sources.contents import write_contents
from glintframe.streaming import jobs, watch
from glintframe.tables import table

reg = Registry()
ROUND = "floor(({}) * 1e6 + 5e-1) / 1e6"

MANIFEST_SQL = """m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'data/' || lang || '/' || doc_id || '.png' END AS image_path,
  CASE WHEN doc_id % 13 = 0 THEN 'many' WHEN doc_id % 17 = 0 THEN '7' WHEN doc_id % 19 = 0 THEN '' ELSE (doc_id % 2)::VARCHAR END AS label, source AS generator FROM documents),
j AS (SELECT *, CASE WHEN image_path = '' THEN 'no path' WHEN label = '' THEN 'no label' WHEN label = 'many' THEN 'label is no number'
  WHEN label = '7' THEN 'label is neither 0 nor 1' END AS reason FROM m)"""


def manifest_file(spark: SparkSession, d: str) -> str:
    """A manifest with some bad rows, written as CSV."""
    n = F.col("doc_id")
    path = F.when(n % 11 == 0, "").otherwise(F.concat(F.lit("data/"), "lang", F.lit("/"), n, F.lit(".png")))
    label = F.when(n % 13 == 0, "many").when(n % 17 == 0, "7").when(n % 19 == 0, "").otherwise((n % 2).cast("string"))
    rows = table(spark, d, "documents").select("doc_id", path.alias("image_path"), label.alias("label"), F.col("source").alias("generator"))
    into = workspace(spark, "manifest")
    files.write_csv(rows, into)
    return into


@reg(f"WITH {MANIFEST_SQL} SELECT doc_id, image_path, label::INT AS label, generator FROM j WHERE reason IS NULL")
def manifest_csv(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = files.manifest_csv(spark, manifest_file(spark, d))
    return files.require_two_classes(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "image_path", "label", "generator")


@reg(f"WITH {MANIFEST_SQL} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def manifest_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest_csv(spark, manifest_file(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@reg("SELECT conv_id, turn, role, text FROM conversations")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Text with quotes, commas and line ends through a CSV file."""
    into = workspace(spark, "rows")
    files.write_csv(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), into)
    rows = files.rows_csv(spark, into)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))


HISTORY_SQL = """h AS (SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS id, event_id::VARCHAR AS request_id, substr(repeat('upload/' || event_type || '/', 60), 1, 512) AS source,
  CASE WHEN value > 5e1 THEN 'ai' ELSE 'authentic' END AS verdict, CASE WHEN event_id % 2 = 1 THEN CASE WHEN value > 5e1 THEN 'ai' ELSE 'authentic' END END AS verdict_state,
  least(1e2, value) AS confidence, '{"event_type":"' || event_type || '"}' AS payload_json FROM events)"""


def history_of_events(spark: SparkSession, d: str) -> str:
    """A history in two appends: the even events without, the odd ones with a state."""
    into, verdict = workspace(spark, "history"), F.when(F.col("value") > 50, "ai").otherwise("authentic")
    rows = table(spark, d, "events").select(
        "event_id", F.col("event_id").cast("string").alias("request_id"), F.repeat(F.concat(F.lit("upload/"), "event_type", F.lit("/")), F.lit(60)).alias("source"), verdict.alias("verdict"),
        F.when(F.col("event_id") % 2 == 1, verdict).alias("verdict_state"), F.least(lit(100.0), "value").alias("confidence"), (F.col("value") / 100).alias("fake_probability"),
        F.lit(0).alias("latency_ms"), F.lit("2.0.0").alias("model_version"), F.lit("").alias("file_sha256"), F.struct("event_type").alias("payload"),
    )
    for odd in (0, 1):
        stores.append_history(rows.where(F.col("event_id") % 2 == odd), into, "event_id")
    return into


@reg(f"WITH {HISTORY_SQL} SELECT id, request_id, source, verdict, verdict_state, {ROUND.format('confidence')} AS confidence, payload_json FROM h")
def history_append(spark: SparkSession, d: str) -> DataFrame:
    rows = stores.history(spark, history_of_events(spark, d))
    return rounded(rows.select("id", "request_id", "source", "verdict", "verdict_state", "confidence", "payload_json"), "confidence")


@reg("SELECT event_id % 2 = 1 AS has_state, count(*) AS n FROM events GROUP BY 1")
def history_migration(spark: SparkSession, d: str) -> DataFrame:
    """Files of before a column was added are read beside newer ones."""
    into, rows = workspace(spark, "migrated"), table(spark, d, "events").withColumnRenamed("event_id", "id")
    rows.where("id % 2 = 0").select("id").write.parquet(into)
    rows.where("id % 2 = 1").select("id", F.lit("ai").alias("verdict_state")).write.mode("append").parquet(into)
    return stores.history(spark, into).groupBy(F.col("verdict_state").isNotNull().alias("has_state")).agg(F.count("*").alias("n"))


@reg("SELECT 0::BIGINT AS n")
def history_clear(spark: SparkSession, d: str) -> DataFrame:
    into = history_of_events(spark, d)
    stores.clear_history(spark, into)
    return stores.history(spark, into).agg(F.count("*").alias("n"))


JOB_SQL = """f AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS index, role || '-' || turn || '.png' AS filename, text FROM conversations),
o AS (SELECT *, CASE WHEN length(text) > 300 THEN 'file is too large' END AS error FROM f WHERE index < 64),
r AS (SELECT conv_id, index, filename, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN length(text) % 2 = 0 END AS is_ai,
  CASE WHEN error IS NULL THEN length(text) / 3e0 END AS confidence, error FROM o)"""


def job_outcomes(files_: DataFrame) -> DataFrame:
    n = F.length("text")
    results = {
        "is_ai": n % 2 == 0, "confidence": n / lit(3.0), "fake_probability": n / lit(300.0), "family": F.lit("other"), "latency_ms": F.lit(1.5),
    }
    return jobs.outcomes(files_, F.when(n > 300, "file is too large"), results)


def job_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat("role", F.lit("-"), "turn", F.lit(".png")).alias("filename"))
    return jobs.submitted(c, "conv_id", "turn")


@reg(f"""WITH {JOB_SQL} SELECT conv_id, index, filename, status, CASE WHEN is_ai IS NULL THEN '' WHEN is_ai THEN 'ai' ELSE 'authentic' END AS is_ai, {ROUND.format('confidence')} AS confidence,
error FROM r""")
def batch_csv(spark: SparkSession, d: str) -> DataFrame:
    """Every job's table as CSV, read back."""
    into, done = workspace(spark, "batch"), job_outcomes(job_files(spark, d))
    word = stores.batch_csv(done.withColumn("filename", F.concat("conv_id", F.lit(":"), "filename")))
    files.write_csv(word, into)
    rows = files.rows_csv(spark, into)
    name = F.split("filename", ":")
    rows = rows.select(
        name[0].cast("long").alias("conv_id"), F.col("index").cast("int").alias("index"), name[1].alias("filename"), "status", F.coalesce("is_ai", F.lit("")).alias("is_ai"),
        F.col("confidence").cast("double").alias("confidence"), "error",
    )
    return rounded(rows, "confidence")


@reg(f"WITH {JOB_SQL} SELECT conv_id, index, filename, status, is_ai, {ROUND.format('confidence')} AS confidence, error FROM r")
def batch_stream(spark: SparkSession, d: str) -> DataFrame:
    """The files of all jobs arrive in a folder; a stream judges them, a failed one beside the others."""
    arrived, into = workspace(spark, "arrived"), workspace(spark, "judged")
    job_files(spark, d).repartition(4).write.parquet(arrived)
    query = jobs.run_job(job_outcomes(jobs.arrivals(spark, arrived, spark.read.parquet(arrived).schema, 2)), into, workspace(spark, "checkpoint"))
    if not jobs.poll(query):
        raise TimeoutError("the job hasn't ended")
    rows = spark.read.parquet(into)
    return rounded(rows.select("conv_id", "index", "filename", "status", "is_ai", "confidence", "error"), "confidence")


@reg(f"SELECT event_type, count(*) AS n, {ROUND.format('avg(value)')} AS mean_value FROM events GROUP BY 1")
def live_figures(spark: SparkSession, d: str) -> DataFrame:
    arrived, into = workspace(spark, "events"), workspace(spark, "figures")
    table(spark, d, "events").select("event_type", "value").repartition(4).write.parquet(arrived)
    stream = jobs.arrivals(spark, arrived, "event_type string, value double", 2)
    figures = [F.count("*").alias("n"), F.avg("value").alias("mean_value")]
    jobs.live_counts(stream, into, workspace(spark, "checkpoint"), ["event_type"], figures).awaitTermination()
    return rounded(jobs.latest(spark, into), "mean_value")


@reg(f"""SELECT user_id, {ROUND.format("list_reduce(list_prepend(5e-1::DOUBLE, list(CASE WHEN value > 5e1 THEN 1e0 ELSE 0e0 END ORDER BY event_id)), lambda a, x: 1e-1 * x + 9e-1 * a)")} AS accuracy,
count(*) AS n FROM events GROUP BY user_id""")
def user_accuracy_stream(spark: SparkSession, d: str) -> DataFrame:
    """The moving accuracy of each user, kept from batch to batch while events arrive in three parts, one after the other."""
    arrived, into, checkpoint = (workspace(spark, name) for name in ("hits", "accuracy", "checkpoint"))
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 50).cast("int").alias("hit"))
    cuts = rows.agg(F.percentile_approx("event_id", [1 / 3, 2 / 3])).first()[0]
    for part in (F.col("event_id") <= cuts[0], (F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1]), F.col("event_id") > cuts[1]):
        rows.where(part).write.mode("append").parquet(arrived)
        jobs.moving_averages(jobs.arrivals(spark, arrived, rows.schema), into, checkpoint, "user_id", "event_id", "hit").awaitTermination()
    return rounded(jobs.last_batch(spark, into), "accuracy")


@reg("""WITH n AS (SELECT count(*) AS n, count(*) - ceil(greatest(count(*) - 2000, 0) / 1e3)::BIGINT * 1000 AS k FROM events),
b AS (SELECT value FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= (SELECT k FROM n)), s AS (SELECT list(value ORDER BY value) AS v, count(*) AS k FROM b)
SELECT n AS total, s.k AS n, v[(s.k // 2 + 1)::INT] AS p50, v[(least(s.k - 1, floor(s.k * 95e-2)) + 1)::INT] AS p95, v[(least(s.k - 1, floor(s.k * 99e-2)) + 1)::INT] AS p99 FROM n, s""")
def live_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Latencies arrive in three parts; a buffer that drops its oldest gives the figures after each."""
    arrived, into, checkpoint = (workspace(spark, name) for name in ("latencies", "samples", "checkpoint"))
    rows = table(spark, d, "events").select("event_id", "value")
    cuts = rows.agg(F.percentile_approx("event_id", [0.2, 0.7])).first()[0]
    for part in (F.col("event_id") <= cuts[0], (F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1]), F.col("event_id") > cuts[1]):
        rows.where(part).write.mode("append").parquet(arrived)
        jobs.sample_figures(jobs.arrivals(spark, arrived, rows.schema), into, checkpoint, "event_id", "value").awaitTermination()
    return jobs.last_batch(spark, f"{into}/figures")


@reg(f"""WITH {JOB_SQL}, k AS (SELECT count(*) AS n, sum((status = 'error')::INT)::BIGINT AS failed FROM r) SELECT n AS total, failed AS total_failed FROM k""")
def job_progress_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a listener wrote while the files of all jobs were judged: rows done and failed so far, of its last row."""
    arrived, into, told = workspace(spark, "arrived"), workspace(spark, "judged"), workspace(spark, "progress")
    job_files(spark, d).repartition(4).write.parquet(arrived)
    rows = job_outcomes(jobs.arrivals(spark, arrived, spark.read.parquet(arrived).schema, 2))
    listener = watch.Progress(spark, told)
    spark.streams.addListener(listener)
    try:
        query = jobs.run_job(watch.counted(rows, F.col("status") == "error"), into, workspace(spark, "checkpoint"))
        query.awaitTermination()
        until = time.monotonic() + 60
        while str(query.id) not in listener.ended and time.monotonic() < until:
            time.sleep(0.1)  # the listener hears of the end a little later
    finally:
        spark.streams.removeListener(listener)
    return watch.progress_rows(spark, told).agg(F.max("total").alias("total"), F.max("total_failed").alias("total_failed"))


def zipped(key: tuple, table_: pa.Table) -> pa.Table:
    """Pages as one archive; one in twenty is broken in it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        rows = sorted(table_.select(["page_id", "html"]).to_pylist(), key=lambda r: r["page_id"])
        for r in rows:
            archive.writestr(zipfile.ZipInfo(f"deep/{r['page_id']}.html"), r["html"] or "", zipfile.ZIP_STORED if r["page_id"] % 2 else zipfile.ZIP_DEFLATED)
        broken = [i for i, r in zip(archive.infolist(), rows) if r["page_id"] % 20 == 1 and i.file_size]
    data = bytearray(out.getvalue())
    for i in broken:
        data[i.header_offset + 30 + len(i.filename)] ^= 255
    return pa.table({"path": [f"part-{key[0].as_py()}.zip"], "content": pa.array([bytes(data)], pa.binary())})


@reg("""SELECT page_id AS id, 'part-' || (page_id // 40) || '.zip' AS archive, CASE WHEN page_id % 20 <> 1 THEN sha256(coalesce(html, '')) END AS sha256,
CASE WHEN page_id % 20 = 1 THEN 'broken: checksum' END AS reason FROM pages""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Pages packed into archives of forty, and their members read again in groups, good ones and broken ones."""
    into = workspace(spark, "archives")
    rows = table(spark, d, "pages").select("page_id", "html", F.floor(F.col("page_id") / 40).cast("long").alias("part"))
    write_contents(rows.groupBy("part").applyInArrow(zipped, "path string, content binary"), into)  # forty pages a group
    found = archives.members(spark, into, split="20000")
    number = F.regexp_extract("name", "([0-9]+)[.]html$", 1).cast("long")
    return found.select(number.alias("id"), F.element_at(F.split("archive", "/"), -1).alias("archive"), F.sha2("content", 256).alias("sha256"), "reason")


@reg("SELECT event_type AS stamp, round(avg(value), 3) AS accuracy, count(*) AS n FROM events GROUP BY 1 ORDER BY stamp DESC LIMIT 3")
def report_history(spark: SparkSession, d: str) -> DataFrame:
    """Reports appended one by one; a broken entry is left out, the newest three are kept."""
    folder = workspace(spark, "reports")
    slim = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("accuracy"), F.count("*").alias("n"))
    for r in slim.collect():  # a row for each type of event
        stores.append_report(spark, {"accuracy": r.accuracy, "n": r.n, "roc_points": [0, 1]}, folder, r.event_type)
    spark.createDataFrame([("{broken",)], "body string").write.mode("append").text(f"{folder}/history")
    return stores.report_history(spark, folder, "accuracy double, n long", 3)


@reg("SELECT max(event_type) AS stamp, 2::BIGINT AS points FROM events")
def report_read(spark: SparkSession, d: str) -> DataFrame:
    folder = workspace(spark, "reports")
    for r in table(spark, d, "events").select("event_type").distinct().collect():  # a row for each type of event
        stores.append_report(spark, {"roc_points": [0, 1]}, folder, r.event_type)
    body = F.from_json("body", "roc_points array<int>")
    return stores.read_report(spark, folder).select("stamp", F.size(body["roc_points"]).cast("long").alias("points"))


@reg("SELECT vec_id, embedding FROM embeddings")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows, into = table(spark, d, "embeddings").select("vec_id", "embedding"), workspace(spark, "store")
    stores.export_json(rows, into)
    return stores.import_json(spark, into, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@reg("SELECT doc_id, quality, toxic FROM labels")
def signed_export(spark: SparkSession, d: str) -> DataFrame:
    rows, into = table(spark, d, "labels").select("doc_id", "quality", "toxic"), workspace(spark, "signed")
    stores.export_signed(rows, into)
    return stores.import_verified(spark, into, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@reg("""WITH p AS (SELECT page_id::VARCHAR AS path, sha256(html) AS found FROM pages),
q AS (SELECT path, found, CASE WHEN path::BIGINT % 3 = 0 THEN NULL WHEN path::BIGINT % 3 = 1 THEN found ELSE 'x' END AS sha256 FROM p)
SELECT path, found, CASE WHEN sha256 IS NULL THEN 'unpinned' WHEN sha256 = found THEN 'ok' ELSE 'changed' END AS state FROM q""")
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"), "page_id")
    pins = rows.where("page_id % 3 > 0").select("path", F.when(F.col("page_id") % 3 == 1, F.sha2("content", 256)).otherwise("x").alias("sha256"))
    return files.checksums(rows, pins)


@reg("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source) AS path, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, 'pristine') AS state FROM documents")
def column_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("path"), "source", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("state"))
    return rows.select("doc_id", M.fallback("path", "source").alias("path"), F.coalesce("state", F.lit("pristine")).alias("state"))
