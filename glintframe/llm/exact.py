"""Exact duplicates by stateful streaming, over a disk-backed keyed state that never expires.

Rows are landed first: digest of the normalised text, stable id, content locator (arrival, row
number, source file), the text, and the columns wanted back.  A stream over the landed rows keeps, for each
digest, the row to keep (largest id, then latest arrival and row), its locator and the count.  The state
lives in RocksDB, is checkpointed and has no watermark, so a copy is recognised however late it
comes: with a ``store``, in whatever later run.  Spark combines a batch's rows of a digest before it
shuffles them, so a group that holds a third of all rows reaches its state as one row per task.

A digest seen more than once is a hit, not yet a proof: the full texts of hits are compared,
as the least and the greatest text of a digest.  Texts that differ under one digest are told
apart by the text itself.  Texts stay where they were landed: hits and losers are picked by place.

Defined cases: a null text counts as empty; a null id loses to any other; of rows that are
alike in text and id exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, written
from .placed import Placed, place

#: Many small stores: RocksDB must not set aside disk for logs that stay short.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Parts of a group of copies whose full texts are compared apart.
SALTS = 32
SMALL = ("exact__id", "exact__digest", "exact__arrival", "exact__row", "exact__file")


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def land(docs: DataFrame, id_col: str, text_col: str, digest: Column, columns: list[str], store: str | None) -> Placed:
    """The rows that the stream reads, as one arrival in the store."""
    arrival = uuid.uuid4().hex if store else ""
    text = [] if text_col in columns else [F.col(text_col).cast("string").alias("exact__text")]
    rows = docs.select(
        F.col(id_col).alias("exact__id"),
        digest.alias("exact__digest"),
        F.lit(arrival).alias("exact__arrival"),
        F.input_file_name().alias("exact__file"),
        *text,
        *[F.col(c).alias(f"doc__{c}") for c in columns],
    )
    path = f"{store}/landed/arrival-{arrival}" if store else None
    return place(rows, "exact-landed", row="exact__row", chunk="exact__chunk", path=path)


def keyed_state(stream: DataFrame, into: str, checkpoint: str) -> None:
    """Runs ``stream`` of landed rows through the keyed state; the changed keys of each batch go to ``into``."""
    spark = stream.sparkSession
    kept = stream.groupBy("exact__digest").agg(
        F.max(F.struct("exact__id", "exact__arrival", "exact__row", "exact__file")).alias("keep"), F.count("*").alias("group_size")
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            kept.writeStream.outputMode("update").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _is_new(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def groups(landed: Placed, files_per_batch: int | None = None, store: str | None = None) -> DataFrame:
    """digest, keep (struct of id, arrival, row, file) and group_size of every digest, after the whole stream."""
    spark = landed.df.sparkSession
    reader = spark.readStream.schema(landed.df.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    into = f"{store}/state" if store else scratch(spark, "exact-state")
    checkpoint = f"{store}/checkpoint" if store else scratch(spark, "exact-checkpoint")
    kept = F.max(F.struct("exact__id", "exact__arrival", "exact__row", "exact__file")).alias("keep")
    if not landed.df.inputFiles() and not store:
        return landed.df.groupBy("exact__digest").agg(kept, F.count("*").alias("group_size"))
    keyed_state(reader.parquet(f"{store}/landed/*" if store else landed.path).select(*SMALL), into, checkpoint)
    # A key changes in any batch; its last state has the greatest keep and count.
    state = landed.df.groupBy("exact__digest").agg(kept, F.count("*").alias("group_size")).schema
    states = spark.createDataFrame([], state) if _is_new(spark, into) else spark.read.schema(state).parquet(into)
    return states.groupBy("exact__digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def collisions(landed: Placed, found: DataFrame, text: Column, earlier: DataFrame | None) -> DataFrame:
    """Digests of hits under which full texts differ; a group of any size is compared in ``SALTS`` parts first.

    earlier: (digest, text) of the rows that earlier arrivals keep.
    """
    hits = landed.df.select("exact__digest", "exact__row").join(found.where("group_size > 1").select("exact__digest"), "exact__digest", "left_semi")
    salt = F.pmod(F.col("exact__row"), F.lit(SALTS)).cast("int")
    full = landed.only(hits.select("exact__row")).select(F.col("exact__digest").alias("digest"), normalised(text).alias("full"), salt.alias("salt"))
    if earlier is not None:
        full = full.unionByName(earlier.withColumn("salt", F.lit(0)))
    parts = full.groupBy("digest", "salt").agg(F.min("full").alias("least"), F.max("full").alias("most"))
    return parts.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least != most").select("digest")


def kept_before(store: str, landed: Placed, text_name: str) -> DataFrame:
    """(digest, full) of all rows that arrivals before this one have landed under its digests."""
    spark = landed.df.sparkSession
    old = spark.read.schema(landed.df.schema).parquet(f"{store}/landed/*")
    arrival = landed.path.rsplit("arrival-", 1)[1]
    old = old.where(F.col("exact__arrival") != arrival)
    own = landed.df.select("exact__digest").distinct()
    old = old.join(own, "exact__digest", "left_semi")
    return old.select(F.col("exact__digest").alias("digest"), normalised(F.col(text_name)).alias("full"))


def _settled(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], columns: list[str], files_per_batch: int | None, store: str | None) -> tuple[Placed, DataFrame]:
    """The landed rows, and slim rows (doc_id, keep_id, group_size, kept, digest, exact__row) of them."""
    text = normalised(F.col(text_col))
    name = f"doc__{text_col}" if text_col in columns else "exact__text"
    landed = land(docs, id_col, text_col, digest(text), columns, store)
    found = written(groups(landed, files_per_batch, store), "exact-groups")
    clash = written(collisions(landed, found, F.col(name), kept_before(store, landed, name) if store else None), "exact-collisions")
    if not clash.isEmpty():
        if store:
            raise ValueError("texts differ under one digest of the store; begin a new store with another digest")
        # Under these digests the normalised text itself is the key of the state.
        known = docs.join(clash.withColumnRenamed("digest", "exact__clash"), digest(text) == F.col("exact__clash"), "left")
        key = F.when(F.col("exact__clash").isNotNull(), F.concat(F.lit(b"text:"), text.cast("binary"))).otherwise(digest(text))
        landed = land(known, id_col, text_col, key, columns, None)
        found = written(groups(landed, files_per_batch), "exact-groups")
    state = found.select(F.col("exact__digest").alias("state__digest"), "keep", "group_size")
    rows = landed.df.select(*SMALL).join(state, F.col("exact__digest") == F.col("state__digest"))
    same = (F.col("exact__row") == F.col("keep.exact__row")) & (F.col("exact__arrival") == F.col("keep.exact__arrival"))
    return landed, rows.select(
        F.col("exact__id").alias("doc_id"),
        F.col("keep.exact__id").alias("keep_id"),
        "group_size",
        same.alias("kept"),
        F.col("exact__digest").alias("digest"),
        "exact__row",
    )


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    columns: list[str] | None = None,
    files_per_batch: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, digest, and ``columns`` of the input with doc__ before their names.

    digest: of a normalised text, as binary.  files_per_batch: landed files that one batch of the stream reads.
    store: a folder that all executors share, where landed rows, state and checkpoint last.  A later
    call with it takes ``docs`` as the next arrival: groups and rows to keep are those of all arrivals so far.
    ``columns`` shuffles them; who wants only the rows that stay uses ``drop_exact_duplicates``.
    """
    columns = columns or []
    landed, rows = _settled(docs, id_col, text_col, digest, columns, files_per_batch, store)
    if columns:
        rows = rows.join(landed.df.select("exact__row", *[f"doc__{c}" for c in columns]), "exact__row")
    return rows.select("doc_id", "keep_id", "group_size", "kept", "digest", *[f"doc__{c}" for c in columns])


def drop_exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """``docs`` without the rows that another row stands for; no text is shuffled but those of hits."""
    landed, rows = _settled(docs, id_col, text_col, digest, docs.columns, files_per_batch, store)
    gone = written(rows.where(~F.col("kept")).select("exact__row"), "exact-gone")
    return landed.without(gone).select(*[F.col(f"doc__{c}").alias(c) for c in docs.columns])
