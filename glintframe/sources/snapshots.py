"""Tables that are upserted and last: buckets of rows by key, and a manifest that names the files of each bucket.

An upsert reads the buckets that its keys fall in, writes them anew beside the old ones, and publishes both by one atomic rename of a
manifest; other buckets aren't touched.  Readers open the newest manifest, so they see all of an upsert or nothing of
it; a writer that dies leaves files that no manifest names, and of two writers that began from the same version the second is told so.  Old versions can be read until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION, COUNT = "version", "snapshot__count"


class Conflict(RuntimeError):
    """Another writer has published a version since this one began."""


class Snapshots:
    """A table of rows with a unique ``key`` (one column or several) and ``version``, how often the row has been put.

    ``bucket_by``: columns of the key that decide the bucket, where rows are looked up by these.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str | StructType, buckets: int = 64, bucket_by: list[str] | None = None) -> None:
        self.spark, self.root, self.key, self.buckets, self.by = spark, root.rstrip("/"), key, buckets, bucket_by or key
        self.schema = spark.createDataFrame([], schema).schema
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- files --

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path("x").getFileSystem(self.conf)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, and the folder of each bucket that has rows."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self.buckets, "folders": {}}
        text = self.spark.read.text(f"{self.root}/manifests/{known[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        if found["buckets"] != self.buckets:
            raise ValueError(f"the table has {found['buckets']} buckets")
        return found

    def _publish(self, manifest: dict) -> None:
        staged, final = self._path(f"manifests/.staged-{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:012d}.json")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else self._fs.getUri(), self.conf)
        try:
            context.rename(staged, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as why:
            self._fs.delete(staged, False)
            raise Conflict(f"version {manifest['version']} is there already") from why

    # -- rows --

    @property
    def _whole(self) -> StructType:
        return StructType([*self.schema.fields, *self.spark.createDataFrame([], f"{VERSION} long").schema.fields])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._whole)
        return self.spark.read.schema(self._whole).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of one that is named."""
        return self._rows(sorted(set(self.manifest(version)["folders"].values())))

    def touched(self, rows: DataFrame) -> DataFrame:
        """The rows of the buckets that ``rows`` (with the columns that buckets are made by) fall in; other files aren't opened."""
        folders = self.manifest()["folders"]
        wanted = {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
        return self._rows(sorted({f for b, f in folders.items() if b in wanted}))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: Column | None = None) -> int:
        """Puts ``rows``; of several with one key the last by ``order`` stays, and each counts in its version.  Returns the new version."""
        names = [f.name for f in self.schema.fields]
        rows = rows.withColumn("snapshot__order", F.lit(0) if order is None else order)
        last = F.max_by(F.struct(*names), "snapshot__order")
        new = rows.groupBy(*[F.col(k).alias(f"key__{k}") for k in self.key]).agg(last.alias("row"), F.count("*").alias(COUNT)).select("row.*", COUNT)
        return self._merge(new)

    def delete(self, keys: DataFrame) -> int:
        """Takes the rows with these keys out."""
        gone = keys.select(*self.key).distinct()
        empty = gone.select(*[F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(None).cast("long").alias(COUNT))
        return self._merge(empty)

    def _merge(self, new: DataFrame) -> int:
        """Rows without a count are taken out, the others put."""
        before = self.manifest()
        data = f"data/{before['version'] + 1:012d}-{uuid.uuid4().hex}"
        staged = f"{self.root}/{data}-in"
        new.withColumn("snapshot__bucket", self._bucket()).write.partitionBy("snapshot__bucket").parquet(staged)
        new = self.spark.read.schema(StructType([*new.schema.fields, *self.spark.createDataFrame([], "snapshot__bucket int").schema.fields])).parquet(staged)
        touched = sorted(r[0] for r in new.select("snapshot__bucket").distinct().collect())  # as many as there are buckets at most
        names = [f.name for f in self.schema.fields]
        old = self._rows([before["folders"][str(b)] for b in touched if str(b) in before["folders"]])
        here = F.lit(True)
        for k in self.key:
            here = here & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        both = new.withColumn("snapshot__new", F.lit(True)).alias("n").join(old.withColumn("snapshot__old", F.lit(True)).alias("o"), here, "full")
        isnew = F.col("snapshot__new").isNotNull()
        kept = both.where(~isnew | F.col(COUNT).isNotNull()).select(
            *[F.when(isnew, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names], (F.coalesce(F.col(f"o.{VERSION}"), F.lit(0)) + F.coalesce(F.col(COUNT), F.lit(0))).alias(VERSION)
        )
        kept.withColumn("snapshot__bucket", self._bucket()).write.partitionBy("snapshot__bucket").parquet(f"{self.root}/{data}")
        folders = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{data}/snapshot__bucket={b}" for b in touched if self._fs.exists(self._path(f"{data}/snapshot__bucket={b}"))}
        self._fs.delete(self._path(f"{data}-in"), True)
        self._publish({"version": before["version"] + 1, "buckets": self.buckets, "folders": folders})
        return before["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` versions, and files that these don't name.  Not while a writer is at work."""
        known = self.versions()
        kept = known[-keep:]
        used = {f.split("/")[1] for v in kept for f in self.manifest(v)["folders"].values()}
        for v in known[: -keep or None]:
            self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        data = self._path("data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
