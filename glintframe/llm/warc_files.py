"""One-stream ``.warc.gz`` files of any size, rewritten where they lie: a member a record, and a sidecar index.

A file is a task's stream from its store: bytes are inflated as they are read, a record at a time becomes a gzip
member of the new file, and its place a line of the sidecar and a row of the result.  Nothing holds a file: memory
is that of the largest record.  A file gets its name when it is whole, so a task that runs again writes the same; a file that is broken is a row with a reason and
leaves nothing.

Defined cases: an empty file has no records; a folder without archives gives no rows; gzip files that already have many members are read alike.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .warc import GZIP, READ, member, records

ROWS = "archive string, record_id string, record_type string, offset long, length long, payload_bytes long, reason string"
ARROW = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("reason", pa.string())])
#: Rows of a batch.
BATCH = 1000


def streamed(file: pa.NativeFile) -> Iterator[bytes]:
    """What a gzip file holds, all members, in chunks of bounded size; an end before the last member's end is an error."""
    stream, began = zlib.decompressobj(GZIP), False
    while pending := file.read(READ):
        while pending:
            out = stream.decompress(pending, READ)
            began, pending = True, stream.unconsumed_tail
            if out:
                yield out
            if stream.eof:
                pending, stream, began = stream.unused_data, zlib.decompressobj(GZIP), False
    while began and not stream.eof:
        out = stream.decompress(b"", READ)
        if not out:
            raise ValueError("the gzip stream is cut short")
        yield out


class Archive(InputPartition):
    def __init__(self, path: str | None) -> None:
        super().__init__(path)
        self.path = path


class Rewriter(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.into = options["path"], options["into"]

    def partitions(self) -> list[Archive]:
        store, root = fs.FileSystem.from_uri(self.root)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(".warc.gz") and f.base_name[0] not in "._")
        return [Archive(path) for path in found] or [Archive(None)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        store, root = fs.FileSystem.from_uri(self.root)
        target, folder = fs.FileSystem.from_uri(self.into)
        name = partition.path.removeprefix(root).lstrip("/")
        parent = f"{folder}/{name}".rsplit("/", 1)[0]
        target.create_dir(parent, recursive=True)
        staged = [f"{parent}/.{uuid.uuid4().hex}.{ending}" for ending in ("warc.gz", "idx")]
        rows, at = [], 0
        try:
            with store.open_input_stream(partition.path, compression=None) as file, target.open_output_stream(staged[0], compression=None) as out, target.open_output_stream(staged[1]) as sidecar:
                for header, payload, whole in records(streamed(file)):
                    data = member(whole)
                    entry = {"record_id": header.get("warc-record-id"), "record_type": header.get("warc-type"), "offset": at, "length": len(data)}
                    out.write(data)
                    sidecar.write(json.dumps(entry).encode() + b"\n")
                    rows.append({"archive": name, **entry, "payload_bytes": len(payload)})
                    at += len(data)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
        except (ValueError, KeyError, zlib.error) as why:
            for path in staged:
                target.delete_file(path)
            yield pa.RecordBatch.from_pylist([{"archive": name, "reason": f"{type(why).__name__}: {why}"[:200]}], ARROW)
            return
        target.move(staged[0], f"{folder}/{name}")
        target.move(staged[1], f"{folder}/{name.removesuffix('.warc.gz')}.idx")
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class Rewritten(DataSource):
    """Options: path (a folder of archives) and into (the folder of the new ones), as URIs that every executor reaches."""

    @classmethod
    def name(cls) -> str:
        return "rewritten_warc"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> Rewriter:
        return Rewriter(self.options)


def rewrite(spark: SparkSession, root: str, into: str) -> DataFrame:
    """Rewrites all archives below ``root`` to ``into`` when it is computed: a row a record with its place in the new file, or a file's reason.

    Compute it once, as by writing it; rows of a file that breaks in its middle may come before its reason, whose file then isn't there.
    """
    spark.dataSource.register(Rewritten)
    return spark.read.format("rewritten_warc").options(path=root, into=into).load()
