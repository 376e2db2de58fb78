"""WARC archives: one-stream gzip files made into files of one gzip member a record, with an offset index.

A ``.warc.gz`` written as one gzip stream can't be read from the middle.  ``normalise``
inflates each such file once, front to back, writes every record as its own gzip
member, and lists the members' offsets beside them.  Any record can then be read by
itself (``read_members``).

Archives are rows: (archive, content) as Spark's ``binaryFile`` source gives them
(``load``), so they lie in any store that Spark reaches.  A writer starts a new archive
at a size bound; records of any size are whole.  ``export`` writes rows as files.

Records with equal payloads from ``least_bytes`` on are stored once: the smallest id
keeps the payload, the others are revisits that name it (``revisits``).  Equal payloads meet
as digest and least id, combined before the shuffle; no page waits for another.

Defined cases: a null payload is empty; a null id never is the one that keeps the payload, unless all
are null; of repeated rows (same id and payload) one is the response, the others revisit it; an empty table gives
no archive; very long payloads make long archives, never cut ones.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

GZIP = 16 + zlib.MAX_WBITS
LEVEL = 3
#: A writer closes an archive once it holds so many bytes, before compression.
ARCHIVE_BYTES = 16 << 20
READ = 1 << 18
#: Fixed value: the date of records whose page has none.
DATE = "1970-01-01T00:00:00Z"
INDEX = "array<struct<record_id:string,record_type:string,offset:long,length:long>>"


def record(kind: str, record_id: str, uri: str, payload: bytes, fields: dict[str, str]) -> bytes:
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": _line(uri),
        **fields, "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, payload, the record's bytes) of each record in a stream of inflated chunks."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            header = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
            start, n = end + 4, int(header["content-length"])
            if len(held) < start + n + 4:
                break
            yield header, bytes(held[start : start + n]), bytes(held[at : start + n + 4])
            at = start + n + 4
        del held[:at]
    if held:
        raise ValueError(f"a record of the archive is cut short: {bytes(held[:80])!r}")


def inflated(content: bytes) -> Iterator[bytes]:
    """What gzip ``content`` holds, all members, a bounded chunk at a time."""
    view, at = memoryview(content), 0
    stream = zlib.decompressobj(GZIP)
    pending = b""
    while at < len(view) or pending:
        if not pending:
            pending, at = bytes(view[at : at + READ]), at + READ
        out = stream.decompress(pending, READ)
        pending = stream.unconsumed_tail
        if out:
            yield out
        if stream.eof:
            pending, stream = stream.unused_data, zlib.decompressobj(GZIP)
    if out := stream.flush():
        yield out


def member(data: bytes) -> bytes:
    stream = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return stream.compress(data) + stream.flush()


def revisits(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """``pages`` as (id, row, payload, digest, refers_to, refers_row); the last two are null but for revisits."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col("url").alias("uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    long = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
    known = written(long.where("n > 1").select(F.col("digest").alias("known"), F.col("first.id").alias("first_id")), "warc-known")
    return rows.join(known, (F.col("digest") == F.col("known")) & (F.length("payload") >= least_bytes), "left")


def write_monolithic(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): archives of one gzip stream each, made by the tasks that hold ``rows`` (id, uri, payload, digest, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0

        def close() -> pa.RecordBatch:
            content = b"".join([*parts, stream.flush()])
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for id_, uri, payload, digest, revisit, refers in zip(*(batch.column(i) for i in range(6))):
                body, name = payload.as_py(), json.dumps(id_.as_py())
                fields = {"WARC-Payload-Digest": f"sha256:{digest.as_py().hex()}", "X-Payload-Length": str(len(body))}
                if revisit.as_py():
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{json.dumps(refers.as_py())}>"}
                data = record("revisit" if revisit.as_py() else "response", name, uri.as_py() or "", b"" if revisit.as_py() else body, fields)
                parts.append(stream.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    stream, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), [], 0
        if size:
            yield close()

    return rows.select("id", "uri", "payload", "digest", "revisit", "refers_to").mapInArrow(run, "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content) -> (archive, content, index): every record its own gzip member, and where each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                parts, index, at = [], [], 0
                for header, _, whole in records(inflated(content.as_py())):
                    parts.append(member(whole))
                    index.append({"record_id": header.get("warc-record-id"), "record_type": header.get("warc-type"), "offset": at, "length": len(parts[-1])})
                    at += len(parts[-1])
                kind = pa.list_(pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([b"".join(parts)], pa.binary()), pa.array([index], kind)], ["archive", "content", "index"])

    return archives.select("archive", "content").mapInArrow(run, f"archive string, content binary, index {INDEX}")


def read_members(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, read by its index entry alone: id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "archive string, offset long, id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    names = ["archive", "offset", "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, index in zip(batch.column(0), batch.column(1), batch.column(2)):
                view, rows = memoryview(content.as_buffer()), []
                for entry in index.as_py():
                    part = bytes(view[entry["offset"] : entry["offset"] + entry["length"]])
                    ((header, payload, _),) = records(inflated(part))
                    own, said = hashlib.sha256(payload).hexdigest(), header.get("warc-payload-digest", "")
                    kind, record_id, refers = header.get("warc-type"), header.get("warc-record-id"), header.get("warc-refers-to")
                    ours = said.startswith("sha256:")  # other archives name other digests, of other parts of a record
                    if ours and kind != "revisit" and said != f"sha256:{own}":
                        raise ValueError(f"{name}: payload and digest of {record_id} differ")
                    digest, size = (said[7:] if ours else own), int(header.get("x-payload-length", len(payload)))
                    rows.append((name.as_py(), entry["offset"], _page(record_id), size, digest, kind, _page(refers), payload))
                    if len(payload) > READ or len(rows) >= 256:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    return archives.select("archive", "content", "index").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def _page(urn: str | None) -> str | None:
    """The page's id in an identifier of our own making; others stay as they are."""
    if urn is None or not urn.startswith("<urn:page:"):
        return urn
    found = json.loads(urn.removeprefix("<urn:page:").removesuffix(">"))
    return None if found is None else str(found)


def archive(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to normalised archives in the shared folder: (archive, content, index)."""
    rows = revisits(pages, id_col=id_col, payload_col=payload_col, least_bytes=least_bytes)
    # Of repeated rows with the least id only one is the response.
    mine = F.col("known").isNotNull() & F.col("id").eqNullSafe(F.col("first_id"))
    again = rows.where(mine).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        held = written(rows, "warc-rows")
        only = held.where(mine).groupBy(F.col("digest").alias("only__digest")).agg(F.min("row").alias("only"))
        rows = held.join(written(only, "warc-only"), F.col("digest") == F.col("only__digest"), "left")
        mine = mine & (F.col("row") == F.col("only"))
    revisit = F.col("known").isNotNull() & ~mine
    rows = rows.select("id", "uri", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))
    monolithic = written(write_monolithic(rows, archive_bytes), "warc-monolithic", "uncompressed")
    return written(normalise(monolithic), "warc-members", "uncompressed")


def index(archives: DataFrame) -> DataFrame:
    """The sidecar: (archive, record_id, record_type, offset, length)."""
    return archives.select("archive", F.inline("index"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of ``.warc.gz`` files in any store."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("archive"), "content")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes rows of normalised archives as files ``<archive>.warc.gz`` and ``<archive>.idx``; one row (archive, bytes) each.

    folder: a URI of a store that every executor reaches (``pyarrow.fs``).  A file gets its name when it is whole, so a task that runs again writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content, entries in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for ending, data in (("warc.gz", content), ("idx", "".join(json.dumps(e) + "\n" for e in entries).encode())):
                    at = f"{root}/.{name}-{uuid.uuid4().hex}"
                    with store.open_output_stream(at) as out:
                        out.write(data)
                    store.move(at, f"{root}/{name}.{ending}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)])], ["archive", "bytes"])

    return archives.select("archive", "content", "index").mapInArrow(run, "archive string, bytes long")
