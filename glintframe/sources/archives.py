"""Members of zip archives as a Spark data source: the directory at an archive's end is read once, members are inflated in parallel.

A partition is a group of neighbouring members of one archive, or of whole archives that are smaller than that, of bounded size.  Only the
directories of large archives, of which there are few for the bytes, are read by the driver, those of small ones by the task that inflates their
members.  Partitions grow beyond ``split`` where there would be more than ``PARTITIONS`` of them, up to ``SPLIT``.  A member that is broken, encrypted, or packed by a method that isn't read is a row with a reason; the others go on.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glintframe.sources.contents import BATCH, SPLIT, _folder, _parse_schema, hidden

MEMBERS = "archive string, name string, length long, content binary, reason string"
DIGESTS = "archive string, length long, sha256 string"


#: Partitions of less than ``SPLIT`` bytes, at most, about.
PARTITIONS = 512


class Group(InputPartition):
    """Archives, each with the members to read, or None for all."""

    def __init__(self, archives: list[tuple[str, list[tuple] | None]]) -> None:
        super().__init__(len(archives))
        self.archives = archives


def _archives(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of all archives."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith(".zip") and not hidden(f.path, root))


def _bytes_at_once(found: list[tuple[str, int]], split: int) -> int:
    return max(split, min(SPLIT, -(-sum(size for _, size in found) // PARTITIONS)))


def _whole(found: list[tuple[str, int]], split: int) -> list[Group]:
    """Archives, unread, in groups of about ``split`` bytes."""
    out, size = [], 0
    for path, length in found:
        if not out or size + length > split:
            out.append(Group([]))
            size = 0
        out[-1].archives.append((path, None))
        size += length
    return out


def _directory(file: pa.NativeFile) -> list[tuple]:
    """What ``member_bytes`` needs of each member, in the order of their bytes."""
    with zipfile.ZipFile(file) as archive:
        infos = [i for i in archive.infolist() if not i.is_dir()]
    return [(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, i.flag_bits) for i in sorted(infos, key=lambda i: i.header_offset)]


class MemberReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Group]:
        system, root = _folder(self.options)
        found = _archives(system, root)
        split = _bytes_at_once(found, int(self.options.get("split", SPLIT)))
        out = _whole([f for f in found if f[1] <= split], split)
        for path, _ in (f for f in found if f[1] > split):
            try:
                with system.open_input_file(path) as file:
                    members = _directory(file)
            except (zipfile.BadZipFile, OSError, ValueError):
                out.append(Group([(path, None)]))  # its task tells the reason
                continue
            held, size = [], 0
            for member in members:
                held.append(member)
                size += member[2]
                if size >= split:
                    out.append(Group([(path, held)]))
                    held, size = [], 0
            if held:
                out.append(Group([(path, held)]))
        return out or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(_parse_schema(MEMBERS))
        system, _ = _folder(self.options)
        held, size = [], 0
        for path, members in partition.archives:
            for row in self.rows(system, path, members):
                held.append(row)
                size += len(row.get("content") or b"")
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    def rows(self, system: fs.FileSystem, path: str, members: list[tuple] | None) -> Iterator[dict]:
        most = int(self.options.get("most", 1 << 30))
        try:
            file = system.open_input_file(path)
        except OSError as why:
            yield {"archive": path, "reason": f"not a zip archive: {why}"}
            return
        with file:
            if members is None:
                try:
                    members = _directory(file)
                except (zipfile.BadZipFile, OSError, ValueError) as why:
                    yield {"archive": path, "reason": f"not a zip archive: {why}"}
                    return
            for member in members:
                content, reason = member_bytes(file, member, most)
                yield {"archive": path, "name": member[0], "length": member[3], "content": content, "reason": reason}


def member_bytes(file: pa.NativeFile, member: tuple, most: int) -> tuple[bytes | None, str | None]:
    """The bytes of one member, or the reason why there are none; a name that leaves its folder is refused."""
    name, offset, packed, length, method, crc, flags = member
    if name.startswith("/") or ".." in PurePosixPath(name).parts:
        return None, "a name outside of the archive's folder"
    if flags & 1:
        return None, "encrypted"
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, f"packing method {method}"
    if length > most:
        return None, "too large"
    try:
        file.seek(offset)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            return None, "no member where the directory says"
        file.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        data = file.read(packed)
        content = data if method == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(data, length + 1)
    except (zlib.error, struct.error, OSError) as why:
        return None, f"broken: {type(why).__name__}"
    if len(content) != length or zlib.crc32(content) != crc:
        return None, "broken: checksum"
    return content, None


class Members(DataSource):
    """Options: path (an archive, or a folder of them), most (bytes of a member), split (packed bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options)


class DigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Group]:
        found = _archives(*_folder(self.options))
        return _whole(found, _bytes_at_once(found, 0)) or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        system, _ = _folder(self.options)
        for path, _ in partition.archives:
            state, n = hashlib.sha256(), 0
            with system.open_input_stream(path) as file:
                while block := file.read(1 << 20):
                    state.update(block)
                    n += len(block)
            yield path, n, state.hexdigest()


class Digests(DataSource):
    """SHA-256 of each archive, as a stream."""

    @classmethod
    def name(cls) -> str:
        return "archive_digests"

    def schema(self) -> str:
        return DIGESTS

    def reader(self, schema: StructType) -> DigestReader:
        return DigestReader(self.options)


def digests(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(Digests)
    return spark.read.format("archive_digests").option("path", root).load()


def members(spark: SparkSession, root: str, pins: DataFrame | None = None, **options: str) -> DataFrame:
    """The members of all archives below ``root``.  Members of an archive whose digest isn't that of ``pins`` (file, sha256) have no content but a reason; unpinned ones are read."""
    spark.dataSource.register(Members)
    found = spark.read.format("members").options(path=root, **options).load()
    if pins is None:
        return found
    own = digests(spark, root).select(F.col("archive").alias("digest__archive"), F.element_at(F.split("archive", "/"), -1).alias("file"), F.col("sha256").alias("found"))
    bad = own.join(pins, "file").where(F.lower("sha256") != F.col("found")).select("digest__archive")
    marked = found.join(bad, F.col("archive") == F.col("digest__archive"), "left")
    changed = F.col("digest__archive").isNotNull()
    kept = marked.withColumns({"content": F.when(~changed, F.col("content")), "reason": F.when(changed, "the archive's checksum is another").otherwise(F.col("reason"))})
    return kept.drop("digest__archive")
