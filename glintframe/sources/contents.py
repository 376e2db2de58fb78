"""Folders of files as Spark data sources: ``contents`` (bytes, read and written) and ``images`` (pixels, or why there are none).

Files are listed once; a partition is a group of files of bounded size and number: many small files share a task, whose images cost more than their bytes.  A file is opened once: its length is known before, so
what is over the limit isn't read; what is read is told apart by its first bytes, decoded and turned upright in the same task.  Folders
are reached by pyarrow's file systems, by URI.  Each row of a frame written as ``contents`` becomes a file, which appears under its name only when
the whole job has succeeded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glintframe.functions.codecs import CodecError, container, decode
from glintframe.operators.manifest import EXTENSIONS
from glintframe.operators.planes import turn_of, turned
from glintframe.sources.files import MOST_BYTES

CONTENTS = "path string, length long, content binary"
IMAGES = "path string, length long, container string, height int, width int, channels int, pixels binary, orientation int, reason string, content binary"
#: Bytes of the files of a partition, about, and files at most; bytes of a batch that is handed to Spark.
SPLIT, MANY, BATCH = 64 << 20, 256, 8 << 20


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(len(files))
        self.files = files


def _folder(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def wanted(self, name: str) -> bool:
        return True

    def partitions(self) -> list[Files]:
        system, root = _folder(self.options)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not hidden(f.path, root) and self.wanted(f.base_name))
        split, out, size = int(self.options.get("split", SPLIT)), [], 0
        for path, length in found:
            if not out or size + length > split or len(out[-1]) >= MANY:
                out.append([])
                size = 0
            out[-1].append((path, length))
            size += length
        return [Files(own) for own in out] or [Files([])]

    def rows(self, content: bytes, path: str, length: int) -> dict:
        return {"path": path, "length": length, "content": content if content is not None or length else b""}

    schema = CONTENTS

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _folder(self.options)
        most = int(self.options.get("most", 0))
        arrow = to_arrow_schema(_parse_schema(self.schema))
        held, size = [], 0
        for path, length in partition.files:
            content = None
            if length and not (most and length > most):
                with system.open_input_stream(path) as file:
                    content = file.read()
            row = self.rows(content, path, length)
            held.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, bytes))
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)


def hidden(path: str, root: str) -> bool:
    return any(part[:1] in "._" for part in PurePosixPath(path).relative_to(root).parts)


def _parse_schema(text: str) -> StructType:
    fields = [f.split(" ") for f in text.split(", ")]
    out = StructType()
    for name, kind in fields:
        out = out.add(name, {"int": "integer"}.get(kind, kind))
    return out


class ImageReader(FolderReader):
    """The files with an image's extension; the others aren't listed."""

    schema = IMAGES

    def wanted(self, name: str) -> bool:
        return name.lower().endswith(tuple(EXTENSIONS))

    def rows(self, content: bytes | None, path: str, length: int) -> dict:
        row = {"path": path, "length": length}
        if content is None:
            return row | {"reason": "file is too large" if length else "empty file"}
        kind = container(content)
        row |= {"container": kind, "content": content if self.options.get("content") == "true" else None}
        try:
            image = decode(content)
        except CodecError as why:
            return row | {"reason": str(why)}
        way = turn_of(content) if kind in ("jpeg", "png", "webp") else 1
        image = np.ascontiguousarray(turned(image, way))
        return row | {"height": image.shape[0], "width": image.shape[1], "channels": 3, "pixels": image.tobytes(), "orientation": way}


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ContentWriter(DataSourceWriter):
    """Each row (path, content) becomes a file; those of a job lie in a hidden folder until it commits."""

    def __init__(self, options: dict, columns: list[str]) -> None:
        self.options, self.job = dict(options), uuid.uuid4().hex
        self.at = columns.index("path"), columns.index("content")

    def staged(self, root: str, name: str) -> str:
        return f"{root}/.staged-{self.job}/{name}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = _folder(self.options)
        attempt = str(TaskContext.get().taskAttemptId())
        names = []
        for row in rows:
            name = checked(row[self.at[0]])
            at = self.staged(root, f"{attempt}/{name}")
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(at) as file:
                file.write(bytes(row[self.at[1]] or b""))
            names.append(f"{attempt}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _folder(self.options)
        for staged in (name for m in messages if m for name in m.names):
            at = f"{root}/{staged.split('/', 1)[1]}"
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            system.move(self.staged(root, staged), at)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _folder(self.options)
        at = self.staged(root, "")
        if system.get_file_info(at.rstrip("/")).type != fs.FileType.NotFound:
            system.delete_dir(at)


def checked(name: str) -> str:
    """A relative path that stays in its folder."""
    parts = PurePosixPath(name or "").parts
    if not parts or name.startswith("/") or ".." in parts:
        raise ValueError(f"not a file's relative path: {name!r}")
    return "/".join(parts)


class Contents(DataSource):
    """Options: path, most (bytes beyond which content is null), split."""

    @classmethod
    def name(cls) -> str:
        return "contents"

    def schema(self) -> str:
        return CONTENTS

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ContentWriter:
        return ContentWriter(self.options, schema.names)


class Images(DataSource):
    """Options: path, most (bytes of a file, 25 MiB if not said), split, content (true: the file's bytes too)."""

    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return IMAGES

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader({"most": str(MOST_BYTES), **self.options})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Contents)
    spark.dataSource.register(Images)


def images(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Image files below ``root``: upright pixels, or the reason why there are none."""
    register(spark)
    return spark.read.format("images").options(path=root, **options).load()


def contents(spark: SparkSession, root: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("contents").options(path=root, **options).load()


def write_contents(df: DataFrame, root: str) -> None:
    """``df`` (path, content) as one file a row below ``root``."""
    register(df.sparkSession)
    df.select("path", "content").write.format("contents").mode("append").option("path", root).save()
