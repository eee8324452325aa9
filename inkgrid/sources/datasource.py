"""Pictures as a Spark data source of its own: ``spark.read.format("inkgrid")`` and ``df.write.format("inkgrid")``.

Reading plans partitions by bytes: files in the order of their paths, as many to a partition as ``partitionBytes``
holds. A partition opens, decodes and turns its files one after another and hands them over in Arrow batches of
bounded size; a file that cannot be read or decoded is a row with its error.

Writing has two phases. A task writes its pictures into a folder of its own beside the target, out of sight; only when
all tasks are done are these folders put in place, each by one rename, and folders of attempts that failed or came
second are left behind and deleted. A new or replaced target appears by a single rename. Until then nobody sees a file
of the job, and no file waits for the driver: it renames one folder for each task.

Files are reached through Arrow's file systems (local, hdfs, s3, gs); writing needs one that renames folders. What only
Spark's own readers can open is read by ``decode(read_files(...))``.
"""

from __future__ import annotations

import contextlib
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import IMAGES
from . import pixels
from .images import array_of, image_row
from .stores import prefix_of, store_of

#: Bytes of files in a partition, and of pixels in a batch; files in a partition, which take time to open however small they are.
PARTITION_BYTES, BATCH_BYTES, PARTITION_FILES = 128 << 20, 32 << 20, 1000
FILES = "image_id string, content binary, error string"
_STRUCT = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])


def _flag(options: dict, name: str, default: bool) -> bool:
    value = str(options.get(name, default)).lower()
    if value not in ("true", "false"):
        raise ValueError(f"{name} is true or false, not {value!r}")
    return value == "true"


def _path(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("a path is needed: load(path) or save(path)")
    path = path if re.match(r"/|[a-z0-9+.-]+:/", path) else os.path.abspath(path)
    return path.rstrip("/") or "/"


class Pictures(DataSource):
    """Options of reading: pattern (default *), recursive, turn (by EXIF, default true), decode (false: bytes as they are), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "inkgrid"

    def schema(self):
        return IMAGES if _flag(self.options, "decode", True) else FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PictureReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PictureWriter(dict(self.options), schema.names, overwrite).begun()


@dataclass
class Files(InputPartition):
    """Paths of one partition."""

    paths: list[str]


def planned(found: list[tuple[str, int]], limit: int, most: int = PARTITION_FILES) -> list[list[str]]:
    """Paths in order, as many together as ``limit`` bytes hold, one at least and ``most`` at most; an empty file counts as a byte."""
    out, size = [], limit + 1
    for path, n in sorted(found):
        if size + max(n, 1) > limit or len(out[-1]) >= most:
            out.append([])
            size = 0
        out[-1].append(path)
        size += max(n, 1)
    return out


class PictureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = _path(options), options.get("pattern", "*")
        self.recursive, self.turn, self.decode = _flag(options, "recursive", False), _flag(options, "turn", True), _flag(options, "decode", True)
        self.limit = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        if self.limit < 1:
            raise ValueError("partitionBytes is at least 1")

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.path)
        top = store.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.is_file else store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        hidden = re.compile(r"/[._]|^[._]").search
        wanted = [(x.path, x.size) for x in found if x.is_file and (x is top or not hidden(x.path[len(root) :])) and (self.pattern == "*" or fnmatchcase(x.base_name, self.pattern))]
        return [Files(paths) for paths in planned(wanted, self.limit)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        before, rows, size = prefix_of(self.path), [], 0
        for path in partition.paths:
            row = self._row(store, path, before + path)
            n = 0 if row[1] is None else len(row[1]["data"] if self.decode else row[1])
            if rows and size + n > BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
            rows.append(row)
            size += n
        if rows:
            yield self._batch(rows)

    def _row(self, store: fs.FileSystem, path: str, key: str) -> tuple:
        try:
            with store.open_input_file(path) as f:
                content = f.read()
            if not self.decode:
                return key, content, None
            a = pixels.decode_picture(content)
            if self.turn:
                a = pixels.upright(a, pixels.exif_orientation(content))
            return key, image_row(key, pixels.to_bgr(a)), None
        except (pixels.LoadError, OSError) as e:
            return key, None, str(e)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds, names = (pa.string(), _STRUCT if self.decode else pa.binary(), pa.string()), ("image_id", "image" if self.decode else "content", "error")
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], list(names))


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task wrote, and how many files."""

    folder: str
    files: int


class PictureWriter(DataSourceArrowWriter):
    """Columns image_id and content (bytes as they are) or image (as PNG). Rows without a picture write nothing.

    A file is named by the last part of its image_id, with ``extension`` (default png) in place of its own; names that
    come again in a task get a number. Parts of a job lie in folders of their own, read again with ``recursive``.
    """

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.overwrite = _path(options), overwrite
        self.extension = str(options.get("extension", "png")).lstrip(".")
        self.column = next((c for c in ("content", "image") if c in names), None)
        if "image_id" not in names or self.column is None:
            raise ValueError("pictures are written from the columns image_id and content or image")
        job = uuid.uuid4().hex[:12]
        parent, _, name = self.path.rpartition("/")
        self.staging, self.old = f"{parent}/.{name}-{job}", f"{parent}/.{name}-{job}-old"

    def begun(self) -> PictureWriter:
        """Make the job's folder: tasks make theirs only inside it, so none comes back once the job is given up."""
        store, staging = store_of(self.staging)
        store.create_dir(staging, recursive=True)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}"
        store, folder = store_of(f"{self.staging}/{part}")
        used: dict[str, int] = {}
        files = 0
        for batch in iterator:
            for key, picture in zip(batch.column("image_id"), batch.column(self.column)):
                data = picture.as_py()
                if data is None:
                    continue
                if self.column == "image":
                    data = pixels.encode_png(array_of(data)[:, :, ::-1])
                if not files:
                    store.create_dir(folder, recursive=False)
                with store.open_output_stream(f"{folder}/{self._name(key.as_py(), used)}") as out:
                    out.write(data)
                files += 1
        return Written(part, files)

    def _name(self, key: str | None, used: dict[str, int]) -> str:
        stem = re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", key or "")[-1]) or "picture"
        stem = re.sub(r"^[._]+", "", re.sub(r"[\x00-\x1f:*?\"<>|]", "_", stem)) or "picture"
        used[stem] = used.get(stem, 0) + 1
        return f"{stem}.{self.extension}" if used[stem] == 1 else self._name(f"{stem}-{used[stem]}.x", used)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staging = store_of(self.staging)
        target, old = store_of(self.path)[1], store_of(self.old)[1]
        parts = {m.folder for m in messages if m is not None and m.files}
        store.create_dir(staging, recursive=True)
        for x in store.get_file_info(fs.FileSelector(staging)):
            if x.base_name not in parts:  # of attempts that failed or came second
                store.delete_dir(x.path)
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            for part in sorted(parts):
                store.move(f"{staging}/{part}", f"{target}/{part}")
            store.delete_dir(staging)
            return
        if there:
            store.move(target, old)
        store.move(staging, target)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staging = store_of(self.staging)
        for wait in (0.0, 0.1, 0.5, 2.0):  # tasks that still write may hold a folder for a moment
            time.sleep(wait)
            if store.get_file_info(staging).type == fs.FileType.NotFound:
                return
            with contextlib.suppress(OSError):
                store.delete_dir(staging)


def register_sources(spark: SparkSession) -> None:
    """Make the format ``inkgrid`` known to a session."""
    spark.dataSource.register(Pictures)


def read_pictures(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """image_id, image (BGR) and error of the pictures below a path; for the options see ``Pictures``."""
    register_sources(spark)
    return spark.read.format("inkgrid").options(**options).load(path)


def write_pictures(df: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Write pictures (columns image_id and content or image) as files, all or none; mode is append or overwrite."""
    register_sources(df.sparkSession)
    columns = [c for c in ("image_id", "content", "image") if c in df.columns]
    df.select(*columns).write.format("inkgrid").mode(mode).options(**options).save(path)
