"""Stored objects as a Python data source: a file a row is written in two phases, and keys are read with a status.

    spark.dataSource.register(store.ImageStore)
    df.select("key", "content").write.format("imgrel").mode("append").save(root)
    spark.read.format("imgrel").load(root)

The scheme of the root (a folder, s3, gs, abfs, hdfs) decides the file system.
"""

from __future__ import annotations

import errno
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.media import MAX_KEY_BYTES, MAX_SOURCE_BYTES

SCHEMA = "key string, status int, length long, content binary"
#: Files that are being written lie in a folder of this name until the job commits.
STAGING = "_staging"
#: Bytes of files that a partition reads together.
SPLIT_BYTES = 128 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    return system, path.rstrip("/")


def key_fault(key: str | None) -> str | None:
    """Why a key names no object below the root."""
    if not key or key.startswith("/"):
        return "key must be relative and not empty"
    if len(key.encode()) > MAX_KEY_BYTES or any(c in key for c in "\0\r\n"):
        return "key is too long or has control characters"
    if any(part in ("", ".", "..") for part in key.split("/")) or key.split("/")[0] == STAGING:
        return "key has empty or relative segments"
    return None


def read_object(system: fs.FileSystem, root: str, key: str | None, max_bytes: int) -> tuple[int, int | None, bytes | None]:
    """``(status, length, content)``: 200, or 400 for a bad key, 404, 403, 413 for an object over the limit, 502 for any other fault."""
    if key_fault(key):
        return 400, None, None
    try:
        info = system.get_file_info(f"{root}/{key}")
        if info.type != fs.FileType.File:
            return 404, None, None
        if info.size > max_bytes:
            return 413, info.size, None
        with system.open_input_stream(f"{root}/{key}") as stream:
            content = stream.read(max_bytes + 1)
    except FileNotFoundError:
        return 404, None, None
    except PermissionError:
        return 403, None, None
    except OSError as error:
        return (403 if error.errno in (errno.EACCES, errno.EPERM) else 502), None, None
    return (413, len(content), None) if len(content) > max_bytes else (200, len(content), content)


def fetch(keys: DataFrame, root: str, max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """The rows of ``keys`` (a column ``key``) with ``status``, ``length`` and ``content``; nothing but the objects asked for is read."""
    others = [f for f in keys.schema.fields if f.name not in ("key", "status", "length", "content")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(root)
        for batch in batches:
            for k, key in enumerate(batch.column("key").to_pylist()):
                status, length, content = read_object(system, path, key, max_bytes)
                row = batch.slice(k, 1)
                made = [row.column("key"), pa.array([status], pa.int32()), pa.array([length], pa.int64()), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(row.column(f.name) for f in others), *made], [*(f.name for f in others), "key", "status", "length", "content"])

    return keys.select(*(f"`{f.name}`" for f in others), "key").mapInArrow(run, schema)


@dataclass
class _Split(InputPartition):
    """Keys that one task reads."""

    keys: list[str]


class _Reader(DataSourceReader):
    """Lists the root once and deals its files into partitions of about equal size."""

    def __init__(self, root: str, max_bytes: int, split_bytes: int):
        self.root, self.max_bytes, self.split_bytes, self.key = root, max_bytes, split_bytes, None

    def partitions(self) -> list[_Split]:
        if self.key is not None:
            return [_Split([self.key])]
        system, path = opened(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        splits, size = [[]], 0
        for info in sorted((x for x in found if x.type == fs.FileType.File), key=lambda x: x.path):
            key = info.path[len(path) + 1 :]
            if key_fault(key):
                continue
            if splits[-1] and size + info.size > self.split_bytes:
                splits.append([])
                size = 0
            splits[-1].append(key)
            size += info.size
        return [_Split(s) for s in splits]

    def read(self, partition: _Split) -> Iterator[tuple]:
        system, path = opened(self.root)
        for key in partition.keys:
            yield (key, *read_object(system, path, key, self.max_bytes))


class _KeyReader(_Reader):
    """With pushed filters: where one key is asked for nothing is listed."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.key is None:
                self.key = f.value
            else:
                yield f


@dataclass
class _Staged(WriterCommitMessage):
    """What a task has written: keys of its folder."""

    folder: str
    keys: list[str]


class _Writer(DataSourceWriter):
    """Tasks write below a staging folder; the driver moves the files of those that have committed, and then removes it.

    A task that is run twice has written to two folders, of which one is moved.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Staged:
        system, path = opened(self.root)
        folder, keys = f"{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        for row in rows:
            if fault := key_fault(row["key"]):
                raise ValueError(f"{fault}: {row['key']!r}")
            target = f"{path}/{folder}/{row['key']}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as stream:
                stream.write(bytes(row["content"] or b""))
            keys.append(row["key"])
        return _Staged(folder, keys)

    def commit(self, messages: list[_Staged | None]) -> None:
        system, path = opened(self.root)
        staged = [m for m in messages if m]
        keys = [key for m in staged for key in m.keys]
        if len(set(keys)) < len(keys):
            self.abort(messages)
            raise ValueError("a key stands in several rows")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and not key_fault(info.path[len(path) + 1 :]):
                    system.delete_file(info.path)
        for m in staged:
            for key in m.keys:
                target = f"{path}/{key}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                system.move(f"{path}/{m.folder}/{key}", target)
        self._clean(system, path)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clean(*opened(self.root))

    def _clean(self, system: fs.FileSystem, path: str) -> None:
        """Remove what this job has staged, and the staging folder if no other job uses it."""
        own = f"{path}/{STAGING}/{self.job}"
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)
        staging = f"{path}/{STAGING}"
        if system.get_file_info(staging).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(staging)):
            system.delete_dir(staging)


class ImageStore(DataSource):
    """``imgrel``: options ``path``, ``maxBytes``, ``splitBytes`` and ``pushKeys``.

    ``pushKeys`` needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "imgrel"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        get = self.options.get
        kind = _KeyReader if get("pushKeys", "false") == "true" else _Reader
        return kind(self.options["path"], int(get("maxBytes", MAX_SOURCE_BYTES)), int(get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)
