"""File trees as a Spark data source, for batches and for streams.

``spark.read.format("corpusloom_tree").load(root)`` gives the manifest ``(path, length, modified)`` of a tree, and so does
``spark.readStream``, for what was modified since the last batch. Names that begin with ``_`` or ``.`` and empty files are included,
unlike in Spark's own file sources (``hidden`` = ``false`` leaves dot names out).

Partitions are planned from a shallow listing: the driver descends until it has ``folders`` folders, each the root of a partition,
and counts the entries it passes. A folder with more than ``entries_per_task`` of them is shared: every task lists its names and looks up
length and time only of its share. The files themselves are listed by the tasks and never come to the driver.

The offsets of a stream are times: a batch has the files modified after the last offset, up to ``delay_seconds`` ago, so that files of one
moment are in one batch and a file being written is left for the next. The driver keeps no list of files. A file that is moved in
with an old time of modification is not seen.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tree import absolute, filesystem

FORMAT = "corpusloom_tree"
SCHEMA = "path string, length bigint, modified timestamp"
_BATCH = 10_000
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])


@dataclass
class Part(InputPartition):
    """Files below ``folder`` (its own only, unless ``deep``), those whose name falls to ``share`` of ``shares``, modified in (after, until]."""

    folder: str
    deep: bool
    share: int = 0
    shares: int = 1
    after: int | None = None
    until: int | None = None


def _entries(fs: pafs.FileSystem, where: str) -> Iterator[tuple[str, bool, object]]:
    """Name, whether it is a folder, and something that tells length and time."""
    if fs.type_name == "local":
        with os.scandir(where) as found:
            for entry in found:
                folder = entry.is_dir(follow_symlinks=False)
                if folder or entry.is_file():
                    yield entry.name, folder, entry
    else:
        for info in fs.get_file_info(pafs.FileSelector(where, recursive=False)):
            if info.type in (pafs.FileType.Directory, pafs.FileType.File):
                yield info.base_name, info.type == pafs.FileType.Directory, info


def _measure(entry: object) -> tuple[int, int]:
    if isinstance(entry, pafs.FileInfo):
        return entry.size or 0, (entry.mtime_ns or 0) // 1000
    status = entry.stat()
    return status.st_size, status.st_mtime_ns // 1000


class _Tree:
    def __init__(self, options: dict):
        self.root = absolute(options["path"])
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.folders = int(options.get("folders", 256))
        self.entries_per_task = int(options.get("entries_per_task", 100_000))
        self.delay = int(float(options.get("delay_seconds", 2)) * 1e6)

    def _place(self, folder: str) -> tuple[pafs.FileSystem, str]:
        fs, base = filesystem(self.root)
        return fs, f"{base.rstrip('/')}/{folder}" if folder else base

    def _below(self, folder: str) -> Iterator[tuple[str, bool, object]]:
        fs, where = self._place(folder)
        for name, is_dir, entry in _entries(fs, where):
            if self.hidden or not name.startswith("."):
                yield f"{folder}/{name}" if folder else name, is_dir, entry

    def plan(self, after: int | None = None, until: int | None = None) -> list[Part]:
        fs, base = filesystem(self.root)
        kind = fs.get_file_info(base).type
        if kind == pafs.FileType.NotFound:
            raise FileNotFoundError(f"Directory not found: {self.root}")
        if kind != pafs.FileType.Directory:
            raise NotADirectoryError(f"Not a directory: {self.root}")
        parts, waiting = [], [""]
        while waiting and len(parts) + len(waiting) < self.folders:
            folder = waiting.pop(0)
            count = 0
            for path, is_dir, _ in self._below(folder):
                count += 1
                if is_dir:
                    waiting.append(path)
            shares = max(1, -(-count // self.entries_per_task))
            parts += [Part(folder, False, share, shares, after, until) for share in range(shares)]
        return parts + [Part(folder, True, 0, 1, after, until) for folder in waiting]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int]] = []
        waiting = [part.folder]
        while waiting:
            for path, is_dir, entry in self._below(waiting.pop()):
                if is_dir:
                    if part.deep:
                        waiting.append(path)
                    continue
                if part.shares > 1 and crc32(path.encode("utf-8", "surrogateescape")) % part.shares != part.share:
                    continue
                length, modified = _measure(entry)
                if (part.after is None or modified > part.after) and (part.until is None or modified <= part.until):
                    rows.append((path, length, modified))
                if len(rows) >= _BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def partitions(self) -> list[Part]:
        return self.tree.plan()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tree = _Tree(options)

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000 - self.tree.delay}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.tree.plan(start["until"], end["until"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(dict(self.options))


def tree_table(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The manifest of a tree as it is when the query runs."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(root)


def tree_stream(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The files of a tree as they arrive; see ``read_contents`` for what is in them."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(root)
