"""File trees: a distributed listing and a distributed read.

Spark's own file sources leave out ``_names``, dot files and empty files, all of which
belong to a corpus. So the tree becomes a manifest table first, is filtered as any
other table, and only the surviving paths are opened, on the executors.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import batched

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..session import cut_lineage, task_count

_ENTRY = "path string, is_dir boolean, length bigint, modified timestamp"
_LIST_BATCH = 10_000
_READ_BATCH_BYTES = 32 << 20
_OPEN_FILES = 16
_ATTEMPTS, _PAUSE = 4, 0.25  # seconds before the second attempt, doubled each time


def absolute(root: str) -> str:
    """A URI as it is, a plain path made absolute: executors have other working folders."""
    return root if "://" in root else os.path.abspath(root)


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind a URI or an absolute (mounted) path."""
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _local_entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Entries of a mounted folder, one at a time; links to folders are not followed."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield entry.name, True, 0, 0
            elif entry.is_file():
                status = entry.stat()
                yield entry.name, False, status.st_size, status.st_mtime_ns // 1000


def _remote_entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    for info in fs.get_file_info(pafs.FileSelector(folder, recursive=False)):
        if info.type == pafs.FileType.Directory:
            yield info.base_name, True, 0, 0
        elif info.type == pafs.FileType.File:
            yield info.base_name, False, info.size, (info.mtime_ns or 0) // 1000


def _list_one(root: str, folder: str, hidden: bool) -> Iterator[tuple]:
    fs, base = filesystem(root)
    where = f"{base.rstrip('/')}/{folder}" if folder else base
    entries = _local_entries(where) if fs.type_name == "local" else _remote_entries(fs, where)
    for name, is_dir, length, modified in entries:
        if hidden or not name.startswith("."):
            yield f"{folder}/{name}" if folder else name, is_dir, length, modified


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "is_dir", "length", "modified"])
    frame["modified"] = frame["modified"].astype("datetime64[us]")
    return frame


def list_tree(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """Manifest ``(path, length, modified)`` of every regular file below ``root``.

    ``root`` is a URI or absolute path that every executor can reach; paths come back
    relative to it. The tree is walked one level per job, all directories of a level in
    parallel; the driver loops over the depth only and never holds paths. ``hidden``
    keeps dot names (otherwise their whole subtree is skipped, unread).
    """
    root = absolute(root)
    fs, base = filesystem(root)
    kind = fs.get_file_info(base).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(f"Directory not found: {root}")
    if kind != pafs.FileType.Directory:
        raise NotADirectoryError(f"Not a directory: {root}")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                for rows in batched(_list_one(root, folder, hidden), _LIST_BATCH):
                    yield _frame(list(rows))

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    while True:
        level = cut_lineage(frontier.mapInPandas(walk, _ENTRY))
        levels.append(level.where(~F.col("is_dir")).select("path", "length", "modified"))
        folders = level.where("is_dir").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        frontier = folders.repartition(width)


Opener = Callable[[str], tuple[pafs.FileSystem, str]]


def _fetch(fs: pafs.FileSystem, file: str, start: int | None, size: int | None) -> tuple[bytes | None, str | None]:
    """A whole file, or ``size`` bytes of it from ``start``, and what went wrong; both None for a file that is gone."""
    for attempt in range(_ATTEMPTS):
        try:
            if start is None:
                with fs.open_input_stream(file) as stream:
                    return stream.read(), None
            with fs.open_input_file(file) as handle:
                handle.seek(start)
                return handle.read(size), None
        except FileNotFoundError:
            return None, None
        except OSError as error:
            problem = str(error)
            time.sleep(_PAUSE * 2**attempt)
    return None, problem


def _read(rows: DataFrame, root: str, width: int, column: str, opener: Opener) -> DataFrame:
    """Add ``column`` and ``read_error``; rows with ``start`` and ``size`` ask for that range of their file."""
    root, ranged = absolute(root), "start" in rows.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opener(root)

        def fetch(asked: tuple[str, int | None, int | None]) -> tuple[bytes | None, str | None]:
            path, start, size = asked
            return _fetch(fs, f"{base.rstrip('/')}/{path}", start, size)

        def joined(batch: pa.RecordBatch, first: int, found: list[tuple[bytes | None, str | None]]) -> pa.RecordBatch:
            part = batch.slice(first, len(found)).append_column(column, pa.array([c for c, _ in found], pa.binary()))
            return part.append_column("read_error", pa.array([e for _, e in found], pa.string()))

        with ThreadPoolExecutor(_OPEN_FILES) as pool:
            for batch in batches:
                paths = batch.column("path").to_pylist()
                nothing = [None] * len(paths)
                starts, sizes = (batch.column(c).to_pylist() if ranged else nothing for c in ("start", "size"))
                first, contents, held = 0, [], 0
                for asked in batched(zip(paths, starts, sizes, strict=True), _OPEN_FILES):
                    # ranges may be large: no more of them at once than a batch may hold
                    step = max(1, _READ_BATCH_BYTES // max(1, max(s or 1 for _, _, s in asked)))
                    for few in batched(asked, min(_OPEN_FILES, step)):
                        found = list(pool.map(fetch, few))
                        contents += found
                        held += sum(len(content or b"") for content, _ in found)
                        if held >= _READ_BATCH_BYTES:
                            yield joined(batch, first, contents)
                            first, contents, held = first + len(contents), [], 0
                if contents:
                    yield joined(batch, first, contents)

    schema = StructType([*rows.schema.fields, StructField(column, BinaryType()), StructField("read_error", StringType())])
    return rows.repartition(width).mapInArrow(read, schema)


def read_contents(
    manifest: DataFrame, root: str, partitions: int | None = None, bytes_per_task: int = 256 << 20, opener: Opener = filesystem
) -> DataFrame:
    """Open the manifest's files on the executors and add their ``content``.

    Filter and enrich the manifest first: the optimizer cannot move a filter below the
    read, and a join before it does not have to move the contents. A file that is gone has
    NULL content; one that still cannot be read after a few attempts has NULL content and says
    why in ``read_error``. Each task keeps a few files open at a time, since small files
    cost latency rather than bandwidth. The rows are spread evenly over ``partitions``
    tasks, by default as many as keep a task near ``bytes_per_task``, and leave in
    batches of bounded size. ``opener`` finds the file system of a root, on the executors.
    """
    spark = manifest.sparkSession
    width = partitions or task_count(spark, manifest.agg(F.sum("length")).first()[0], bytes_per_task)
    return _read(manifest, root, width, "content", opener)


def read_heads(manifest: DataFrame, root: str, size: int, opener: Opener = filesystem, files_per_task: int = 20_000) -> DataFrame:
    """Add ``head``, the first ``size`` bytes of each file, and ``read_error``; no more is read."""
    width = task_count(manifest.sparkSession, manifest.count(), files_per_task)
    asked = manifest.withColumns({"start": F.lit(0).cast("bigint"), "size": F.lit(size).cast("bigint")})
    return _read(asked, root, width, "head", opener).drop("start", "size")


def read_segments(
    manifest: DataFrame, root: str, segment_bytes: int = 32 << 20, bytes_per_task: int = 256 << 20, opener: Opener = filesystem
) -> DataFrame:
    """Every file as byte ranges: a row for each, with its number ``segment`` from 0, ``content`` and ``read_error``.

    Ranges are planned from the manifest's lengths, so a file of any size is read by many tasks and is never one value. An empty file
    is one empty range. See ``operators.segments`` for measures of files in ranges.
    """
    last = F.greatest(F.ceil(F.col("length") / segment_bytes).cast("bigint") - 1, F.lit(0).cast("bigint"))
    ranges = manifest.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("segment") * segment_bytes
    ranges = ranges.withColumns({"start": start, "size": F.greatest(F.least(F.col("length") - start, F.lit(segment_bytes)), F.lit(0)).cast("bigint")})
    width = task_count(manifest.sparkSession, ranges.agg(F.sum("size")).first()[0], bytes_per_task)
    return _read(ranges, root, width, "content", opener).drop("start", "size")
