"""One file for each output, written by a committing data source.

Every task writes its files under a temporary folder of the write; only when all tasks are done are they given their names, and
whatever failed or repeated tasks left is removed with that folder. So an output is there as a whole or not at all, there is no folder
for each document, and a table of many outputs costs a rename each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.tree import absolute, filesystem

FORMAT = "corpusloom_files"
_NAME, _TEXT, _END = "name", "text", b"\n"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: temporary place and final name."""

    files: list[tuple[str, str]]


def safe_name(name: str) -> str:
    """An output's path below the folder; names that would leave it are refused."""
    parts = [part for part in name.split("/") if part not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a file below the folder: {name!r}")
    return "/".join(parts)


class FilesWriter(DataSourceArrowWriter):
    """Rows ``(name, text)``, those of a name in a row: lines of the file ``name``."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.temporary = f"_writing-{uuid.uuid4()}"

    def _base(self):
        fs, base = filesystem(self.root)
        return fs, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = self._base()
        context = TaskContext.get()
        folder = f"{base}/{self.temporary}/{context.partitionId()}-{context.taskAttemptId()}"
        files: list[tuple[str, str]] = []
        current, stream = None, None
        for batch in iterator:
            for name, text in zip(batch.column(_NAME).to_pylist(), batch.column(_TEXT).to_pylist(), strict=True):
                if name != current:
                    if stream is not None:
                        stream.close()
                    if not files:
                        fs.create_dir(folder, recursive=True)
                    place = f"{folder}/{len(files)}"
                    current, stream = name, fs.open_output_stream(place)
                    files.append((place, safe_name(name)))
                stream.write((text or "").encode() + _END)
        if stream is not None:
            stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._base()
        fs.create_dir(base, recursive=True)
        folders = {base}
        for place, name in (file for message in messages if message for file in message.files):
            target = f"{base}/{name}"
            folder = target.rsplit("/", 1)[0]
            if folder not in folders:
                fs.create_dir(folder, recursive=True)
                folders.add(folder)
            fs.move(place, target)
        self._clear(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._base())

    def _clear(self, fs, base: str) -> None:
        try:
            fs.delete_dir(f"{base}/{self.temporary}")
        except FileNotFoundError:
            pass


class FilesSource(DataSource):
    """``df.write.format("corpusloom_files").save(folder)`` of rows ``(name, text)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{_NAME} string, {_TEXT} string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(
    lines: DataFrame, name: str, order: list[str], path: str, text: str = "text", partitions: int | None = None
) -> None:
    """Write each output as one file below ``path``: the lines of its ``name`` in ``order``, each with its end.

    A file is written by one task as a stream, so its size costs time there but no memory. Existing files of the same name are
    replaced, others stay. Names may have folders; null names are left out.
    """
    lines.sparkSession.dataSource.register(FilesSource)
    named = lines.where(F.col(name).isNotNull())
    dealt = named.repartition(partitions, name) if partitions else named.repartition(name)
    rows = dealt.sortWithinPartitions(name, *order).select(F.col(name).alias(_NAME), F.col(text).alias(_TEXT))
    rows.write.format(FORMAT).mode("append").option("path", absolute(path)).save()
