"""Incremental ingest of a landing zone.

The stream applies the same stateless functions as the batch job. Each micro-batch
replaces its own ``batch_id`` folder, so a batch repeated after a failure leaves no
copies. The binary file source passes over ``_names``, dot files and empty files; use
the batch listing where those matter.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ignore import decide
from ..operators.selection import file_kind, select_files
from ..operators.stats import measure
from ..sources.decode import lenient_text
from ..sources.rules import Rules
from ..sources.tree import absolute

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def landing_files(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """Stream of ``(path, length, content)``, paths relative to the landing zone."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    base = urlsplit(folder).path.rstrip("/") + "/" if ":/" in folder else absolute(folder).rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.locate(base, F.col("path")) + F.lit(len(base)))
    return raw.select(relative.alias("path"), "length", "content")


def landing_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of the rows of a parquet table, be it one file or a folder of files.

    The path is given as a pattern that only it matches, since a stream takes a single
    file no other way: the last letter or digit becomes a class of one.
    """
    path = path.rstrip("/")
    at = max(i for i, c in enumerate(path) if c.isalnum())
    return spark.readStream.schema(schema).parquet(f"{path[:at]}[{path[at]}]{path[at + 1 :]}")


def measured_files(
    files: DataFrame,
    max_size_kb: int | None = None,
    pattern_input: str | None = None,
    pattern_mode: str = "exclude",
    rules: Rules | None = None,
) -> DataFrame:
    """Selection, type and ignore decision and counts of file rows, alike in batch and stream.

    ``files`` has ``path``, ``length`` and ``content``. Only files that are kept get a ``text`` and counts.
    """
    chosen = select_files(files, max_size_kb, pattern_mode, pattern_input)
    decided = decide(chosen, rules or Rules(), file_kind(F.col("path"), F.col("content")))
    kept = F.col("decision").isin("kept", "override")
    return measure(decided.withColumn("text", F.when(kept, lenient_text(F.col("content")))).drop("content"))


def append_batches(
    stream: DataFrame, output: str, checkpoint: str, mode: str = "append", transform: Callable | None = None
) -> StreamingQuery:
    """Process what has arrived, one idempotent folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        result = transform(batch) if transform else batch
        result.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
