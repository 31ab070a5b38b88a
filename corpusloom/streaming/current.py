"""The current status of jobs while their results stream in.

Open jobs are one table, see :mod:`open_table`: a job ends when as many of its files have reported as it has, or when nothing came for
``idle`` behind the newest result seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import job_counts
from .open_table import OpenTable, quiet_for

_JOB = "job_id string, n_files bigint, n_errors bigint, last_ok bigint, last_ts timestamp, n_total bigint"


def _combine(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(
        F.sum("n_files").alias("n_files"), F.sum("n_errors").alias("n_errors"), F.max("last_ok").alias("last_ok"), F.max("last_ts").alias("last_ts"),
        F.max("n_total").alias("n_total"),
    )


def job_table(folder: str, idle: str = "1 hour") -> OpenTable:
    return OpenTable(folder, _JOB, _combine, lambda newest: F.coalesce(F.col("n_files") >= F.col("n_total"), F.lit(False)) | quiet_for(newest, idle))


def merge_batch(batch: DataFrame, batch_id: int, folder: str, idle: str, totals: DataFrame | None = None) -> None:
    """Merge file results (``job_id``, ``pos``, ``error``, ``ts``) into the table; ``totals`` has ``job_id`` and ``n_total``."""
    times = batch.groupBy("job_id").agg(F.max("ts").cast("timestamp").alias("last_ts"))
    arrived = job_counts(batch).join(times, "job_id")
    if totals is None:
        arrived = arrived.withColumn("n_total", F.lit(None).cast("bigint"))
    else:
        arrived = arrived.join(totals.select("job_id", "n_total"), "job_id", "left")
    job_table(folder, idle).merge(arrived, batch_id)


def follow_jobs(results: DataFrame, folder: str, checkpoint: str, idle: str = "1 hour", totals: DataFrame | None = None) -> StreamingQuery:
    """Keep the table below ``folder`` current with a stream of file results."""
    start_table(results.sparkSession, folder)
    return (
        results.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, folder, idle, totals))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_table(spark: SparkSession, folder: str) -> None:
    """The empty table, unless there is one."""
    job_table(folder).start(spark)


def _status(done: bool) -> Column:
    ended = F.when(F.col("n_errors") == 0, "completed").otherwise("completed_with_errors")
    return (ended if done else F.lit("processing")).alias("status")


def current_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every open job: ``processing``, with its counts and its progress where its number of files is known."""
    progress = F.lit(100.0) * F.col("last_ok") / F.col("n_total")
    return job_table(folder).open_rows(spark).select("*", _status(False), progress.alias("progress"))


def finished_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every job that ended and did not open again, as it ended last."""
    return job_table(folder).finished_rows(spark).select("*", _status(True))
