"""Running status of jobs while their file results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import job_counts
from .ingest import append_batches


def running_counts(results: DataFrame) -> DataFrame:
    """Per-job counts so far; the only state is one small row per job."""
    return job_counts(results)


def track_jobs(results: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write the changed jobs of every micro-batch.

    The number of state partitions is that of ``spark.sql.shuffle.partitions`` at the
    first start and stays; it should suit the number of jobs, not of files.
    """
    return append_batches(running_counts(results), output, checkpoint, mode="update")


def latest_status(spark: SparkSession, output: str, total: DataFrame | None = None) -> DataFrame:
    """``(job_id, n_files, n_errors, last_ok, status[, progress])`` as last reported.

    ``total`` (``job_id``, ``n_total``) tells how many files a job has: it is
    ``processing`` until all of them have reported.
    """
    seen = spark.read.parquet(output)
    latest = (
        seen.groupBy("job_id")
        .agg(F.max_by(F.struct("n_files", "n_errors", "last_ok"), "batch_id").alias("s"))
        .select("job_id", "s.*")
    )
    done = F.when(F.col("n_errors") == 0, "completed").otherwise("completed_with_errors")
    if total is None:
        return latest.withColumn("status", done)
    joined = latest.join(total, "job_id")
    return joined.withColumn(
        "status", F.when(F.col("n_files") < F.col("n_total"), "processing").otherwise(done)
    ).withColumn("progress", F.lit(100.0) * F.col("last_ok") / F.col("n_total"))
