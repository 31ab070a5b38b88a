"""Upload requests as a stream: requests and uploads arrive apart, and the verdict falls when all is there or it is late.

A request announces how many files it has; its uploads come in any order, before or after it. Both streams are one, and each micro-batch is
reduced to a row for each request before it meets the open ones (:mod:`open_table`). The verdict is the batch's, see
``operators.jobs.request_verdicts``. It falls when the announced number has arrived, or when nothing came for ``patience`` behind the newest
event. What comes later opens the request again, and the verdict that falls next counts all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import validate_uploads
from .open_table import OpenTable, quiet_for

_REQUEST = "job_id string, announced bigint, n_files bigint, n_rejected bigint, first struct<pos:bigint,reason:string>, last_ts timestamp"


def _combine(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(
        F.max("announced").alias("announced"), F.sum("n_files").alias("n_files"), F.sum("n_rejected").alias("n_rejected"), F.min("first").alias("first"),
        F.max("last_ts").alias("last_ts"),
    )


def request_table(folder: str, patience: str = "1 hour") -> OpenTable:
    return OpenTable(folder, _REQUEST, _combine, lambda newest: F.coalesce(F.col("n_files") >= F.col("announced"), F.lit(False)) | quiet_for(newest, patience))


def request_events(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Both streams as one of summaries: ``requests`` has ``job_id``, ``n_files`` and ``ts``, ``uploads`` the columns of ``validate_uploads`` and ``ts``."""
    refused = F.col("reject_reason").isNotNull()
    announced = requests.select(
        "job_id", F.col("n_files").cast("bigint").alias("announced"), F.lit(0).cast("bigint").alias("n_files"), F.lit(0).cast("bigint").alias("n_rejected"),
        F.lit(None).cast("struct<pos:bigint,reason:string>").alias("first"), F.col("ts").cast("timestamp").alias("last_ts"),
    )
    arrived = validate_uploads(uploads).select(
        "job_id", F.lit(None).cast("bigint").alias("announced"), F.lit(1).cast("bigint").alias("n_files"), refused.cast("bigint").alias("n_rejected"),
        F.when(refused, F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("reject_reason").alias("reason"))).alias("first"),
        F.col("ts").cast("timestamp").alias("last_ts"),
    )
    return announced.unionByName(arrived)


def follow_requests(requests: DataFrame, uploads: DataFrame, folder: str, checkpoint: str, patience: str = "1 hour") -> StreamingQuery:
    """Keep the requests below ``folder`` current with the streams of requests and of uploads."""
    table = request_table(folder, patience)
    table.start(requests.sparkSession)
    return (
        request_events(requests, uploads)
        .writeStream.foreachBatch(lambda batch, batch_id: table.merge(_combine(batch), batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """``(job_id, n_files, n_rejected, error, complete)`` of the requests whose verdict has fallen; ``complete``: not for being late."""
    complete = F.coalesce(F.col("n_files") >= F.col("announced"), F.lit(False)).alias("complete")
    return request_table(folder).finished_rows(spark).select("job_id", "n_files", "n_rejected", F.col("first.reason").alias("error"), complete)


def open_requests(spark: SparkSession, folder: str) -> DataFrame:
    """``(job_id, announced, n_files, n_rejected)`` of the requests that are waited for."""
    return request_table(folder).open_rows(spark).select("job_id", "announced", "n_files", "n_rejected")
