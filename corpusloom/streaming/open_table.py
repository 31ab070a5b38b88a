"""A table of what is still open in a stream, which ends what has ended.

Every micro-batch is reduced to a row for each key, with an aggregate that Spark combines inside the tasks, and merged into the rows of the
keys that are open. A key that is done leaves for the finished ones. So what a batch reads and rewrites is bounded by what is open, not by
the history, and a key that most rows belong to is one row from the first exchange on. If a finished key is heard of again it opens with
all that it had: nothing is lost, however late.

A batch writes its own version of the open rows and its own folder of finished ones, and then its mark with the newest time seen. A batch
that is repeated after a failure starts from the version before it and replaces what it wrote. Versions older than the last two are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove

_FIRST = -1


@dataclass(frozen=True)
class OpenTable:
    """Summaries of ``schema`` below ``folder``, one for each ``key``; they have a ``last_ts``.

    ``combine`` makes one row of several of a key; ``done`` says, given the newest time seen, which rows have ended.
    """

    folder: str
    schema: str
    combine: Callable[[DataFrame], DataFrame]
    done: Callable[[datetime | None], Column]
    key: str = "job_id"

    def _open(self, version: int) -> str:
        return f"{self.folder}/open/version={version}"

    def start(self, spark: SparkSession) -> None:
        """The empty table, unless there is one."""
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self._open(_FIRST))
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.folder}/finished/version={_FIRST}")
        spark.createDataFrame([(None,)], "newest timestamp").write.mode("ignore").parquet(f"{self.folder}/marks/version={_FIRST}")

    def _mark(self, spark: SparkSession, below: int | None = None) -> tuple[int, datetime | None]:
        """The last version, and the newest time of any."""
        marks = spark.read.schema("newest timestamp, version bigint").parquet(f"{self.folder}/marks")  # a row a version
        if below is not None:
            marks = marks.where(F.col("version") < below)
        last = marks.agg(F.max("version").alias("version"), F.max("newest").alias("newest")).first()
        return last.version, last.newest

    def _all_finished(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, version bigint").parquet(f"{self.folder}/finished")

    def merge(self, arrived: DataFrame, batch_id: int) -> None:
        """Merge the summaries of a micro-batch, one row for each key."""
        spark = arrived.sparkSession
        version, newest = self._mark(spark, batch_id)
        columns = spark.createDataFrame([], self.schema).columns
        rest = [c for c in columns if c != self.key]
        arrived = arrived.select(*columns).persist()
        try:
            seen = arrived.agg(F.max("last_ts")).first()[0]
            newest = max((t for t in (newest, seen) if t is not None), default=None)
            known = spark.read.schema(self.schema).parquet(self._open(version))
            # finished keys that are heard of again, as they were before this batch, unless they are open
            back = self._all_finished(spark).where(F.col("version") < batch_id).join(arrived.select(self.key), self.key, "left_semi")
            back = back.join(known.select(self.key), self.key, "left_anti").groupBy(self.key).agg(F.max_by(F.struct(*rest), "version").alias("s"))
            merged = self.combine(known.unionByName(back.select(self.key, "s.*")).unionByName(arrived)).select(*columns)
            merged = merged.withColumn("_done", F.coalesce(self.done(newest), F.lit(False))).persist()
            try:
                merged.where(~F.col("_done")).drop("_done").write.mode("overwrite").parquet(self._open(batch_id))
                merged.where("_done").drop("_done").write.mode("overwrite").parquet(f"{self.folder}/finished/version={batch_id}")
            finally:
                merged.unpersist()
        finally:
            arrived.unpersist()
        spark.createDataFrame([(newest,)], "newest timestamp").write.mode("overwrite").parquet(f"{self.folder}/marks/version={batch_id}")
        for old in (batch_id - 2, batch_id - 3):  # the one before stays, as this batch may be repeated
            if old > _FIRST:
                remove(spark, self._open(old))

    def open_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self._open(self._mark(spark)[0]))

    def finished_rows(self, spark: SparkSession) -> DataFrame:
        """Every key that ended and did not open again, as it ended last."""
        rows = self._all_finished(spark).where(F.col("version") <= self._mark(spark)[0])
        rest = [c for c in rows.columns if c not in (self.key, "version")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(self.key, "s.*")
        return last.join(self.open_rows(spark).select(self.key), self.key, "left_anti")


def quiet_for(newest: datetime | None, time: str) -> Column:
    """Whether nothing came since ``time`` before the newest."""
    return F.lit(False) if newest is None else F.col("last_ts") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {time}")
