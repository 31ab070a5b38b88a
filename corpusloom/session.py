"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "corpusloom", **conf: str) -> SparkSession:
    """A session with the settings the package expects; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    A private temporary folder stands in only where the setting is missing and the
    whole session runs on this machine (tests); a cluster without it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    For results used several times: later passes read only the columns they need.
    """
    folder = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def task_count(spark: SparkSession, total_bytes: int | None, bytes_per_task: int = 256 << 20) -> int:
    """Tasks that keep each near ``bytes_per_task``; never fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-(total_bytes or 0) // bytes_per_task))
