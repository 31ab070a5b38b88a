"""JSON export: one entry per file, as JSON lines or as one nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_export import sorted_lines


_COMMIT = "struct<message:string,author:string,date:string>"


def json_entries(decided: DataFrame, repository: str | Column) -> DataFrame:
    """``(repository, path, content, last_commit)`` of the exported files; ``repository`` is a name or a column of ``decided``."""
    readable = decided.where(F.col("decision").isin("kept", "override") & F.col("text").isNotNull())
    commit = F.col("last_commit") if "last_commit" in decided.columns else F.lit(None).cast(_COMMIT)
    return readable.select(
        (repository if isinstance(repository, Column) else F.lit(repository)).alias("repository"), "path", F.col("text").alias("content"), commit.alias("last_commit")
    )


def write_json_lines(entries: DataFrame, path: str) -> None:
    """One entry per line, partitioned by repository; NULL commits are written out."""
    entries.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("repository").json(path)


def json_document(entries: DataFrame, repository: str) -> DataFrame:
    """``(section, sort_key, line)``: in order, the lines are one nested JSON document.

    The separating comma leads each entry but one of the smallest path, found by a one-row
    aggregate, so no task has to gather the entries. Rows are told apart by their place in
    ``entries``, which should be a written table or a plain scan.
    """
    spark = entries.sparkSession
    entries = entries.withColumn("_row", F.monotonically_increasing_id())
    first = entries.agg(F.min(F.struct("path", "_row")).alias("_first"))
    entry = F.to_json(F.struct("path", "content", "last_commit"), {"ignoreNullFields": "false"})
    leads = (F.col("path") == F.col("_first.path")) & (F.col("_row") == F.col("_first._row"))
    first_path = F.broadcast(first.withColumn("_path", F.col("_first.path")))
    body = entries.join(first_path, F.col("path") == F.col("_path"), "left").select(
        F.when(leads, 1).otherwise(2).alias("section"),
        F.col("path").alias("sort_key"),
        F.concat(F.when(leads, "").otherwise(","), entry).alias("line"),
    )
    name = F.to_json(F.struct(F.lit(repository).alias("repository")))
    opening = F.concat(F.left(name, F.length(name) - 1), F.lit(', "files": ['))
    frame = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("section"), F.lit("").alias("sort_key"), opening.alias("line")),
                F.struct(F.lit(3).alias("section"), F.lit("").alias("sort_key"), F.lit("]}").alias("line")),
            )
        ).alias("row")
    )
    return frame.select("row.*").unionByName(body)


def write_json_document(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the nested document; part files in name order, joined, parse as one value."""
    ordered = sorted_lines(lines, ["section", "sort_key"], partitions)
    ordered.select("line").write.mode("overwrite").text(path)
