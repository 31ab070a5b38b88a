"""Positions from 1 within a group, however large the group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def same_keys(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of columns with their prefixed namesakes."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def rank_rows(rows: DataFrame, group: list[str], order: list[str], alias: str = "pos") -> DataFrame:
    """Add ``alias``: the 1-based position within ``group`` by the ``order`` columns; rows that tie there are numbered in any order.

    The rows are range-partitioned by group and order, sorted inside the tasks, and staged. A row's number is its place among the
    task's rows of the group plus the rows of the group in earlier tasks, of which there is one count for each task and group. A
    group that holds most rows spreads over tasks as any other, and nothing but those counts is grouped.
    """
    keys = [*group, *order]
    sort = [F.col(k) for k in keys]
    # rows of one key would stay in one task; a number in the order the rows came breaks them apart
    marked = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = stage(marked.repartitionByRange(*sort, "_tie").sortWithinPartitions(*sort, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_task", F.shiftright("_at", 33))
    counts = ordered.groupBy("_task", *group).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    counts = counts.select(
        *[F.col(k).alias(f"_of_{k}") for k in ["_task", *group]], (F.col("_low") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_start")
    )
    numbered = ordered.join(counts, same_keys(["_task", *group], "_of_"))
    return numbered.select(*rows.columns, (F.col("_at") - F.col("_start") + 1).alias(alias))


def number_rows(rows: DataFrame, group: list[str], order: str, alias: str = "pos") -> DataFrame:
    """Add ``alias``: the 1-based position by the column ``order``, which must be unique within ``group``."""
    return rank_rows(rows, group, [order], alias)
