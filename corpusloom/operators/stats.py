"""Corpus counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, line_count, token_count

COUNTERS = [
    "processed_files", "skipped_files", "binary_files", "error_files", "total_chars", "total_lines", "total_tokens",
]


def measure(files: DataFrame, text: str = "text") -> DataFrame:
    """Add ``chars``, ``lines`` and ``tokens``; NULL text (not decodable) measures NULL."""
    column = F.col(text)
    return files.withColumns(
        {"chars": char_count(column), "lines": line_count(column), "tokens": token_count(column)}
    )


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def export_stats(decided: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """The seven export counters over decided files, overall or per group.

    Needs ``decision`` (see ``ignore.decide``) and the decoded text. Binary files are
    counted apart, ignored ones not at all, undecodable ones as skipped, unreadable ones (decision ``error``) as errors.
    """
    kept = F.col("decision").isin("kept", "override")
    column = F.when(kept, F.col(text))
    failed = F.count_if(F.col("decision") == "error")
    processed = column.isNotNull()
    return decided.groupBy(*(by or [])).agg(
        F.count_if(processed).alias("processed_files"),
        F.count_if(kept & ~processed).alias("skipped_files"),
        F.count_if(F.col("decision") == "binary").alias("binary_files"),
        failed.alias("error_files"),
        _total(char_count(column)).alias("total_chars"),
        _total(line_count(column)).alias("total_lines"),
        _total(token_count(column)).alias("total_tokens"),
    )


def count_rows(rows: DataFrame, by: list[str], alias: str = "n_rows") -> DataFrame:
    """Rows per group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias(alias))
