"""Rendering of last-commit metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def commit_date(committed_at: Column) -> Column:
    """ISO-8601 timestamp with offset, in the session time zone."""
    return F.date_format(committed_at, "yyyy-MM-dd'T'HH:mm:ssxxx")


def commit_line(message: Column, author: Column, date: Column) -> Column:
    """``Last Commit: ...`` with the day only."""
    return F.concat(
        F.lit("Last Commit: "), message, F.lit(" by "), author, F.lit(" on "), F.substring(date, 1, 10)
    )
