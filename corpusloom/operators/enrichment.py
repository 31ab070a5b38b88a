"""Last-commit metadata per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.commits import commit_date
from ..functions.text import strip


def newest_commits(commits: DataFrame, key: str = "path") -> DataFrame:
    """One row per key: its newest commit, ties broken by ``sha``.

    An aggregate rather than a window: each task reduces its own commits first, so a
    path with a long history costs one row per task in the shuffle.
    """
    newest = F.max_by(
        F.struct("message", "author", "committed_at"), F.struct("committed_at", "sha")
    )
    return commits.groupBy(key).agg(newest.alias("newest")).select(
        key,
        F.struct(
            strip(F.col("newest.message")).alias("message"),
            F.col("newest.author").alias("author"),
            commit_date(F.col("newest.committed_at")).alias("date"),
        ).alias("last_commit"),
    )


def with_last_commit(files: DataFrame, commits: DataFrame, key: str = "path") -> DataFrame:
    """Add ``last_commit`` (``struct<message, author, date>``), NULL without any commit.

    Both sides hold a key once, so the join cannot be skewed.
    """
    return files.join(newest_commits(commits, key), key, "left")
