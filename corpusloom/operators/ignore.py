"""Ignore decisions by rule patterns.

The rules of one tree are a parameter, so both pattern sets compile into a handful of
predicates evaluated in the scan stage: no join, no shuffle, whatever the file count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import fnmatch_any
from ..sources.rules import Rules


def rule_match(path: Column, rules: Rules) -> tuple[Column, Column]:
    """(matches an ignore pattern, matches an override pattern)."""
    return fnmatch_any(path, rules.ignore), fnmatch_any(path, rules.override)


def is_ignored(path: Column, rules: Rules) -> Column:
    """An override beats every ignore pattern, wherever it stands."""
    ignored, overridden = rule_match(path, rules)
    return ~overridden & ignored


def decide(files: DataFrame, rules: Rules, kind: Column, path: str = "path") -> DataFrame:
    """Add ``decision``: ``binary``, ``override``, ``ignored`` or ``kept``, first match wins."""
    ignored, overridden = rule_match(F.col(path), rules)
    return files.withColumn(
        "decision",
        F.when(kind == "binary", "binary")
        .when(overridden, "override")
        .when(ignored, "ignored")
        .otherwise("kept"),
    )


def keep(files: DataFrame, rules: Rules, path: str = "path") -> DataFrame:
    """Files that no rule drops."""
    return files.where(~is_ignored(F.col(path), rules))


def drop(files: DataFrame, rules: Rules, path: str = "path") -> DataFrame:
    """The complement of :func:`keep`."""
    return files.where(is_ignored(F.col(path), rules))
