"""Ignore decisions for many repositories in one job, each with rules of its own.

The default patterns are constants and compile into predicates. A repository's own patterns are gathered into one row: beginnings,
endings, whole paths, and one alternation of regular expressions for the rest. Files meet that row by their repository, a join whose
side of rules holds each repository once, so Spark broadcasts it while it is small and splits a hot repository's files where it is
not. Repositories with more than ``ROW_RULES`` patterns do not fit a row; their files are matched by the anchor index of
:mod:`rule_table`, with the same decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import fnmatch_any, fnmatch_regex, fnmatch_shortcut
from ..session import stage
from ..sources.rules import DEFAULT_PATTERNS
from .rule_table import match_rules

#: Own patterns of a repository that are held in one row.
ROW_RULES = 500
_FORMS = ("equals", "starts", "ends")


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known = [fnmatch_shortcut(pattern) or ("regex", fnmatch_regex(pattern)) for pattern in batch["pattern"]]
        yield batch.assign(form=[form for form, _ in known], value=[value for _, value in known])


def compiled_rules(rules: DataFrame, by: str = "repository") -> DataFrame:
    """One row for each repository: for either kind an array of each form of patterns, and one regular expression.

    ``rules`` has ``by``, ``kind`` and ``pattern``, each rule once.
    """
    kind = next(f.dataType.simpleString() for f in rules.schema if f.name == by)
    formed = rules.select(by, "kind", "pattern").mapInPandas(_forms, f"`{by}` {kind}, kind string, pattern string, form string, value string")
    columns = []
    for rule in ("ignore", "override"):
        own = F.col("kind") == rule
        columns += [F.collect_list(F.when(own & (F.col("form") == form), F.col("value"))).alias(f"{rule}_{form}") for form in _FORMS]
        regexes = F.array_sort(F.collect_list(F.when(own & (F.col("form") == "regex"), F.col("value"))))
        columns.append(F.when(F.size(regexes) > 0, F.array_join(regexes, "|")).alias(f"{rule}_regex"))
    return formed.groupBy(by).agg(*columns)


def _any_own(path: Column, rule: str) -> Column:
    """Whether a path matches one of its repository's own patterns; false where there are none."""
    tests = (
        F.array_contains(f"{rule}_equals", path)
        | F.exists(f"{rule}_starts", lambda text: F.startswith(path, text))
        | F.exists(f"{rule}_ends", lambda text: F.endswith(path, text))
        | F.coalesce(F.rlike(path, F.col(f"{rule}_regex")), F.lit(False))
    )
    return F.coalesce(tests, F.lit(False))


def decide_repositories(
    files: DataFrame, rules: DataFrame, kind: Column, by: str = "repository", path: str = "path", defaults: bool = True, row_rules: int = ROW_RULES
) -> DataFrame:
    """Add ``decision`` (see ``ignore.decide``) by the rules of each file's own repository.

    ``rules`` has ``by``, ``kind`` and ``pattern`` (see ``parse_rules`` with ``by``). A repository without rules, or null, has the
    defaults alone. An override beats every ignore pattern, wherever either comes from.
    """
    rules = stage(rules.where(F.col(by).isNotNull() & F.col("pattern").isNotNull()).select(by, "kind", "pattern").distinct())
    sizes = rules.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    long = stage(sizes.where(F.col("n") > row_rules).select(by))  # the repositories with long lists
    column, typed = F.col(path), files.withColumn("_kind", kind)
    default = fnmatch_any(column, DEFAULT_PATTERNS) if defaults else F.lit(False)

    def decided(frame: DataFrame, ignored: Column, overridden: Column) -> DataFrame:
        decision = F.when(F.col("_kind") == "binary", "binary").when(overridden, "override").when(default | ignored, "ignored").otherwise("kept")
        return frame.withColumn("decision", decision).select(*files.columns, "decision")

    rows = compiled_rules(rules.join(long, by, "left_anti"), by)
    has_long = not long.isEmpty()
    short_files = typed.join(long, by, "left_anti") if has_long else typed
    result = decided(short_files.join(rows, by, "left"), _any_own(column, "ignore"), _any_own(column, "override"))
    if has_long:
        matched = match_rules(typed.join(long, by, "left_semi"), rules.join(long, by, "left_semi"), [by], path)
        result = result.unionByName(decided(matched, F.col("ignore_rules") > 0, F.col("override_rules") > 0))
    return result
