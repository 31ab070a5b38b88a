"""Exports of many repositories in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrichment import newest_commits
from ..operators.repositories import decide_repositories
from ..operators.selection import file_kind, select_files
from ..operators.stats import export_stats
from ..session import stage, task_count
from ..sinks.json_export import json_entries, write_json_lines
from ..sinks.text_export import text_exports, write_text_exports
from ..sources.decode import strict_text
from ..sources.rules import parse_rules
from .export import ExportOptions


def decided_repositories(
    files: DataFrame, rule_lines: DataFrame, options: ExportOptions = ExportOptions(), commits: DataFrame | None = None, by: str = "repository"
) -> DataFrame:
    """Files with ``decision``, ``text`` and, given commits, ``last_commit``, by the rules of their own repositories.

    ``files`` has ``by``, ``path``, ``length`` and ``content``, ``rule_lines`` ``by`` and ``value`` (the lines of each repository's rule file);
    ``commits`` has ``by`` and the columns of ``operators.enrichment``. Size, hidden and glob filters of ``options`` hold for all.
    """
    chosen = select_files(files, options.max_size_kb, options.pattern_mode, options.pattern_input)
    rules = parse_rules(rule_lines.where(F.col(by).isNotNull()), by=[by])
    decided = decide_repositories(chosen, rules, file_kind(F.col("path"), F.col("content")), by)
    kept = F.col("decision").isin("kept", "override")
    result = decided.withColumn("text", F.when(kept, strict_text(F.col("content")))).drop("content")
    if commits is None:
        return result
    keyed = commits.withColumn("_file", F.struct(by, "path"))
    newest = newest_commits(keyed, "_file").select(F.col(f"_file.{by}").alias(by), F.col("_file.path").alias("path"), "last_commit")
    return result.join(newest, [by, "path"], "left")


def export_repositories(
    files: DataFrame,
    rule_lines: DataFrame,
    output: str,
    options: ExportOptions = ExportOptions(),
    fmt: str = "text",
    commits: DataFrame | None = None,
    by: str = "repository",
) -> DataFrame:
    """Export every repository below ``output``, a folder each, and return their statistics (lazy), a row each.

    ``fmt`` is ``text`` (the consolidated document) or ``jsonl``. The decision is staged once; everything else reads what it needs of it.
    """
    if fmt not in ("text", "jsonl"):
        raise ValueError(f"Unknown format: {fmt}")
    decided = stage(decided_repositories(files, rule_lines, options, commits, by))
    if fmt == "text":
        partitions = task_count(files.sparkSession, decided.agg(F.sum("length")).first()[0])
        write_text_exports(text_exports(decided, by, commits is not None), output, by, partitions)
    else:
        write_json_lines(json_entries(decided, F.col(by)), output)
    return export_stats(decided, [by])
