"""From a table of files to an export: select, classify, decode, enrich, count, write."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrichment import with_last_commit
from ..operators.ignore import decide, is_ignored
from ..operators.selection import SNIFF_BYTES, file_kind, kind_by_name, select_files, sniff_kind, subdirectory
from ..operators.stats import export_stats
from ..session import stage, task_count
from ..sinks.json_export import json_document, json_entries, write_json_document, write_json_lines
from ..sinks.text_export import text_export, write_text_export
from ..sources.decode import strict_text
from ..sources.rules import Rules, load_rules
from ..sources.tree import Opener, absolute, filesystem, list_tree, read_contents, read_heads


@dataclass(frozen=True)
class ExportOptions:
    """What to export.

    ``repository`` defaults to the name of the exported folder, ``rules`` to the built-in
    patterns and, for a tree, those of the ``.gitignore`` in that folder.
    """

    repository: str | None = None
    subdir: str | None = None
    max_size_kb: int | None = None
    pattern_mode: str = "exclude"
    pattern_input: str | None = None
    rules: Rules | None = None


def scoped(files: DataFrame, options: ExportOptions) -> DataFrame:
    """Files in the subdirectory that pass the hidden, size and glob filters."""
    inside = subdirectory(files, options.subdir)
    return select_files(inside, options.max_size_kb, options.pattern_mode, options.pattern_input)


def decided_files(files: DataFrame, options: ExportOptions, commits: DataFrame | None = None) -> DataFrame:
    """Files with ``decision``, ``text`` and, given commits, ``last_commit``.

    ``files`` has ``path``, ``length`` and ``content``; a file with a ``read_error`` is decided as ``error``.
    """
    chosen = scoped(files, options)
    kind = file_kind(F.col("path"), F.col("content"))
    classified = decide(chosen, options.rules or Rules(), kind)
    if "read_error" in files.columns:
        failed = F.col("read_error").isNotNull()
        classified = classified.withColumn("decision", F.when(failed, "error").otherwise(F.col("decision")))
    kept = F.col("decision").isin("kept", "override")
    result = classified.withColumn("text", F.when(kept, strict_text(F.col("content")))).drop("content")
    return with_last_commit(result, commits) if commits is not None else result


def export_root(root: str, options: ExportOptions) -> str:
    """The folder the export starts from, as a URI or an absolute path."""
    base = absolute(root).rstrip("/")
    return f"{base}/{options.subdir.strip('/')}" if options.subdir else base


def needs_content(path: Column, rules: Rules) -> Column:
    """False where the name alone settles that a file is binary, or text but ignored."""
    kind = kind_by_name(path)
    settled = (kind == "binary") | ((kind == "text") & is_ignored(path, rules))
    return ~F.coalesce(settled, F.lit(False))


def tree_files(
    spark: SparkSession, root: str, options: ExportOptions, commits: DataFrame | None = None, opener: Opener = filesystem
) -> DataFrame:
    """Files of a directory tree; only as much of them is read as matters.

    Commits join the manifest, before the contents are read. Files whose name settles nothing are sniffed: their first
    ``SNIFF_BYTES`` are read, and the whole file only if those are text that no rule drops and there is more of it. So a binary file
    without a telling name costs that many bytes, whatever its size.
    """
    base = export_root(root, options)
    rules = options.rules or Rules()
    manifest = scoped(list_tree(spark, base), replace(options, subdir=None))
    tasks = task_count(spark, manifest.agg(F.sum("length")).first()[0])
    if commits is not None:
        manifest = with_last_commit(manifest, commits)
    path = F.col("path")
    opened, named = needs_content(path, rules), kind_by_name(path).isNotNull()
    no_error = F.lit(None).cast("string")
    closed = manifest.where(~opened).withColumns({"content": F.lit(None).cast("binary"), "read_error": no_error})
    heads = stage(read_heads(manifest.where(opened & ~named), base, SNIFF_BYTES, opener))
    goes_on = (sniff_kind(F.col("head")) == "text") & ~is_ignored(path, rules) & (F.col("length") > F.octet_length("head"))
    goes_on = F.coalesce(goes_on, F.lit(False))
    sniffed = heads.where(~goes_on).withColumnRenamed("head", "content").select(*manifest.columns, "content", "read_error")
    whole = manifest.where(opened & named).unionByName(heads.where(goes_on).select(*manifest.columns))
    return read_contents(whole, base, tasks, opener=opener).unionByName(sniffed).unionByName(closed)


def export_tree(
    spark: SparkSession,
    root: str,
    output: str,
    options: ExportOptions = ExportOptions(),
    fmt: str = "text",
    commits: DataFrame | None = None,
) -> DataFrame:
    """Export a directory tree and return its one-row statistics (lazy).

    ``fmt`` is ``text``, ``json`` (one nested document) or ``jsonl``. The files are
    opened once; tree, blocks and counters then work on the staged table.
    """
    base = export_root(root, options)
    options = replace(options, rules=options.rules or load_rules(f"{base}/.gitignore"))
    files = tree_files(spark, root, options, commits)
    decided = stage(decided_files(files, replace(options, subdir=None)))
    repository = options.repository or base.rsplit("/", 1)[-1] or "local-export"
    partitions = task_count(spark, decided.agg(F.sum("length")).first()[0])
    write_export(decided, output, repository, fmt, commits is not None, base, partitions)
    return export_stats(decided)


def write_export(
    decided: DataFrame,
    output: str,
    repository: str,
    fmt: str = "text",
    with_commits: bool = False,
    root: str | None = None,
    partitions: int | None = None,
) -> None:
    """Write decided files in the chosen format."""
    if fmt == "text":
        blocks = text_export(decided, repository, with_commits, root)
        write_text_export(blocks, output, partitions)
    elif fmt == "json":
        write_json_document(json_document(json_entries(decided, repository), repository), output, partitions)
    elif fmt == "jsonl":
        write_json_lines(json_entries(decided, repository), output)
    else:
        raise ValueError(f"Unknown format: {fmt}")
