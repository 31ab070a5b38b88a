"""The consolidated text export as a table of ordered blocks.

Sections are 0 header, 1 tree, 2 files, 3 summary. Blocks keep their sort key, so the
writer needs one range-partitioned sort and no task ever holds the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commits import commit_line
from ..functions.text import thousands
from ..operators.listing import directory_tree
from ..operators.stats import export_stats

RULE = "=" * 80
THIN_RULE = "-" * 80
HEADER, TREE, FILES, SUMMARY = range(4)


def _section(frame: DataFrame, section: int, key: Column, block: Column) -> DataFrame:
    return frame.select(
        F.lit(section).alias("section"), key.cast("string").alias("sort_key"), block.alias("block")
    )


def header_block(repository: str | Column, generator: str) -> Column:
    """Everything before the tree; blocks carry no final newline."""
    name = repository if isinstance(repository, Column) else F.lit(repository)
    return F.concat(
        F.lit(f"Generated by {generator}\n{RULE}\n\nRepository: "), name, F.lit("\n\nDirectory Structure:\n------------------")
    )


def file_block(path: Column, text: Column, last_commit: Column | None = None) -> Column:
    """One file: name, optional commit line, text, rule."""
    parts = [F.lit("File: "), path, F.lit(f"\n{THIN_RULE}\n")]
    if last_commit is not None:
        line = commit_line(last_commit["message"], last_commit["author"], last_commit["date"])
        missing = F.when(last_commit.isNull(), "Last Commit: No commits found").otherwise("Last Commit: Unknown")
        parts += [F.coalesce(line, missing), F.lit("\n\n")]
    return F.concat(*parts, text, F.lit(f"\n{RULE}\n"))


def summary_block() -> Column:
    """The labelled counters of one statistics row."""
    return F.concat(
        F.lit("\nFile Statistics:\n--------------\nTotal files processed: "),
        F.col("processed_files").cast("string"),
        F.lit("\nBinary files skipped: "),
        F.col("binary_files").cast("string"),
        F.lit("\nFiles with errors: "),
        F.col("error_files").cast("string"),
        F.lit("\nTotal characters: "),
        thousands(F.col("total_chars")),
        F.lit("\nTotal lines: "),
        thousands(F.col("total_lines")),
        F.lit("\nTotal tokens: "),
        thousands(F.col("total_tokens")),
    )


def text_export(
    decided: DataFrame,
    repository: str,
    with_commits: bool = False,
    root: str | None = None,
    generator: str = "corpusloom",
) -> DataFrame:
    """``(section, sort_key, block)`` of the export, unordered.

    ``decided`` has ``path``, ``text`` (NULL if not decodable), ``decision`` and, for
    ``with_commits``, ``last_commit``. With a ``root`` the file headings show full paths.
    """
    kept = decided.where(F.col("decision").isin("kept", "override"))
    empty = F.lit("")
    one = decided.sparkSession.range(1)
    tree = directory_tree(kept)
    commit = F.col("last_commit") if with_commits else None
    readable = kept.where(F.col("text").isNotNull())
    shown = F.concat(F.lit(f"{root.rstrip('/')}/"), "path") if root else F.col("path")
    return (
        _section(one, HEADER, empty, header_block(repository, generator))
        .unionByName(_section(tree, TREE, F.col("sort_key"), F.col("line")))
        .unionByName(_section(one, TREE, F.lit("￿"), F.lit(f"\n{RULE}\n")))
        .unionByName(_section(readable, FILES, F.col("path"), file_block(shown, F.col("text"), commit)))
        .unionByName(_section(export_stats(decided), SUMMARY, empty, summary_block()))
    )


def sorted_lines(lines: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Range-partitioned sort; ``partitions`` overrides the session's shuffle partitions."""
    if partitions is None:
        return lines.orderBy(*keys)
    return lines.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def text_exports(decided: DataFrame, by: str = "repository", with_commits: bool = False, generator: str = "corpusloom") -> DataFrame:
    """``(by, section, sort_key, block)``: the export of every repository in ``decided``, unordered.

    ``decided`` is a staged table with ``by``, ``path``, ``text``, ``decision`` and, for ``with_commits``, ``last_commit``. A repository
    of which nothing is kept still has its header and summary.
    """
    name, key = F.col(by), "_repository"
    decided = decided.withColumn(key, name)
    kept = decided.where(F.col("decision").isin("kept", "override"))

    def section(frame: DataFrame, number: int, sort_key: Column, block: Column) -> DataFrame:
        return frame.select(
            F.col(key).alias(by), F.lit(number).alias("section"), sort_key.cast("string").alias("sort_key"), block.alias("block")
        )

    totals = export_stats(decided, [key])  # a row a repository
    empty, last = F.lit(""), F.lit("￿")
    commit = F.col("last_commit") if with_commits else None
    around = F.explode(
        F.array(
            F.struct(F.lit(HEADER).alias("section"), empty.alias("sort_key"), header_block(F.coalesce(F.col(key).cast("string"), empty), generator).alias("block")),
            F.struct(F.lit(TREE).alias("section"), last.alias("sort_key"), F.lit(f"\n{RULE}\n").alias("block")),
            F.struct(F.lit(SUMMARY).alias("section"), empty.alias("sort_key"), summary_block().alias("block")),
        )
    )
    frame = totals.select(F.col(key).alias(by), around.alias("row")).select(by, "row.*")
    tree = directory_tree(kept, by=[key])
    readable = kept.where(F.col("text").isNotNull())
    return frame.unionByName(section(tree, TREE, F.col("sort_key"), F.col("line"))).unionByName(
        section(readable, FILES, F.col("path"), file_block(F.col("path"), F.col("text"), commit))
    )


def write_text_exports(blocks: DataFrame, path: str, by: str = "repository", partitions: int | None = None) -> None:
    """Write the blocks in order, a folder for each repository; the part files of a folder in name order are its document.

    The range-partitioned sort keeps small repositories together in a task and cuts a large one into several files.
    """
    keys = [by, "section", "sort_key"]
    ranged = blocks.repartitionByRange(partitions, *keys) if partitions else blocks.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select(by, "block").write.mode("overwrite").partitionBy(by).text(path)


def write_text_export(blocks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the blocks in order; part files in name order are the document."""
    sorted_lines(blocks, ["section", "sort_key"], partitions).select("block").write.mode("overwrite").text(path)
