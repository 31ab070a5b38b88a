"""Per-document text and per-sheet CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import sheet_label


def write_document_texts(
    lines: DataFrame, name: str, order: list[str], path: str, text: str = "text", partitions: int | None = None
) -> None:
    """One folder per output name holding the document's ordered lines as text.

    Range partitioning keeps a document together and in order, and cuts a very large one
    into several part files instead of handing it to one task. Without ``partitions`` the
    session's shuffle partitions apply.
    """
    keys = [name, *order]
    ranged = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys)
    ordered.select(name, F.col(text)).write.mode("overwrite").partitionBy(name).text(path)


def write_sheet_csv(rows: DataFrame, sheet: str, path: str) -> None:
    """Wide rows as properly quoted CSV, one folder per sheet with spaces as ``_``."""
    rows.withColumn(sheet, sheet_label(F.col(sheet))).write.mode("overwrite").partitionBy(sheet).option(
        "header", "false"
    ).csv(path)


def write_csv_lines(lines: DataFrame, document: str, path: str) -> None:
    """Lines of ``assembly.sheet_csv_lines``, one folder per ``{stem}_{sheet}.csv`` name."""
    from ..functions.routes import sheet_output_name

    named = lines.withColumn("file", sheet_output_name(F.col(document), F.col("sheet")))
    write_document_texts(named, "file", ["row_no"], path)
