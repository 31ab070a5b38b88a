"""Ordered text out of rows, in parts of bounded length.

Every document is first a table of ordered lines. :func:`assemble` joins them part by part: the part of a line is a fixed
function of its order values, whatever the size of the document, so small and huge documents have one schema, one rule and
one shuffle. A part is cut wherever the bytes of its lines pass a limit, so no value is larger than that and one line. The parts of
a document in order of ``part_no`` and ``cut_no``, joined by the separator, are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import (
    PIPE,
    cell_text,
    csv_cell,
    pipe_row,
    page_heading,
    sheet_heading,
    slide_heading,
)
from ..functions.ranges import in_ranges
from ..functions.text import is_blank, strip

#: A part holds the lines of this many consecutive values (as a power of two) of the last order column.
PART_BITS = 10
#: Bytes of lines, each with its separator, at which a part is cut.
PART_BYTES = 8 << 20


def ordered_join(order: list[str], text: str, separator: str) -> Column:
    """Aggregate: the group's texts in order, joined. Only for groups of bounded size."""
    entries = F.sort_array(F.collect_list(F.struct(*order, text)))
    return F.array_join(entries.getField(text), separator)


def part_number(order: Column, major: Column | None = None, bits: int = PART_BITS) -> Column:
    """Number of the part: the order value without its last ``bits``, below a ``major`` value from 0 if there is one.

    Values below 0, such as headings, belong to the first part.
    """
    minor = F.shiftright(F.greatest(order.cast("bigint"), F.lit(0).cast("bigint")), bits)
    return minor if major is None else F.shiftleft(major.cast("bigint"), 40) + minor


def assemble(
    lines: DataFrame,
    document: list[str],
    order: list[str],
    part: Column,
    text: str = "text",
    separator: str = "\n",
    limit: int = PART_BYTES,
) -> DataFrame:
    """``(document, part_no, cut_no, text)`` in one shuffle.

    ``part`` has to rise with ``order``; lines that tie there are ordered by text. Lines are dealt by document and part; there a running sum of
    their bytes, a window that Spark streams through, numbers the cuts from 0, and only a cut, of ``limit`` bytes and a line at most, is
    gathered. The cuts are finer than what the rows are dealt by, so they cost no further exchange.
    """
    dealt = lines.withColumn("part_no", part.cast("bigint"))
    keys = [*document, "part_no"]
    earlier = Window.partitionBy(*keys).orderBy(*order, text).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + len(separator)
    before = F.coalesce(F.sum(size).over(earlier), F.lit(0).cast("bigint"))
    cut = dealt.withColumn("cut_no", F.floor(before / limit).cast("bigint"))
    return cut.groupBy(*keys, "cut_no").agg(ordered_join(order, text, separator).alias(text))


def slide_text(lines: DataFrame, document: list[str], bits: int = PART_BITS, limit: int = PART_BYTES) -> DataFrame:
    """Parts of slide decks, 2**``bits`` slides each."""
    return assemble(lines, document, ["slide_no", "line_no"], part_number(F.col("slide_no"), bits=bits), limit=limit)


def sheet_text(lines: DataFrame, document: list[str], bits: int = PART_BITS, limit: int = PART_BYTES) -> DataFrame:
    """Parts of workbooks: the rows of a sheet, 2**``bits`` row numbers each."""
    part = part_number(F.col("row_no"), F.col("sheet_no"), bits)
    return assemble(lines, document, ["sheet_no", "row_no"], part, limit=limit)


def sheet_csv_text(lines: DataFrame, document: list[str], bits: int = PART_BITS, limit: int = PART_BYTES) -> DataFrame:
    """Parts of CSV sheets."""
    return assemble(lines, [*document, "sheet"], ["row_no"], part_number(F.col("row_no"), bits=bits), limit=limit)


def page_text(lines: DataFrame, document: list[str], bits: int = PART_BITS, limit: int = PART_BYTES) -> DataFrame:
    """Parts of paged documents, 2**``bits`` pages each."""
    return assemble(lines, document, ["page_no"], part_number(F.col("page_no"), bits=bits), limit=limit)


def word_text(lines: DataFrame, document: list[str], bits: int = PART_BITS, limit: int = PART_BYTES) -> DataFrame:
    """Parts of word-processor documents: the paragraphs, then the rows of each table."""
    part = part_number(F.col("line_no"), F.col("table_no"), bits)
    return assemble(lines, document, ["table_no", "line_no"], part, limit=limit)


def slide_lines(shapes: DataFrame, document: list[str]) -> DataFrame:
    """Lines ``(document, slide_no, line_no, text)`` of slide decks.

    A heading opens every slide and an empty line closes it; blank shapes drop out.
    ``shapes`` holds ``slide_no``, ``shape_no`` (from 0) and ``text``; a slide without
    shapes is one row with NULL text.
    """
    slides = shapes.select(*document, "slide_no").distinct()
    frame = slides.select(
        *document,
        "slide_no",
        F.explode(
            F.array(
                F.struct(F.lit(-1).cast("bigint").alias("line_no"), slide_heading(F.col("slide_no")).alias("text")),
                F.struct(F.lit(2**62).alias("line_no"), F.lit("").alias("text")),
            )
        ).alias("line"),
    ).select(*document, "slide_no", "line.line_no", "line.text")
    body = shapes.where(~is_blank(F.col("text"))).select(
        *document, "slide_no", F.col("shape_no").cast("bigint").alias("line_no"), strip(F.col("text")).alias("text")
    )
    return frame.unionByName(body)


def _rows(cells: DataFrame, key: list[str], cell: Column, separator: str) -> DataFrame:
    """One line per row: its rendered cells in column order.

    Rows are bounded by the formats' column limits (16,384 in a spreadsheet, 63 in a
    word-processor table). Cells are rendered before the grouping, in generated code.
    """
    rendered = cells.select(*key, "col_no", cell.alias("cell"))
    return rendered.groupBy(*key).agg(ordered_join(["col_no"], "cell", separator).alias("text"))


def sheet_lines(cells: DataFrame, document: list[str]) -> DataFrame:
    """Lines ``(document, sheet_no, row_no, text)`` of workbooks as pipe rows.

    NULL cells are left out, empty strings stay, rows without any value disappear; a
    heading precedes each sheet.
    """
    headings = _sheet_headings(cells, document)
    filled = cells.where(F.col("value").isNotNull()).withColumn("row_no", F.col("row_no").cast("bigint"))
    shown = strip(cell_text(F.col("value"), F.col("vtype")))
    return headings.unionByName(_rows(filled, [*document, "sheet_no", "row_no"], shown, PIPE))


def _sheet_headings(rows: DataFrame, document: list[str]) -> DataFrame:
    """A line with row number -1 that opens each sheet."""
    sheets = rows.select(*document, "sheet_no", "sheet").distinct()
    return sheets.select(
        *document, "sheet_no", F.lit(-1).cast("bigint").alias("row_no"), sheet_heading(F.col("sheet")).alias("text")
    )


def sheet_row_lines(rows: DataFrame, document: list[str]) -> DataFrame:
    """:func:`sheet_lines` of rows that come whole: ``cells`` is an array of ``struct(value, vtype)`` in column order.

    A row is rendered where it stands; no cell is shuffled.
    """
    shown = F.transform("cells", lambda c: F.when(c["value"].isNotNull(), strip(cell_text(c["value"], c["vtype"]))))
    body = rows.where(F.exists("cells", lambda c: c["value"].isNotNull())).select(
        *document, "sheet_no", F.col("row_no").cast("bigint").alias("row_no"), pipe_row(shown).alias("text")
    )
    return _sheet_headings(rows, document).unionByName(body)


def sheet_csv_lines(cells: DataFrame, document: list[str]) -> DataFrame:
    """Lines ``(document, sheet_no, sheet, row_no, text)`` of every sheet as CSV text.

    NULL cells are empty fields, strings with a comma are quoted, all rows stay.
    """
    rendered = cell_text(F.col("value"), F.col("vtype"))
    return _rows(cells, [*document, "sheet_no", "sheet", "row_no"], csv_cell(rendered, F.col("vtype")), ",")


def page_lines(page_texts: DataFrame, document: list[str], headed: bool = False) -> DataFrame:
    """Lines ``(document, page_no, text)`` of paged documents; blank pages drop out.

    ``headed`` puts a page heading before each text, as a page selection does.
    """
    text = strip(F.col("text"))
    if headed:
        text = F.concat(page_heading(F.col("page_no")), F.lit("\n"), text)
    return page_texts.where(~is_blank(F.col("text"))).select(
        *document, F.col("page_no").cast("bigint").alias("page_no"), text.alias("text")
    )


def word_lines(elements: DataFrame, document: list[str]) -> DataFrame:
    """Lines ``(document, table_no, line_no, text)`` of word-processor documents.

    Paragraphs first (``table_no`` 0), then the rows of each table as pipe rows; blank
    paragraphs, cells and rows drop out. ``elements`` has ``kind`` ``paragraph`` (with
    ``seq``) or ``cell`` (with ``table_no`` from 1, ``row_no``, ``col_no``).
    """
    filled = elements.where(~is_blank(F.col("text")))
    paragraphs = filled.where(F.col("kind") == "paragraph").select(
        *document,
        F.lit(0).cast("bigint").alias("table_no"),
        F.col("seq").cast("bigint").alias("line_no"),
        strip(F.col("text")).alias("text"),
    )
    cells = filled.where(F.col("kind") == "cell").select(
        *document,
        F.col("table_no").cast("bigint").alias("table_no"),
        F.col("row_no").cast("bigint").alias("line_no"),
        "col_no",
        "text",
    )
    rows = _rows(cells, [*document, "table_no", "line_no"], strip(F.col("text")), PIPE)
    return paragraphs.unionByName(rows)


def selected_pages(page_texts: DataFrame, chosen: DataFrame, document: list[str]) -> DataFrame:
    """Only the requested pages; ``chosen`` has one row per document with its bounds ``pages``."""
    joined = page_texts.join(chosen.select(*document, "pages"), document)
    return joined.where(in_ranges(F.col("pages"), F.col("page_no"))).drop("pages")
