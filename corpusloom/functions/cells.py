"""Cell values, pipe rows, CSV lines and the headings of assembled documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

PIPE = " | "


def _shortest(value: Column) -> Column:
    """Fewest digits that read back as the same double.

    The JVM's own rendering is that already, except for some values of 16 and more
    digits; those are rendered with 15 to 17 digits and the first exact one is taken.
    """
    java = value.cast("string")
    shorter = [F.format_string(f"%.{digits - 1}e", value) for digits in (15, 16, 17)]
    exact = [F.when(text.try_cast("double") == value, text) for text in shorter]
    return F.upper(F.when(F.length(java) > 16, F.coalesce(*exact, java)).otherwise(java))


def float_text(value: Column) -> Column:
    """A double as ``150000.5``, ``10000000.0``, ``1e+16`` or ``1.5e-05``."""
    shortest = _shortest(value)
    mantissa = F.regexp_replace(F.regexp_extract(shortest, r"^(-?[0-9.]+)E", 1), r"\.?0*$", "")
    exponent = F.regexp_extract(shortest, r"E([-+]?[0-9]+)$", 1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.format_string("%02d", F.abs(exponent)),
    )
    plain = F.regexp_replace(shortest.try_cast("decimal(38,21)").cast("string"), r"(?<=\.\d)(\d*?)0+$", "$1")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(~F.contains(shortest, F.lit("E")), shortest)
        .when((F.abs(value) >= 1e16) | (F.abs(value) < 1e-4), scientific)
        .otherwise(plain)
    )


def bool_text(value: Column) -> Column:
    """``True`` / ``False``."""
    return F.initcap(value.cast("string"))


def datetime_text(value: Column) -> Column:
    """``2023-01-01 00:00:00``, with microseconds only where they are not zero."""
    shown = value.cast("timestamp").cast("string")
    return F.when(F.length(shown) > 19, F.rpad(shown, 26, "0")).otherwise(shown)


def cell_text(value: Column, vtype: Column) -> Column:
    """Render a cell stored as text according to its type name.

    ``vtype`` is ``str``, ``int``, ``float``, ``bool`` or ``datetime``; a value that
    does not parse as its type is kept as it is.
    """
    return F.coalesce(
        F.when(vtype == "float", float_text(value.try_cast("double")))
        .when(vtype == "bool", bool_text(value.try_cast("boolean")))
        .when(vtype == "datetime", datetime_text(value.try_cast("timestamp"))),
        value,
    )


def pipe_row(cells: Column, drop_blank: bool = False) -> Column:
    """Join the stripped non-null entries of an array with `` | ``.

    Spreadsheet cells keep empty strings; Word cells (``drop_blank``) do not. A row
    without any entry becomes NULL.
    """
    kept = F.filter(cells, lambda c: c.isNotNull())
    stripped = F.transform(kept, strip)
    if drop_blank:
        stripped = F.filter(stripped, lambda c: c != "")
    return F.when(F.size(stripped) > 0, F.array_join(stripped, PIPE))


def csv_cell(value: Column, vtype: Column | None = None) -> Column:
    """NULL as empty; a string holding a comma in quotes."""
    quotable = F.contains(value, F.lit(","))
    if vtype is not None:
        quotable = quotable & (vtype == "str")
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    return F.coalesce(F.when(quotable, quoted).otherwise(value), F.lit(""))


def csv_line(cells: Column) -> Column:
    """Comma-joined array of strings by the rule of :func:`csv_cell`; empty rows stay."""
    return F.array_join(F.transform(cells, lambda c: csv_cell(c)), ",")


def sheet_label(sheet: Column) -> Column:
    """Sheet title as used in file names."""
    return F.replace(sheet, F.lit(" "), F.lit("_"))


def slide_heading(number: Column) -> Column:
    return F.concat(F.lit("Slide "), number.cast("string"), F.lit(":"))


def sheet_heading(title: Column) -> Column:
    return F.concat(F.lit("Sheet: "), title, F.lit("\n"))


def page_heading(number: Column) -> Column:
    return F.concat(F.lit("\n=== Page "), number.cast("string"), F.lit(" ===\n"))
