"""Text measures and clean-up, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Unicode text handling treats as white space.
WHITESPACE = "".join(
    map(
        chr,
        [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
        + list(range(0x2000, 0x200B))
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (linear, also for long inner runs)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only."""
    return text.isNull() | (strip(text) == "")


def char_count(text: Column) -> Column:
    """Code points."""
    return F.length(text).cast("bigint")


def line_count(text: Column) -> Column:
    """Newlines plus one; byte lengths suffice because a newline is one byte."""
    without = F.replace(text, F.lit("\n"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(without) + 1).cast("bigint")


def token_count(text: Column) -> Column:
    """Runs of non-white-space characters."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("bigint")


def universal_newlines(text: Column) -> Column:
    r"""``\r\n`` and ``\r`` become ``\n``, as a text-mode read does."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def thousands(number: Column) -> Column:
    """``1234567`` as ``1,234,567``."""
    return F.format_number(number, 0)


def mask_secret(secret: Column) -> Column:
    """``abc...xyz``, or ``REDACTED`` for six characters or fewer; NULL and '' stay."""
    masked = F.concat(F.substring(secret, 1, 3), F.lit("..."), F.right(secret, F.lit(3)))
    return (
        F.when(secret.isNull() | (secret == ""), secret)
        .when(F.length(secret) > 6, masked)
        .otherwise(F.lit("REDACTED"))
    )


def size_kb(length: Column) -> Column:
    """Bytes in units of 1,024."""
    return length / F.lit(1024.0)


def preview(text: Column, chars: int = 1000) -> Column:
    """The first characters of an output."""
    return F.substring(text, 1, chars)
