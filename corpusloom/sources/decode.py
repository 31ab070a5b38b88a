"""Bytes to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, universal_newlines


def is_utf8(content: Column) -> Column:
    """The bytes are well-formed UTF-8."""
    return F.is_valid_utf8(content.cast("string"))


def strict_text(content: Column) -> Column:
    """UTF-8 text with universal newlines; NULL where the bytes are malformed."""
    return F.when(is_utf8(content), universal_newlines(content.cast("string")))


def lenient_text(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8."""
    return universal_newlines(
        F.when(is_utf8(content), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    )


def used_encoding(content: Column) -> Column:
    """Which of the two encodings :func:`lenient_text` takes."""
    return F.when(is_utf8(content), "utf-8").when(content.isNotNull(), "latin-1")


def html_source(files: DataFrame) -> DataFrame:
    """Files with ``text`` and an ``error`` for pages that hold nothing but white space."""
    read = files.withColumn("text", lenient_text(F.col("content"))).drop("content")
    return read.withColumn("error", F.when(is_blank(F.col("text")), "HTML file is empty"))


def copied_text(files: DataFrame) -> DataFrame:
    """Plain text copies with an ``error`` for files that come out empty."""
    read = files.withColumn("text", lenient_text(F.col("content"))).drop("content")
    return read.withColumn("error", F.when(F.col("text") == "", "Output file is empty"))
