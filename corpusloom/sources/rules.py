"""Ignore rules: built-in patterns plus the lines of a rule file."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .tree import absolute, filesystem

# The patterns ignored by default.
DEFAULT_PATTERNS = [
    "__pycache__/*", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.dylib", "*.exe", "*.bin", "*.jpg", "*.jpeg",
    "*.pdf", "*.zip", "*.tar.gz", ".git/*", ".svn/*", ".hg/*", "node_modules/*", "venv/*", ".env/*",
]


@dataclass(frozen=True)
class Rules:
    """Ignore and override patterns, compiled into predicates by the operators."""

    ignore: tuple[str, ...] = tuple(DEFAULT_PATTERNS)
    override: tuple[str, ...] = ()

    @staticmethod
    def of(lines: Iterable[str]) -> Rules:
        """Default patterns plus rule lines given as a parameter."""
        kept = [text for text in (line.strip() for line in lines) if text and not text.startswith("#")]
        return Rules(
            tuple(dict.fromkeys([*DEFAULT_PATTERNS, *(r for r in kept if r[0] != "!")])),
            tuple(dict.fromkeys(r[1:] for r in kept if r[0] == "!")),
        )


def parse_rules(
    lines: DataFrame, column: str = "value", defaults: bool = True, by: list[str] | None = None
) -> DataFrame:
    """Distinct ``(kind, pattern)`` of rule lines, ``kind`` being ``ignore`` or ``override``.

    Blank lines and ``#`` comments are skipped; a leading ``!`` marks an override. With ``by`` (a repository), each line
    belongs to its own ``by`` columns, which come first in the result; the defaults then are the caller's to apply.
    """
    text = strip(F.col(column))
    negated = text.startswith("!")
    rules = lines.where((text != "") & ~text.startswith("#")).select(
        *(by or []),
        F.when(negated, "override").otherwise("ignore").alias("kind"),
        F.when(negated, F.substr(text, F.lit(2))).otherwise(text).alias("pattern"),
    )
    if defaults and not by:
        rules = rules.unionByName(default_rules(lines.sparkSession))
    return rules.distinct()


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in patterns as a table."""
    return spark.range(1).select(
        F.lit("ignore").alias("kind"),
        F.explode(F.array(*[F.lit(p) for p in DEFAULT_PATTERNS])).alias("pattern"),
    )


def load_rules(rule_file: str | None) -> Rules:
    """Rules of one tree from its rule file; the defaults alone where there is none.

    The file is opened directly because Spark's readers pass over dot files. It is
    configuration, needed on the driver to compile the predicates. A file that is not
    UTF-8 is reported and ignored.
    """
    if rule_file is None:
        return Rules()
    fs, path = filesystem(absolute(rule_file))
    if fs.get_file_info(path).type != pafs.FileType.File:
        return Rules()
    with fs.open_input_stream(path) as stream:
        content = stream.read()
    try:
        return Rules.of(re.split("\r\n|\r|\n", content.decode("utf-8")))
    except UnicodeDecodeError as error:
        warnings.warn(f"Error reading {rule_file}: {error}", stacklevel=2)
        return Rules()
