"""Next free names among numbered versions ``base(n).ext``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import name, parent, stem
from .numbering import rank_rows, same_keys

FAMILY = ["folder", "base", "ext"]
_NUMBER = r"(?s)\A[^(]*\(([0-9]+)\)\z"


def _parts(path: Column) -> dict[str, Column]:
    """``folder``, ``stem``, ``base`` (the stem before a bracket) and ``ext`` of a name."""
    own = stem(path)
    return {
        "folder": parent(path),
        "stem": own,
        "base": F.substring_index(own, "(", 1),
        "ext": F.substr(name(path), F.length(own) + F.lit(1)),
    }


def highest_versions(existing: DataFrame, path: str = "path") -> DataFrame:
    """``(folder, base, ext, highest)``; an unnumbered name counts as 0.

    Names such as ``a(x).txt`` belong to the family of ``a.txt`` but carry no number.
    """
    own = F.col("stem")
    number = F.regexp_extract(own, _NUMBER, 1).try_cast("bigint")
    return (
        existing.select(*[part.alias(key) for key, part in _parts(F.col(path)).items()])
        .where((F.col("base") == own) | own.endswith(")"))
        .groupBy(*FAMILY)
        .agg(F.max(F.coalesce(number, F.lit(0))).alias("highest"))
    )


def next_versions(wanted: DataFrame, existing: DataFrame, path: str = "path", order: list[str] | None = None) -> DataFrame:
    """Add ``next_path`` to every wanted name, as if the names were asked for one after the other.

    The first of a free family keeps its own name; every other one gets the number after the highest so far. So each family is
    given a run of numbers: its highest existing one (or the first name's own) plus the place among the wanted names by ``order``,
    by default the name itself. Names asked for twice get two numbers, and no two results are the same. Places come from
    ``rank_rows``, so a family of which a large part of the batch is asked for is numbered by many tasks. Other columns stay.
    """
    named = wanted.withColumns({f"_{key}": part for key, part in _parts(F.col(path)).items()})
    family = [f"_{key}" for key in FAMILY]
    ranked = rank_rows(named, family, order or [path], "_place")
    # what the family starts from: existing names, or the first wanted one
    own = F.coalesce(F.regexp_extract("_stem", _NUMBER, 1).try_cast("bigint"), F.lit(0)).alias("_own")
    first = ranked.where(F.col("_place") == 1).select(*[F.col(key).alias(f"_of{key}") for key in family], own)
    found = highest_versions(existing, path).select(*[F.col(key).alias(f"_in_{key}") for key in FAMILY], F.col("highest").alias("_highest"))
    joined = ranked.join(first, same_keys(family, "_of")).join(found, same_keys(family, "_in"), "left")
    number = F.when(F.col("_highest").isNull(), F.col("_own") + F.col("_place") - 1).otherwise(F.col("_highest") + F.col("_place"))
    numbered = F.concat(
        F.when(F.col("_folder") == "", "").otherwise(F.concat("_folder", F.lit("/"))),
        F.col("_base"),
        F.lit("("),
        number.cast("string"),
        F.lit(")"),
        F.col("_ext"),
    )
    keeps = F.col("_highest").isNull() & (F.col("_place") == 1)
    return joined.select(*wanted.columns, F.when(keeps, F.col(path)).otherwise(numbered).alias("next_path"))
