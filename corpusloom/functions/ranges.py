"""Page and slide selections such as ``1-3,7``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"\A\s*[0-9]+\s*(?:-\s*[0-9]+\s*)?\z"


def _bounds(spec: Column) -> Column:
    """Array of ``struct(low, high)``, reversed ranges swapped; NULL when malformed."""

    def one(part: Column) -> Column:
        ends = F.split(part, "-")
        first = F.trim(F.element_at(ends, 1)).try_cast("bigint")
        last = F.trim(F.element_at(ends, -1)).try_cast("bigint")
        return F.struct(F.least(first, last).alias("low"), F.greatest(first, last).alias("high"))

    parts = F.split(spec, ",")
    return F.when(F.forall(parts, lambda p: p.rlike(_PART)), F.transform(parts, one))


def _merged(bounds: Column) -> Column:
    """Sorted bounds, overlapping and adjoining ones joined; nothing is expanded."""

    def add(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["low"].alias("low"), F.greatest(last["high"], b["high"]).alias("high"))
        touching = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["high"] + 1 >= b["low"])
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(b))
        )

    return F.aggregate(F.array_sort(bounds), _none(), add)


def _none() -> Column:
    return F.array().cast("array<struct<low:bigint,high:bigint>>")


def parse_page_range(spec: Column) -> Column:
    """Merged bounds ``array<struct<low, high>>``; ``[]`` for empty or NULL, NULL for a malformed text."""
    return F.when(spec.isNull() | (spec == ""), _none()).otherwise(_merged(_bounds(spec)))


def pages_in_bounds(spec: Column, n_pages: Column) -> Column:
    """Merged bounds of the requested pages that exist; every page when nothing was requested.

    NULL for a malformed text or an unknown number of pages.
    """
    last = F.coalesce(n_pages.cast("bigint"), F.lit(0))
    everything = F.when(
        last >= 1, F.array(F.struct(F.lit(1).cast("bigint").alias("low"), last.alias("high")))
    ).otherwise(_none())
    clamped = F.filter(
        F.transform(
            _bounds(spec),
            lambda b: F.struct(F.greatest(b["low"], F.lit(1)).alias("low"), F.least(b["high"], last).alias("high")),
        ),
        lambda b: b["low"] <= b["high"],
    )
    chosen = F.when(spec.isNull() | (spec == ""), everything).otherwise(_merged(clamped))
    return F.when(n_pages.isNotNull(), chosen)


def in_ranges(bounds: Column, page: Column) -> Column:
    """Whether a page lies within any of the bounds."""
    return F.exists(bounds, lambda b: page.between(b["low"], b["high"]))


def range_text(bounds: Column) -> Column:
    """Bounds as they are written, ``1-3,7``."""
    return F.array_join(
        F.transform(
            bounds,
            lambda b: F.concat_ws("-", b["low"].cast("string"), F.when(b["low"] < b["high"], b["high"].cast("string"))),
        ),
        ",",
    )


def constant_ranges(spec: str) -> list[tuple[int, int]]:
    """Bounds of a selection given as a parameter; a malformed one is an error."""
    bounds = []
    for part in spec.split(","):
        ends = [end.strip() for end in part.split("-")]
        if not 1 <= len(ends) <= 2 or not all(end.isascii() and end.isdigit() for end in ends):
            raise ValueError(f"Invalid page number or range: {spec}")
        bounds.append((min(map(int, ends)), max(map(int, ends))))
    return bounds


def page_error(spec: Column, n_pages: Column) -> Column:
    """Why a selection cannot be used, or NULL."""
    chosen = pages_in_bounds(spec, n_pages)
    document = F.concat(F.lit(" (document has "), n_pages.cast("string"), F.lit(" pages)"))
    return F.when(spec != "", F.when(_bounds(spec).isNull(), F.concat(F.lit("Invalid page number or range: "), spec)).when(
        F.size(chosen) == 0, F.concat(F.lit("No valid pages in range: "), spec, document)
    ))
