"""Repository URLs: validity, parts and display name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted repository address.
REPO_ADDRESS = r"^(https?://github\.com/[^/]+/[^/]+)"


def is_repo_url(url: Column) -> Column:
    """The URL starts with a repository address; NULL counts as invalid."""
    return F.coalesce(url.rlike(REPO_ADDRESS), F.lit(False))


def _group(url: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, group), F.lit(""))


def _tree_parts(url: Column, base: Column) -> Column:
    """Segments behind ``tree`` in the path below the address; empty without a branch or with a bare final slash."""
    segments = F.split(F.substr(url, F.length(base) + 1), "/")
    at = F.array_position(segments, "tree").cast("int")
    behind = F.slice(segments, at + 1, F.size(segments))
    usable = (at > 0) & (F.get(behind, F.lit(0)) != "") & ~((F.size(behind) == 2) & (F.get(behind, F.lit(1)) == ""))
    return F.when(usable, behind).otherwise(F.array().cast("array<string>"))


def parse_repo_url(url: Column, use_subdirectory: bool = False) -> Column:
    """``struct(base, branch, subdir)``; all NULL for an invalid URL.

    Deep links below the repository (issues, pull requests, ...) fall away; the
    subdirectory of a ``/tree/<branch>/<path>`` link is kept only on request.
    """
    base = _group(url, REPO_ADDRESS, 1)
    parts = _tree_parts(url, base)
    below = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), "/"))
    return F.struct(
        F.when(base.endswith(".git"), base).otherwise(F.concat(base, F.lit(".git"))).alias("base"),
        F.get(parts, F.lit(0)).alias("branch"),
        (below if use_subdirectory else F.lit(None).cast("string")).alias("subdir"),
    )


def repo_name(url: Column) -> Column:
    """Last segment without ``.git``."""
    trimmed = F.rtrim(url, F.lit("/"))
    return F.replace(F.substring_index(trimmed, "/", -1), F.lit(".git"), F.lit(""))
