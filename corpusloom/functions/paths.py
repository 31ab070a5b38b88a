"""Path algebra on string columns (``/`` separated, as found in a manifest)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    """Last component."""
    return F.substring_index(path, "/", -1)


def _raw_suffix(path: Column) -> Column:
    """Last extension as written; empty where the only dot leads or ends the name."""
    own = name(path)
    last = F.substring_index(own, ".", -1)
    has_stem = F.length(own) - F.length(last) > 1
    return F.when(has_stem & (last != ""), F.concat(F.lit("."), last)).otherwise("")


def suffix(path: Column) -> Column:
    """Lower-cased last extension; empty for ``.bashrc``, ``x.`` and names without a dot."""
    return F.lower(_raw_suffix(path))


def stem(path: Column) -> Column:
    """Name without its last extension."""
    own = name(path)
    return F.left(own, F.length(own) - F.length(_raw_suffix(path)))


def base_name(path: Column) -> Column:
    """Name with every extension removed: the text before the first dot past position 0."""
    own = name(path)
    return F.concat(F.left(own, F.lit(1)), F.substring_index(F.substr(own, F.lit(2)), ".", 1))


def parent(path: Column) -> Column:
    """Everything before the last ``/``; empty for a top-level name."""
    return F.left(path, F.length(path) - F.length(name(path)) - F.lit(1))


def depth(path: Column) -> Column:
    """Number of components below the root, minus one for the entry itself."""
    return F.octet_length(path) - F.octet_length(F.replace(path, F.lit("/"), F.lit("")))


def is_hidden(path: Column) -> Column:
    """Any component starts with a dot."""
    return path.startswith(".") | F.contains(path, F.lit("/."))


def is_under(path: Column, folder: Column | str) -> Column:
    """The path lies below ``folder``."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return path.startswith(F.concat(folder, F.lit("/")))


def relative_to(path: Column, folder: Column | str) -> Column:
    """The part below ``folder``; NULL when the path is not inside it."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.when(is_under(path, folder), F.substr(path, F.length(folder) + F.lit(2)))


def folders_down_to(folder: Column) -> Column:
    """Array of a folder and those above it, outermost first."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
