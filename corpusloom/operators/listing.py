"""Sorted paths and the directory tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import depth, folders_down_to, name, parent
from .selection import in_tree_listing


def sort_by_path(files: DataFrame, path: str = "path") -> DataFrame:
    """Code-point order over the whole corpus (a range-partitioned sort)."""
    return files.orderBy(path)


_NEXT_LEVEL = "\x00"


def _folder_key(folder: Column) -> Column:
    """Sort key of a folder: a level marker, ``1`` and the name for every component."""
    return F.concat(F.lit("1"), F.replace(folder, F.lit("/"), F.lit(f"{_NEXT_LEVEL}1")))


def _file_key(path: Column) -> Column:
    """As :func:`_folder_key`, with ``0`` before the file's own name, so that the files of
    a folder precede its subfolders."""
    own = F.concat(F.lit("0"), name(path))
    folder = parent(path)
    return F.when(folder == "", own).otherwise(F.concat(_folder_key(folder), F.lit(_NEXT_LEVEL), own))


def _line(entry: Column, mark: str) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth(entry)), F.lit("└── "), name(entry), F.lit(mark))


def directory_tree(files: DataFrame, path: str = "path", by: list[str] | None = None) -> DataFrame:
    """``(sort_key, depth, line)`` of the tree the files span, or of one tree for each value of the ``by`` columns.

    Every folder above a file appears once; folders that hold nothing selected do not
    appear. Hidden names and names with ``test`` are left out as files. Order by
    ``sort_key`` to print. Folders are made distinct before the ones above them are
    listed, so a folder full of files costs one row per task.
    """
    column, folder, by = F.col(path), F.col("folder"), by or []
    shown = files.where(in_tree_listing(column)).select(
        *by, _file_key(column).alias("sort_key"), depth(column).alias("depth"), _line(column, "").alias("line")
    )
    direct = files.select(*by, parent(column).alias("folder")).where(folder != "").distinct()
    folders = direct.select(*by, F.explode(folders_down_to(folder)).alias("folder")).distinct()
    return shown.unionByName(
        folders.select(*by, _folder_key(folder).alias("sort_key"), depth(folder).alias("depth"), _line(folder, "/").alias("line"))
    )
