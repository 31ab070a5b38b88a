"""Which files belong to a corpus: hidden, size, glob and type decisions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import path_glob_any
from ..functions.paths import is_hidden, is_under, name, relative_to, suffix
from ..functions.routes import BINARY_EXTENSIONS, TEXT_EXTENSIONS

PATTERN_MODES = ("exclude", "include")
SNIFF_BYTES = 1024
# Types outside ``text/*`` that hold text.
TEXT_MIME_TYPES = ["application/json", "application/xml"]


def within_size(length: Column, max_size_kb: int | None = None) -> Column:
    """At most ``max_size_kb`` * 1,024 bytes, no limit unless given; NULL for an unknown length, which a filter drops."""
    if max_size_kb is None:
        return F.lit(True)
    if max_size_kb <= 0:
        raise ValueError("max_size_kb must be positive")
    return length <= max_size_kb * 1024


def glob_choice(path: Column, pattern_mode: str = "exclude", pattern_input: str | None = None) -> Column:
    """Drop matches (``exclude``) or keep only them (``include``; no pattern keeps all)."""
    if pattern_mode not in PATTERN_MODES:
        raise ValueError("pattern_mode must be 'exclude' or 'include'")
    if pattern_mode == "exclude":
        return ~path_glob_any(path, pattern_input)
    return path_glob_any(path, pattern_input) if pattern_input else F.lit(True)


def select_files(
    files: DataFrame,
    max_size_kb: int | None = None,
    pattern_mode: str = "exclude",
    pattern_input: str | None = None,
    path: str = "path",
    length: str = "length",
) -> DataFrame:
    """Visible files within the size limit that the glob list lets through."""
    column = F.col(path)
    return files.where(
        ~is_hidden(column)
        & within_size(F.col(length), max_size_kb)
        & glob_choice(column, pattern_mode, pattern_input)
    )


def subdirectory(files: DataFrame, flag: str | None, from_url: str | None = None, path: str = "path") -> DataFrame:
    """Only what lies below a subdirectory, with paths relative to it; the explicit flag wins."""
    folder = (flag or from_url or "").strip("/")
    if not folder:
        return files
    column = F.col(path)
    return files.where(is_under(column, folder)).withColumn(path, relative_to(column, folder))


def require_subdirectory(files: DataFrame, flag: str | None, from_url: str | None = None, path: str = "path") -> DataFrame:
    """As :func:`subdirectory`, but a folder without any file is an error (runs a probe)."""
    chosen = subdirectory(files, flag, from_url, path)
    if (flag or from_url) and chosen.isEmpty():
        raise FileNotFoundError(f"Subdirectory {flag or from_url} does not exist")
    return chosen


def extension_kind(extension: Column) -> Column:
    """``binary`` or ``text`` for a known extension, else NULL."""
    return F.when(extension.isin(BINARY_EXTENSIONS), "binary").when(extension.isin(TEXT_EXTENSIONS), "text")


def _mime_entries() -> dict[str, str]:
    """Extension to type, from the standard library's own table so hosts agree.

    Compressed-archive short forms (``.tgz``) resolve to the type of what they hold.
    """
    table = mimetypes.MimeTypes(filenames=())
    known = dict(table.types_map[True])
    for short in table.suffix_map:
        guessed = table.guess_type("x" + short)[0]
        if guessed:
            known[short] = guessed
    return known


def _encodings() -> list[str]:
    return sorted(mimetypes.MimeTypes(filenames=()).encodings_map)


def _last_extension(own: Column) -> Column:
    """Extension past any leading dots, with its dot; a final dot counts as one."""
    core = F.ltrim(own, F.lit("."))
    return F.when(F.contains(core, F.lit(".")), F.concat(F.lit("."), F.substring_index(core, ".", -1))).otherwise("")


def mime_extension(path: Column) -> Column:
    """The extension a type lookup uses: a compression suffix (``.bz2``) is peeled first."""
    own = name(path)
    last = _last_extension(own)
    peeled = _last_extension(F.left(own, F.length(own) - F.length(last)))
    return F.lower(F.when(last.isin(_encodings()), peeled).otherwise(last))


def _is_text_mime(mime: str) -> bool:
    return mime.startswith("text/") or mime in TEXT_MIME_TYPES


def mime_kind(path: Column) -> Column:
    """``text`` or ``binary`` for a known MIME type, else NULL."""
    entries = _mime_entries()
    extension = mime_extension(path)
    return F.when(extension.isin([e for e, m in entries.items() if _is_text_mime(m)]), "text").when(
        extension.isin([e for e, m in entries.items() if not _is_text_mime(m)]), "binary"
    )


def sniff_kind(content: Column) -> Column:
    """``binary`` when the first bytes hold a NUL or nothing could be read, else ``text``."""
    head = F.substring(content, 1, SNIFF_BYTES)
    return F.when(content.isNull() | F.contains(head, F.lit(bytearray(b"\x00"))), "binary").otherwise("text")


def kind_by_name(path: Column) -> Column:
    """Extension, then MIME type; NULL where the name does not tell."""
    return F.coalesce(extension_kind(suffix(path)), mime_kind(path))


def file_kind(path: Column, content: Column) -> Column:
    """Extension, then MIME type, then content: the first decision wins."""
    return F.coalesce(kind_by_name(path), sniff_kind(content))


def extension_dim(spark: SparkSession) -> DataFrame:
    """``(ext, ext_kind)``: 36 fixed rows."""
    rows = [(e, "binary") for e in BINARY_EXTENSIONS] + [(e, "text") for e in TEXT_EXTENSIONS]
    return spark.createDataFrame(rows, "ext string, ext_kind string")


def mime_dim(spark: SparkSession) -> DataFrame:
    """``(mime_ext, mime, mime_kind)``: one row per extension in the pinned type table."""
    rows = [(e, m, "text" if _is_text_mime(m) else "binary") for e, m in sorted(_mime_entries().items())]
    return spark.createDataFrame(rows, "mime_ext string, mime string, mime_kind string")


def lookup_types(files: DataFrame, path: str = "path") -> DataFrame:
    """Join both dimension tables; their size is fixed, so they are broadcast."""
    spark, column = files.sparkSession, F.col(path)
    keyed = files.withColumn("ext", suffix(column)).withColumn("mime_ext", mime_extension(column))
    return keyed.join(F.broadcast(extension_dim(spark)), "ext", "left").join(
        F.broadcast(mime_dim(spark)), "mime_ext", "left"
    )


def in_tree_listing(path: Column) -> Column:
    """Names shown in the directory tree: not hidden and without ``test``."""
    own = name(path)
    return ~own.startswith(".") & ~F.contains(F.lower(own), F.lit("test"))
