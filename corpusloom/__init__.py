"""Corpus preparation on Spark: select, decode, extract, count, enrich, assemble, export."""

from .plans.export import ExportOptions, decided_files, export_tree, write_export
from .session import build_session
from .sources.rules import Rules, load_rules
from .sources.tree import list_tree, read_contents

__all__ = [
    "ExportOptions",
    "Rules",
    "build_session",
    "decided_files",
    "export_tree",
    "list_tree",
    "load_rules",
    "read_contents",
    "write_export",
]
