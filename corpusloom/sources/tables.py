"""Schemas of the element tables and a typed reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "manifest": "path string, length bigint, modified timestamp",
    "files": "path string, length bigint, content binary",
    "commits": "path string, message string, author string, committed_at timestamp, sha string",
    "cells": "path string, sheet string, sheet_no int, row_no bigint, col_no int, value string, vtype string",
    "shapes": "path string, slide_no bigint, shape_no bigint, text string",
    "elements": "path string, kind string, table_no bigint, row_no bigint, col_no int, seq bigint, text string",
    "page_texts": "path string, page_no bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "uploads": "job_id string, pos bigint, filename string, content_type string, length bigint",
    "file_results": "job_id string, pos bigint, filename string, error string, output string, ts timestamp",
}


def read_table(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read one of the known tables with its fixed schema (no inference pass)."""
    return spark.read.format(fmt).schema(SCHEMAS[kind]).options(**options).load(path)
