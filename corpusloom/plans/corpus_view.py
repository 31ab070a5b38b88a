"""A file corpus seen through the ``documents`` table.

The test tables hold no file tree, so each document is given a path: folder by
``doc_id % 13``, extension by ``floor(doc_id / 20) % 10``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ["src", "venv", ".git", "docs", "__pycache__", "_priv", "tests"]
EXTENSIONS = [".txt", ".py", ".md", ".json", ".csv", ".pdf", ".bin", ".jpg", ".xyz", ""]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_path() -> Column:
    """The made-up path of a document."""
    folders = F.array(*[F.lit(f) for f in FOLDERS])
    extensions = F.array(*[F.lit(e) for e in EXTENSIONS])
    folder = F.coalesce(F.get(folders, F.pmod("doc_id", F.lit(13)).cast("int")), F.col("source"))
    extension = F.get(extensions, F.pmod(F.floor(F.col("doc_id") / 20), F.lit(10)).cast("int"))
    return F.concat(folder, F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), extension)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, path, length, text)`` over the whole table."""
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        document_path().alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        "text",
    )


CORPUS_SQL = """(
  SELECT doc_id, source, text, strlen(text) AS length,
    coalesce(CASE doc_id % 13 WHEN 0 THEN 'src' WHEN 1 THEN 'venv' WHEN 2 THEN '.git' WHEN 3 THEN 'docs'
      WHEN 4 THEN '__pycache__' WHEN 5 THEN '_priv' WHEN 6 THEN 'tests' END, source)
    || '/' || lang || '/doc' || doc_id ||
    CASE (doc_id // 20) % 10 WHEN 0 THEN '.txt' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.json'
      WHEN 4 THEN '.csv' WHEN 5 THEN '.pdf' WHEN 6 THEN '.bin' WHEN 7 THEN '.jpg' WHEN 8 THEN '.xyz' ELSE '' END
    AS path
  FROM documents)"""
