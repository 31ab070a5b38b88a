"""The training-data pipeline: each stage takes the documents its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``, whole
rows as they came:

* ``toxicity`` fits its model on labelled rows that are not held out and drops the documents it predicts as toxic;
* ``language`` drops the documents in which no language can be told (no letter, or no language reaches ``LEAST_SCORE``);
* ``neardup`` keeps one document of each group of near duplicates, the one with the smallest id;
* ``packing`` cuts what is left into token sequences.

Null ids and null texts pass the first stage, null texts end at the second. Rows that share an id are one document: they stay
or go together at the third stage. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language, neardup, packing, toxicity
from corpusloom.llm.common import held_out, load, written
from corpusloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Share of the odds that the best language needs; a clean text of a known language has far more.
LEAST_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return toxicity.without_toxic(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, ~held_out(F.col("doc_id"), 5, 0))
    return language.with_language(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("neardup", drop_near_duplicates),
    ("packing", pack),
]

#: The first two stages learn from data and the last packs token ids, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a written table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
