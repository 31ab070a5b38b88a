"""Registered queries against their SQL, and the pipeline against its parts."""

import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm.queries import QUERIES
from corpusloom.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_against_its_parts(spark, words):
    from test_neardup import brute
    from test_packing import check

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "neardup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).collect() if r.predicted}
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.schema == docs.schema
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        seen[name] = {r.doc_id for r in kept.collect()}
        assert all(rows[r.doc_id] == r for r in kept.collect())
    assert seen["toxicity"] == set(rows) - toxic
    assert seen["language"] == seen["toxicity"]  # every document of the table is prose
    left = [(i, rows[i].text) for i in sorted(seen["language"])]
    assert {int(r.split(",")[0][1:]) for r in brute(left, words) if r.endswith("True)")} == seen["neardup"]
    found = corpus_pipeline.run(spark, SF)
    check([(i, rows[i].text) for i in seen["neardup"]], found.collect())


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns
    assert kept.collect() == []
