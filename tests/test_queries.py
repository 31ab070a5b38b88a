import os

import duckdb
import pytest

import __spark_entry__ as driver
from corpusloom.plans.oracle import SQL
from corpusloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


# Awkward data made of the given tables: missing, empty and blank values, carriage returns,
# NUL, Unicode white space, broken markup, names with brackets, and keys with a third of all rows.
ODD = {
    "documents": """SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN NULL WHEN doc_id % 17 = 5 THEN ''
        WHEN doc_id % 13 = 2 THEN text || chr(13) || chr(10) || 'x' || chr(13) || 'y'
        WHEN doc_id % 19 = 4 THEN chr(160) || chr(8195) || text || chr(28) || ' '
        WHEN doc_id % 23 = 1 THEN substr(text, 1, 100) || chr(0) || text
        WHEN doc_id % 29 = 1 THEN '   ' || chr(10) || chr(10) || '  '
        WHEN doc_id % 31 = 2 THEN '!keep' || chr(10) || '# c' || chr(10) || '  !x  ' || chr(10) || '!'
        WHEN doc_id % 37 = 2 THEN 'MIME-Version: 1.0 Content-Type: multipart/related' ELSE text END AS text,
      lang, CASE WHEN doc_id % 3 = 0 THEN 'source hot' ELSE source END AS source, n_chars FROM documents""",
    "pages": """SELECT page_id, CASE page_id % 10 WHEN 1 THEN 'https://h.org/a.b/c.tar.gz'
        WHEN 2 THEN 'https://github.com/o/r/tree/x/y/z.html' WHEN 3 THEN '.hid' WHEN 4 THEN 'x.' ELSE url END AS url,
      CASE page_id % 9 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '  '
        WHEN 4 THEN '<p>a<p>b<h2>c<ul><li>x<li>y</ul>tail' WHEN 5 THEN replace(html, '</p>', '')
        WHEN 6 THEN replace(html, '<p>', '<P CLASS=x>') WHEN 7 THEN html || '<!-- open <p>no</p>' ELSE html END AS html
      FROM pages""",
    "conversations": """SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id,
      CAST(conv_id * 100 + turn AS BIGINT) AS turn, CASE WHEN turn % 5 = 1 THEN NULL ELSE role END AS role,
      CASE WHEN turn % 7 = 2 THEN '  ' WHEN turn % 7 = 3 THEN NULL ELSE chr(160) || text || ' ' END AS text
      FROM conversations""",
    "events": """SELECT event_id, ts, CAST(CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS BIGINT) AS user_id,
      CASE WHEN event_id % 50 = 9 THEN NULL ELSE event_type END AS event_type, value,
      CASE WHEN event_id % 40 = 3 THEN NULL ELSE props END AS props FROM events""",
    "orders": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS BIGINT) AS o_custkey,
      CASE WHEN o_orderkey % 9 = 1 THEN 'O' ELSE o_orderstatus END AS o_orderstatus,
      CASE o_orderkey % 70 WHEN 1 THEN 12345678.0 WHEN 2 THEN 0.00012 ELSE o_totalprice END AS o_totalprice,
      o_orderdate, o_orderpriority FROM orders""",
    "part": """SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN p_name || ' (x' WHEN 2 THEN p_name || '(7)'
        WHEN 3 THEN 'a, "b"' WHEN 4 THEN 'n.v1' ELSE p_name END AS p_name, p_brand, p_type, p_size, p_retailprice
      FROM part""",
}


def connect(folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return connection


@pytest.fixture(scope="module")
def given():
    return DATA, connect(DATA)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, source = str(tmp_path_factory.mktemp("odd")), connect(DATA)
    for file in os.listdir(DATA):
        table = file.removesuffix(".parquet")
        made = ODD.get(table, f"SELECT * FROM {table}")
        source.execute(f"COPY ({made}) TO '{folder}/{file}' (FORMAT parquet)")
    return folder, connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def check(spark, data, name):
    folder, duck = data
    found = QUERIES[name](spark, folder)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    assert sorted(found.columns) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in found.collect()) == wanted


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, given, name):
    check(spark, given, name)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql_on_awkward_data(spark, odd, name):
    check(spark, odd, name)


def test_plans_hold_no_cross_joins_and_no_python(spark):
    for name, build in QUERIES.items():
        if name.startswith("stream"):
            continue
        plan = build(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("NestedLoopJoin", "CartesianProduct", "EvalPython", "MapInPandas")), name


def test_entry(spark):
    assert driver.entry(spark).count() > 0
