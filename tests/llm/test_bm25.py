import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import blockmax, bm25
from corpusloom.llm.blockmax import BlockMaxIndex, Group
from corpusloom.llm.common import text_blocks


def brute(rows, queries, words, k):
    texts = [(i, Counter(words(t)), len(words(t))) for i, t in rows]
    average = max(sum(n for _, _, n in texts) / max(len(texts), 1), 1e-9)
    df = Counter(w for _, c, _ in texts for w in c)
    found = []
    for q, text in queries:
        asked, scored = Counter(words(text)), []
        for i, counts, n in texts:
            total = 0
            for w, times in asked.items():
                if tf := counts.get(w):
                    idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                    total += times * round(1e6 * idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / average))))
            if total:
                scored.append((-total, i is not None, i or 0))
        found += [(q, rank + 1, i if known else None, -t / 1e6) for rank, (t, known, i) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, odd_docs, words, monkeypatch, small):
    if small:  # many shards, several blocks of queries
        monkeypatch.setattr(bm25, "SHARD_BYTES", 20_000)
        monkeypatch.setattr(bm25, "QUERY_BYTES", 500)
        monkeypatch.setattr(bm25, "BUCKET_BYTES", 10_000)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd_docs.unionByName(given.withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True).repartition(3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    is_query = (F.col("doc_id") % 10 == 0) | (F.col("doc_id") < 9)
    queries = sorted({(i, t) for i, t in rows if i is not None and (i % 10 == 0 or i < 9)}, key=str)
    found = sorted((tuple(r) for r in bm25.search(docs, is_query, 7).collect()), key=str)
    assert found == brute(rows, queries, words, 7)


def test_two_texts_of_one_id_are_two_queries(spark):
    rows = [(100, "alpha beta"), (100, "gamma delta"), (100, "alpha beta")] + [(i, "alpha" if i % 2 else "gamma") for i in range(1, 60)]
    found = bm25.search(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") % 100 == 0).collect()
    assert sorted(r.rank for r in found) == sorted([*range(1, 11)] * 2)
    best = sorted(r.doc_id for r in found if r.rank == 1)
    assert best == [100, 100]


def test_nothing_to_find(odd_docs, no_docs):
    assert bm25.search(odd_docs, F.lit(False)).collect() == []
    assert bm25.search(no_docs, F.lit(True)).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.02, 2.0])  # all terms as matrices, some, none
def test_a_group_finds_what_each_query_finds(share, monkeypatch):
    monkeypatch.setattr(blockmax, "DENSE_SHARE", share)
    monkeypatch.setattr(blockmax, "DENSE_TERMS", 7)
    monkeypatch.setattr(blockmax, "PRODUCTS", 50)
    random = np.random.default_rng(1)
    term, row = np.nonzero(random.random((60, 300)) < np.linspace(0.001, 0.6, 60)[:, None])
    impact = random.integers(1, 4 << 24, len(term)).astype(float)
    index = BlockMaxIndex(term + 5, row, impact, 300, 64)
    query, asked = np.nonzero(random.random((40, 70)) < 0.2)
    count = random.integers(1, 300, len(query))
    low = random.integers(0, 3, 40) * random.integers(0, 1 << 36, 40)
    group, found = Group(query, asked, count, 40), [[] for _ in range(40)]
    for block in index.block_views(70):
        for q, r, score in zip(*block.search(group, low, 5), strict=True):
            found[q].append((-score, r))
    for q in range(40):
        own = query == q
        rows, score = index.search(asked[own], count[own].astype(float), 5, floor=float(low[q]))
        assert sorted(found[q])[:5] == list(zip(-score, rows, strict=True))


def test_shards_start_from_what_others_found(spark, monkeypatch):
    """Each task used to return rows of its own for every query, so the answers grew with queries times tasks."""
    monkeypatch.setattr(bm25, "SHARD_BYTES", 100)
    written, found = bm25.written, []

    def counted(df, name):
        table = written(df, name)
        found.append(table.count() if name == "answers" else 0)
        return table

    monkeypatch.setattr(bm25, "written", counted)
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 12))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))  # a task for each file
    try:
        best = bm25.search(docs, F.col("doc_id") % 100 == 0, 3).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(best) == 60
    assert sum(found) < 20 * 3 * 40 * 0.7


def test_rounds_take_every_shard_once(spark, tmp_path):
    spark.range(300).repartition(30).selectExpr("id", "cast(id % 2 as int) as kind").write.parquet(f"{tmp_path}/shards")
    table = spark.read.parquet(f"{tmp_path}/shards")
    for shards, rounds in ((0, 1), (63, 1), (64, 2), (511, 2), (512, 3)):
        parts = [[r.id for r in part.collect()] for part in bm25._rounds(table, shards)]
        assert len(parts) == rounds
        assert sorted(sum(parts, [])) == [*range(0, 300, 2)]


def test_words_are_told_apart_by_all_their_bytes():
    words = ["a" * n for n in range(1, 70)] + ["b" + "a" * n for n in range(69)] + ["a" * n + "b" for n in range(1, 69)] + ["a\0", "\0", "\0\0", "é", "日本"]
    block = next(text_blocks(pa.array([" ".join(words), " ".join(words[::-1])]), lower=True))
    row, start, end = block.words()
    found = bm25._hashes(block, start, end)
    assert len(set(words)) == len(set(found.tolist()))
    assert found[row == 0].tolist() == found[row == 1].tolist()[::-1]


def test_queries_with_the_same_words_are_searched_once(spark, monkeypatch):
    rows = [(i, "alpha beta Beta" if i % 3 else "beta\nalpha  beta") for i in range(0, 900, 10)] + [(5, "alpha"), (7, "beta")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    batches, made = bm25._batches, []
    monkeypatch.setattr(bm25, "_batches", lambda *a: (made.append(b) or b for b in batches(*a)))
    found = bm25.search(docs, (F.col("doc_id") % 100 == 0) | (F.col("doc_id") == 5), 4).collect()
    assert [b["n"] for b in made] == [2]
    answers = {q: sorted((r.rank, r.doc_id) for r in found if r.query_id == q) for q in {r.query_id for r in found}}
    assert sorted(answers) == [0, 5, *range(100, 900, 100)]
    assert all(answers[q] == [(1, 0), (2, 10), (3, 20), (4, 30)] for q in answers if q != 5)
    assert answers[5][0] == (1, 5)
