import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least):
    """The audit by its definition; rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in row) for row in rows]
    words = [TERM.findall(text.translate(LOWER)) for text, _, _ in rows]
    held, counts = Counter(), defaultdict(Counter)
    for found, (_, lang, source) in zip(words, rows, strict=True):
        held.update((lang, term) for term in set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {lang for _, lang, _ in rows}:
        kept = [term for name, term in held if name == lang and held[name, term] >= least]
        sources = sorted(s for name, s in counts if name == lang)
        p = {}
        whole = sum((counts[lang, s] for s in sources), Counter())
        for name, own in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            n = sum(own[t] for t in kept) + 2 * len(kept)
            p[name] = {t: 1 + 10**9 * (own[t] + 2) // n for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


ODD = [
    ("One two THREE Été été", "en", "a"), ("one two three 日本語 x1y2", "en", "b"), ("one\x00two_three[four", "en", None), (None, "en", "c"), ("", None, None),
    ("one one one", None, "a"), ("two", "", "b"), ("Ø Å " * 50, "x\x00y", "z\x00"), ("one two", "en", "a"), ("one two", "en", "a"),
]


@pytest.mark.parametrize("least", [1, 2, 10])
def test_equals_brute_force(spark, least):
    clashing = [(*row, 1, 2, 3, 4) for row in ODD * 3]
    docs = spark.createDataFrame(clashing, "text string, lang string, source string, term int, n int, shard int, slot int").repartition(3)
    assert rows_of(divergence.divergence(docs, least)) == brute(ODD * 3, least)


def test_many_shards_waves_and_flushes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    for name, value in (("SHARD_TERMS", 16), ("SLOTS", 200), ("HELD_ROWS", 500), ("BLOCK", 3000)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.divergence(docs, 4, wave_bytes=2000)) == brute(rows, 4)


def test_no_rows(spark, no_docs):
    assert divergence.divergence(no_docs).collect() == []


def test_one_source_has_no_pairs(spark):
    docs = spark.createDataFrame([("a b c", "en", "only")] * 12, "text string, lang string, source string")
    assert divergence.divergence(docs).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2, 3, 50, 1500])
def test_perfect_hash_is_minimal(size):
    terms = [f"term{i}".encode() for i in range(size)]
    _, slots = divergence.perfect_hash(terms)
    assert sorted(slots) == list(range(size))


def test_lookup_verifies_the_stored_term():
    tables = []
    for lang, words in (("en", [f"w{i}" for i in range(40)]), ("fr", [f"w{i}é" for i in range(30)])):
        one, two = divergence.digests([w.encode() for w in words])
        shard = divergence.shard_of(one, two, np.full(len(words), 3))
        for number in range(3):
            mine = [w for w, s in zip(words, shard, strict=True) if s == number]
            table = pa.table({"lang": [lang] * len(mine), "shard": pa.array([number] * len(mine), pa.int32()), "shards": pa.array([3] * len(mine), pa.int32()), "term": mine})
            tables.append(divergence._build(table))
    slots = divergence.Slots(pa.concat_tables(tables))
    asked = pa.array([f"w{i}" for i in range(45)], pa.large_string())
    found = slots.find("en", asked)
    assert (found[:40] >= 0).all() and (found[40:] == -1).all() and len(set(found[:40])) == 40
    assert slots.terms.take(pa.array(found[:40])).to_pylist() == [f"w{i}" for i in range(40)]
    assert (slots.find("fr", asked) == -1).all() and (slots.find("de", asked) == -1).all()
    assert slots.bounds["fr"][0] == slots.bounds["en"][1] and slots.bounds["fr"][1] == 70


def test_long_division_is_exact():
    counts, total, terms = [0, 1, 10**6, 10**9, 10**13], 10**14 // 2, 12345
    found = divergence.probability(np.array(counts), total, terms)
    assert found.tolist() == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]


def test_a_wave_keeps_its_bound(spark):
    shards = spark.createDataFrame([("en", i, 100 + i % 7) for i in range(200)], "lang string, shard int, size bigint")
    dealt, count = divergence.waves_of(shards, 1000)
    sums = [r["sum(size)"] for r in dealt.groupBy("wave").sum("size").collect()]
    assert max(sums) <= 1000 and sum(sums) == sum(100 + i % 7 for i in range(200)) and count >= 21
