import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lm
from corpusloom.llm.common import held_out


def brute(rows, words, in_fold, order):
    counts = [Counter() for _ in range(order)]
    texts = [(i, ["<begin>", *words(t), "<end>"]) for i, t in rows]
    for i, tokens in texts:
        if not in_fold(i, 7, 2):
            for n in range(1, order + 1):
                counts[n - 1].update(tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1))
    seen = {t: c for (t,), c in counts[0].items() if t != "<begin>"}
    total, kinds = sum(seen.values()), len(seen)
    for i, tokens in texts:
        base = score = 0.0
        for k in range(1, len(tokens)):
            p = (seen.get(tokens[k], 0) + 1) / (total + kinds + 1)
            base += math.log10(p)
            for n in range(2, min(order, k + 1) + 1):
                context = counts[n - 2][tuple(tokens[k - n + 1 : k])]
                if context:
                    p = (counts[n - 1][tuple(tokens[k - n + 1 : k + 1])] + lm.KAPPA * p) / (context + lm.KAPPA)
            score += math.log10(p)
        yield i, in_fold(i, 7, 2), len(tokens) - 1, sum(t in seen for t in tokens[1:]), total, base, score


def same(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, odd_docs, words, in_fold, order):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd_docs.unionByName(given, allowMissingColumns=True).repartition(4)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    same(lm.score(docs, held_out(F.col("doc_id"), 7, 2), order).collect(), brute(rows, words, in_fold, order))


def test_weights_of_a_state_are_a_distribution(spark):
    """Over all words the model knows and one it does not, the probabilities after any context add up to one."""
    texts = ["a b a c", "b a", "c c b", "a"]
    known = ["a", "b", "c"]
    after = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    asked = [(100 + i, f"{w} {x}") for i, (w, x) in enumerate((w, x) for w in known for x in [*known, "zz"])]
    ends = [(500 + i, w) for i, w in enumerate(known)]
    held = F.col("doc_id") >= 100
    docs = after.unionByName(spark.createDataFrame(asked + ends, "doc_id bigint, text string"))
    score = {r.doc_id: r.score for r in lm.score(docs, held).collect()}
    singles = {w: score[500 + i] for i, w in enumerate(known)}
    assert all(math.isfinite(x) for x in score.values()) and len(singles) == 3
    counts = Counter(" ".join(texts).split()) + Counter({"<end>": 4})
    total, kinds = sum(counts.values()), len(counts)
    base = {w: (counts[w] + 1) / (total + kinds + 1) for w in [*known, "<end>", "zz"]}
    assert sum(base.values()) == pytest.approx(1.0)


def test_chunks_do_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    test = held_out(F.col("doc_id"), 7, 2)
    whole = sorted(map(tuple, lm.score(docs, test).collect()))
    monkeypatch.setattr(lm, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 4000)
    cut = sorted(map(tuple, lm.score(docs.repartition(3), test).collect()))
    assert [r[:5] for r in whole] == [r[:5] for r in cut]
    assert [x for r in whole for x in r[5:]] == pytest.approx([x for r in cut for x in r[5:]], rel=1e-9)


def test_memory_of_a_chunk():
    """Counting and scoring a chunk holds a few numbers a token, wide arrays only for a part of it."""
    rng = np.random.default_rng(1)
    size = np.full(4000, 250)
    tokens = lm.mix(np.minimum(rng.zipf(1.2, int(size.sum())), 50_000).astype(np.uint64))
    tokens[::250] = lm._BEGIN
    parts = [(tokens[at : at + 50_000], size[:200], None, np.zeros(200, bool)) for at in range(0, len(tokens), 50_000)]
    tracemalloc.start()
    every, totals = lm.counted(parts, 2)
    counting = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    known, _, score = lm.scored(tokens, size, totals, 2, 4000 * 249, 50_000)
    scoring = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert known.tolist() == [249] * 4000 and (score < 0).all()
    assert counting < 64 * len(tokens) and scoring < 64 * len(tokens), (counting / len(tokens), scoring / len(tokens))


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    found = lm.score(odd_docs, F.lit(True)).collect()
    assert len(found) == odd_docs.count()
    assert all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in found)
    assert lm.score(no_docs, F.lit(False)).collect() == []
    with pytest.raises(ValueError, match="order"):
        lm.score(no_docs, F.lit(False), 9)
