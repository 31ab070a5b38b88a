import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality
from corpusloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


def net(seed=3):
    rng = np.random.default_rng(seed)
    tables = (rng.standard_normal((quality.WIDTH, quality.SYMBOLS, quality.FILTERS)) * 0.5).astype(np.float32)
    tables[:, quality.PADDING] = 0
    judge = rng.standard_normal((quality.FILTERS, quality.HIDDEN)).astype(np.float32)
    return quality.Model(
        tables, rng.standard_normal(quality.FILTERS).astype(np.float32), judge, rng.standard_normal(quality.HIDDEN).astype(np.float32),
        rng.standard_normal(2 * quality.HIDDEN), 0.3, 0.5,
    )


def brute(model, text):
    """The network by its definition, position by position."""
    data = list((text or "").encode())
    count = max(1, -(-(len(data) + quality.WIDTH - 1) // quality.SEGMENT))
    data += [quality.PADDING] * (count * quality.SEGMENT + quality.WIDTH - 1 - len(data))
    peaks = np.zeros((count + 1, quality.FILTERS))
    for position in range(count * quality.SEGMENT):
        response = model.bias + sum(model.tables[w, data[position + w]].astype(float) for w in range(quality.WIDTH))
        peaks[position // quality.SEGMENT] = np.maximum(peaks[position // quality.SEGMENT], response)
    judged = [np.maximum(np.maximum(peaks[i], peaks[i + 1]) @ model.judge + model.judge_bias, 0) for i in range(count)]
    features = np.concatenate([np.max(judged, axis=0), np.mean(judged, axis=0)])
    return 1 / (1 + np.exp(-(features @ model.weights + model.offset)))


def test_scores_equal_the_definition(spark):
    texts = ["", None, "a", "é 日本 😀", "x" * 123, "y" * 124, "word " * 200, "".join(chr(33 + i % 90) for i in range(1000))]
    model = net()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, text in enumerate(texts):
        assert found[i].score == pytest.approx(brute(model, text), abs=1e-5)
        assert found[i].predicted == int(found[i].score >= quality.THRESHOLD)


def test_slabs_and_blocks_change_nothing(monkeypatch):
    model, data = net(), np.frombuffer(("some words here. " * 3000).encode(), np.uint8)
    offsets = np.array([0, 5, 5, 20000, len(data)])
    whole = model.scores(data, offsets)
    monkeypatch.setattr(quality, "SLAB", 3)
    assert np.allclose(model.scores(data, offsets), whole)
    alone = [model.scores(data[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.allclose(alone, whole)


def test_the_end_of_a_long_text_counts():
    texts = [b"plain quiet words again and so on. " * 40] * 40 + [b"plain quiet words again and so on. " * 39 + b"#@!# $$%% ##@@ !!%% $#@! %%$$ ##!! @@##" * 4] * 40
    model = quality.train(texts, np.array([1] * 40 + [0] * 40), epochs=40)
    long = b"plain quiet words again and so on. " * 20_000
    scores = [model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (long, long + texts[-1][-160:])]
    assert scores[0] > 0.7 > 0.3 > scores[1]


def test_slopes_are_those_of_the_loss(monkeypatch):
    """One plain step down the slopes lowers the loss of the batch."""
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(8)]
    labels = np.array([0, 1] * 4)

    def loss(epochs):
        model = quality.train(texts, labels, epochs=epochs, seed=5)
        odds = np.array([model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
        return -np.mean(np.log(np.where(labels == 1, odds, 1 - odds)))

    assert loss(40) < 0.5 * loss(1)


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0), epochs=8)
    test = labels.where(held_out(F.col("doc_id"), 5, 0))
    rows = quality.score(docs, model).join(test, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert len(bad) > 100
    assert np.mean([r.predicted for r in good]) > 0.97
    assert np.mean([1 - r.predicted for r in bad]) > 0.75
    assert np.mean([[g.score > b.score for g in good] for b in bad]) > 0.97


def test_learns_from_no_held_out_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    learn = ~held_out(F.col("doc_id"), 5, 0)
    a, b = (quality.fit(docs, x, learn, per_class=20, epochs=1) for x in (labels, turned))
    assert np.array_equal(a.tables, b.tables) and a.offset == b.offset


def test_sample_keeps_its_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, None) for i in range(2, 100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    rows, total = quality.training_rows(docs, labels, F.lit(True), 20)
    found = rows.collect()
    assert total == {0: 51, 1: 49}  # an id with both labels is low quality
    assert sum(r.quality == 1 for r in found) <= 20 and sum(r.quality == 0 for r in found) <= 20
    assert len({r.doc_id for r in found}) == len(found)


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        model = quality.fit(odd_docs, labels, F.lit(True), epochs=1)
        rows = quality.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 7}) == 1
        assert quality.score(no_docs, model).collect() == []
    assert {round(r.score, 6) for r in quality.score(odd_docs, quality.fit(odd_docs, none, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.score > 0.99 for r in quality.score(odd_docs, quality.fit(odd_docs, one, F.lit(True))).collect())
    assert zlib.crc32(b"0") % 5 != 0  # a fold that the query keeps for learning
