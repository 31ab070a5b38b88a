"""Hashes of words and lines, where texts are built to collide."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import bm25, lm, neardup, repetition, toxicity
from corpusloom.llm.common import BATCH_BYTES, small_batches, text_blocks


def halves(size):
    """Two words of Thue and Morse: equal under every polynomial hash modulo a power of two, for sizes from 1,024."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(size))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_equal_slices_have_equal_hashes_and_others_do_not():
    texts = ["one two one", None, "", "two", *halves(1024), *halves(4096), "é x" * 50, "one"]
    block = next(text_blocks(pa.array(texts)))
    row, start, end = block.words()
    words = [block.data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    hashes = block.hashes(start, end)
    assert len({*zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    none = np.zeros(0, np.int64)
    assert block.hashes(none, none).tolist() == []
    ends = np.array([0, 3, 7, 11])
    assert block.hashes(ends[:-1], ends[1:]).tolist()[0] == hashes[0]  # slices that touch


def test_words_built_to_collide_stay_apart(spark):
    rows = [(i, text) for i, text in enumerate(w for size in (1024, 4096) for w in halves(size))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {0, 1, 2, 3}
    lines = spark.createDataFrame([(0, "\n".join(text for _, text in rows)), (1, " ".join(text for _, text in rows * 3))], "doc_id bigint, text string")
    found = {r.doc_id: r for r in repetition.repetition_rules(lines).collect()}
    assert (found[0].n_dup_lines, found[1].n_repeat_words) == (0, 12)
    scored = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") > 0).collect()}
    assert {i: r.n_known for i, r in scored.items()} == {0: 2, 1: 1, 2: 1, 3: 1}  # the end token, and a word only in its own text
    hits = bm25.search(docs, F.col("doc_id") >= 0).collect()
    assert {(r.query_id, r.doc_id) for r in hits} == {(i, i) for i in range(4)}


def test_arrow_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))  # 20 MB

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [len(batch)], "size": [batch.nbytes]})

    try:
        for given, kept in (("64mb", "4194304"), ("1m", "1m"), ("67108864b", "4194304"), ("100", "100")):
            spark.conf.set(key, given)
            small_batches(spark)
            assert spark.conf.get(key).removesuffix("b") == kept
        spark.conf.unset(key)
        small_batches(spark)
        found = docs.mapInArrow(sizes, "rows bigint, size bigint").collect()
        assert sum(r.rows for r in found) == 2000 and max(r.size for r in found) < 5 << 20
    finally:
        spark.conf.set(key, before)


def test_fitting_and_searching_bound_the_batches(spark, no_docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    try:
        for step in (lambda: neardup.near_duplicates(no_docs), lambda: toxicity.fit(no_docs, labels, F.lit(True))):
            spark.conf.set(key, "64m")
            step()
            assert int(spark.conf.get(key)) == BATCH_BYTES
    finally:
        spark.conf.set(key, before)
