import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@given(st.text(st.one_of(st.sampled_from(" \n\t'sdlvreABÉéßŉİıσΣςﬁ①5.!\x1c\x85\xa0 <|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizer_s(text):
    assert P.token_ids(text, PATH) == whole_ids(text).tobytes()


def test_special_strings_are_text():
    assert P.token_ids("a <|endoftext|> b", PATH) == whole_ids("a <|endoftext|> b").tobytes()


def test_plain_words_need_no_pattern(monkeypatch):
    monkeypatch.setattr(P, "_LOADED", {})
    monkeypatch.setattr(P._Words, "SPLIT", None)
    assert P.token_ids("Words of  plain LETTERS\nonly x", PATH) == whole_ids("Words of  plain LETTERS\nonly x").tobytes()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_piece_once(demand):
    counts = np.zeros(65, np.int64)
    for length, n in demand.items():
        counts[length] = n
    made = P.plan(counts, 64)
    length = np.repeat(np.arange(65), counts)
    number = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = made.place(length, number)
    spans = {}
    for s, o, size in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        spans.setdefault(s, []).append((o, size))
    for parts in spans.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 64
    assert len(spans) == made.sequences >= -(-int((counts * np.arange(65)).sum()) // 64)


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        price = np.where(rng.random(13) < 0.5, rng.random(13), -1.0)
        price[0] = -1
        best, _ = P.knapsack(price, 12)

        def brute(room, price=price):
            return max([0.0, *(price[size] + brute(room - size) for size in range(1, room + 1) if price[size] > 0)])

        assert best[12] == pytest.approx(brute(12))


def test_fractional_solution_is_near_the_volume_bound():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 200, 3000), minlength=257)
    bought = P.fractional(counts, 256)
    assert all(sum(pattern) <= 256 for pattern in bought)
    bound = (counts * np.arange(257)).sum() / 256
    assert P.plan(counts, 256).sequences <= 1.005 * bound + 1
    assert sum(bought.values()) <= 1.05 * bound


def check(docs, found):
    expected = {}
    for doc_id, text in docs:
        ids = whole_ids(text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            key = (doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))
            expected[key] = expected.get(key, 0) + 1
    got = {}
    for r in found:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == expected
    spans = {}
    for r in found:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(spans)


def test_documents(spark, odd_docs):
    given_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd_docs.select("doc_id", "text").unionByName(given_docs)
    rows = [tuple(r) for r in docs.collect()]
    found = P.pack(odd_docs.unionByName(given_docs, allowMissingColumns=True), PATH).collect()
    sequences = check(rows, found)
    tokens = sum(len(whole_ids(t)) for _, t in rows)
    assert sequences <= 1.02 * tokens / 2048 + 1


def test_hot_length_spreads(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'same words in all of them' AS text").repartition(8)
    check([tuple(r) for r in docs.collect()], P.pack(docs, PATH).collect())


def test_no_rows(no_docs):
    assert P.pack(no_docs, PATH).collect() == []
