import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pieces as K

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = K.load_vocabulary(PATH)
IDS = {VOCABULARY.pieces[i]: i for i in VOCABULARY.plain.tolist()}


def brute(text):
    """Plain Viterbi over characters; of equal paths the piece that starts first."""
    shown = K.MARKER + text.replace(" ", K.MARKER) if text else ""
    best, back = [0.0] + [-math.inf] * len(shown), [0] * (len(shown) + 1)
    for end in range(1, len(shown) + 1):
        for start in range(max(0, end - 16), end):
            piece = shown[start:end]
            if piece in IDS:
                score = best[start] + VOCABULARY.scores[IDS[piece]]
            elif end - start == 1:
                score = best[start] + VOCABULARY.lowest - K.UNKNOWN_PENALTY
            else:
                continue
            if score > best[end]:
                best[end], back[end] = score, start
    ids, end = [], len(shown)
    while end:
        piece = shown[back[end] : end]
        ids = ([IDS[piece]] if piece in IDS else [int(VOCABULARY.bytes_[b]) for b in piece.encode()]) + ids
        end = back[end]
    return ids, best[-1]


@given(st.text(st.one_of(st.sampled_from("  \n\r\t;{}the and&&&$$$"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=300, deadline=None)
def test_paths_and_round_trip(text):
    (ids, score), = K.encode([text], VOCABULARY)
    expected, best = brute(text)
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert score == pytest.approx(best)
    assert K.decode(ids, VOCABULARY) == text.replace(K.MARKER, " ")


def test_texts_are_coded_together_as_alone():
    texts = ["", None, "a  b", "x" * 5000, "日本語 😀", "same", "same", "\n\n"]
    together = K.encode(texts, VOCABULARY)
    assert together == [K.encode([t], VOCABULARY)[0] for t in texts]
    assert together[0] == together[1] == (b"", 0.0)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_library_agrees(tmp_path):
    """The library with the same pieces and scores, told that the model is a unigram model."""
    import struct

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = b""
    for i in range(model.vocab_size()):
        kind = 2 if model.is_unknown(i) else 3 if model.is_control(i) else 6 if model.is_byte(i) else 1
        score = float(VOCABULARY.scores[i]) if kind == 1 else 0.0
        piece = model.id_to_piece(i).encode()
        body = b"\x0a" + _varint(len(piece)) + piece + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        out += b"\x0a" + _varint(len(body)) + body
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # unigram; byte fallback
    normalizer = b"\x0a\x08identity" + b"\x18\x01\x20\x00\x28\x01"
    out += b"\x12" + _varint(len(trainer)) + trainer + b"\x1a" + _varint(len(normalizer)) + normalizer
    unigram = sentencepiece.SentencePieceProcessor(model_proto=out)
    texts = ["The quick brown fox jumps over the lazy dog.", "  two  spaces ", "naïve café, déjà vu!", "日本 😀 ok", "tabs\tand\nlines", "Éiaiment oué lement"]
    for text in texts:
        (ids, _), = K.encode([text], VOCABULARY)
        assert np.frombuffer(ids, "<u4").tolist() == unigram.encode(text)
        assert K.decode(ids, VOCABULARY) == unigram.decode(unigram.encode(text))


def test_trie_finds_all_words():
    words = [b"a", b"ab", b"abc", b"b", b"\xc3\xa9", b"bca", b"\x00", b"\xff\xfe"]
    trie = K.Trie(words)
    data = np.frombuffer(b"abcab\xc3\xa9\x00\xff\xfe", np.uint8)
    start = np.arange(len(data))
    who, end, number = trie.matches(data, start, np.full(len(data), len(data)))
    found = {(int(w), int(e), int(n)) for w, e, n in zip(who, end, number, strict=True)}
    raw = data.tobytes()
    assert found == {(i, i + len(w), n) for i in range(len(raw)) for n, w in enumerate(words) if raw.startswith(w, i)}


def test_rows(spark, odd_docs, no_docs):
    found = K.encode_documents(odd_docs, VOCABULARY, keep_ids=True).collect()
    assert len(found) == odd_docs.count()
    assert all(r.round_trip for r in found)
    for r in found:
        assert r.n_pieces == len(r.ids)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.ids == brute(texts[r.doc_id] or "")[0] for r in found if r.doc_id in (1, 2, 3, 4, 5, 6, 7, 11, 12))
    assert K.encode_documents(no_docs, VOCABULARY).collect() == []
