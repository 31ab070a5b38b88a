import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as T
from corpusloom.llm.blockmax import BlockMaxIndex
from corpusloom.llm.common import held_out


def test_index_finds_the_exact_best_rows():
    rng = np.random.default_rng(3)
    for block in (1, 3, 16):
        dense = np.where(rng.random((200, 40)) < 0.15, rng.integers(1, 5, (200, 40)), 0).astype(float)
        term, row = np.nonzero(dense.T)
        index = BlockMaxIndex(term, row, dense.T[term, row], 200, block)
        for _ in range(30):
            asked = np.flatnonzero(rng.random(45) < 0.2)
            weight = rng.integers(1, 4, len(asked)).astype(float)
            score = sum((dense[:, t] * w for t, w in zip(asked, weight, strict=True) if t < 40), np.zeros(200))
            for k, floor in ((1, 0.0), (7, 0.0), (7, 6.0), (500, 0.0)):
                best = [r for r in np.lexsort((np.arange(200), -score)) if score[r] > 0 and score[r] >= floor][:k]
                found, worth = index.search(asked, weight, k, floor)
                assert found.tolist() == best and worth.tolist() == score[best].tolist()


def test_dense_and_sparse_lists_find_the_exact_best_rows(monkeypatch):
    rng = np.random.default_rng(8)
    for rows, block, hubs in ((700, 64, 10), (700, 64, 0), (700, 1000, 500), (9, 4, 3)):
        monkeypatch.setattr(T, "BLOCK_ROWS", block)
        monkeypatch.setattr(T, "HUBS", hubs)
        share = rng.random(50) ** 3
        dense = np.where(rng.random((rows, 50)) < share, rng.random((rows, 50)), 0).astype(np.float32)
        term, row = np.nonzero(dense.T)
        known, sizes = np.unique(term, return_counts=True)
        index = T.Index(known.astype(np.int32), sizes, row.astype(np.int32), dense.T[term, row], rows, 60)
        asked = [np.flatnonzero(rng.random(60) < 0.3) for _ in range(40)] + [np.zeros(0, np.int64)]
        vectors = [(terms, rng.random(len(terms))) for terms in asked]
        skip = [int(x) for x in rng.integers(-1, rows, len(vectors))]
        for (terms, weight), left_out, (found, worth) in zip(vectors, skip, index.search(vectors, 15, skip), strict=True):
            score = sum((dense[:, t].astype(float) * w for t, w in zip(terms, weight, strict=True) if t < 50), np.zeros(rows))
            if left_out >= 0:
                score[left_out] = 0
            best = [r for r in np.argsort(-score, kind="stable") if score[r] > 0][:15]
            assert len(found) == len(best) and np.allclose(worth, score[best], atol=1e-5) and np.allclose(score[found], score[best], atol=1e-5)


def test_empty_index():
    none = np.zeros(0, np.int64)
    assert BlockMaxIndex(none, none, np.zeros(0), 0).search(np.array([1]), np.array([1.0]), 3)[0].tolist() == []


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = held_out(F.col("doc_id"), 5, 0)
    model = T.fit(docs, labels, ~test)
    known = docs.join(labels.where(test).select("doc_id", "toxic"), "doc_id")
    found = T.score(known, model).join(known.select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r for r in found if r.toxic == 1]
    clean = [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) > 50
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    # evidence is the exact nearest example, by brute force over all vectors of the index
    for r in toxic[:5]:
        text = known.where(F.col("doc_id") == r.doc_id).first().text
        term, weight = model.vector(text)
        (row, cosine), = model.index.search([(term, weight)], T.NEIGHBOURS)
        assert [e.doc_id for e in r.evidence] == [int(model.ids[x]) for x in row[:3]]
        (full, scores), = model.index.search([(term, weight)], 10**6)
        assert scores[: len(cosine)].tolist() == cosine.tolist() and full[: len(row)].tolist() == row.tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(4, 0, 0), (5, 1, 1), (5, 0, 0), (7, None, 0), (8, 1, 0), (11, 1, 1), (None, 1, 1), (12, 1, None), (77, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    ).withColumn("text", F.lit("clash"))
    model = T.fit(odd_docs, labels, F.lit(True))
    found = T.score(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    same = [r.score for r in found if r.doc_id in (1, 2, 3)]
    assert len(set(same)) == 1  # null, empty and blank texts
    kept = T.without_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns
    none = T.fit(odd_docs, labels.where("false"), F.lit(True))
    assert {r.score for r in T.score(odd_docs, none).collect()} == {0.0}
    assert T.score(no_docs, T.fit(no_docs, labels, F.lit(True))).collect() == []


def test_a_long_text_is_read_to_its_end(spark):
    clean = "plain ordinary words about nothing in particular today "
    rows = [(i, clean + (f"you vile filthyname{i % 3} rotten " if i % 2 else f"nice{i % 5} weather ")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, labels, F.lit(True))
    late = (clean * 20) + "vile filthyname0 rotten vile filthyname1 vile"
    ask = spark.createDataFrame([(1, late), (2, clean * 20)], "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in T.score(ask, model).collect()}
    assert found[1] > found[2]


def test_abusive_words_that_are_rare_each(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8))
    plain, abusive = [word() for _ in range(300)], [word() for _ in range(400)]
    rows = []
    for i in range(1000):  # each abusive word stands in two or three of the 500 toxic texts
        said = [abusive[(i // 2 * 3 + j) % 400] for j in range(3)] if i % 2 else []
        rows.append((i, " ".join([*rng.choice(plain, 20), *said]), i % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    test = F.col("doc_id") >= 800
    found = T.score(docs.where(test), T.fit(docs, docs, ~test)).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted for r in found if r.toxic) >= 90
    assert sum(r.predicted for r in found if not r.toxic) <= 2


def test_weights_cosines_and_votes_by_definition(spark):
    """Everything again without Spark, index or postings: weights of terms, vectors, the nearest examples and their votes."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = [(i, " ".join([*rng.choice(words, 12), *(["vilest", "rotten"] if i % 3 == 0 and i % 4 else [])]), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = T.fit(docs, docs, F.lit(True))
    n1 = sum(t for _, _, t in rows)
    prior, terms = n1 / len(rows), model.terms.to_pylist()
    held = {i: set().union(*(T.terms_of(w) for w in text.split())) for i, text, _ in rows}
    expected = {}
    for term in terms:
        toxic = sum(t for i, _, t in rows if term in held[i])
        both = sum(term in h for h in held.values())
        factor = T.LEAST_FACTOR + (1 - T.LEAST_FACTOR) * abs((toxic + T.DRAWN * prior) / (both + T.DRAWN) - prior) / max(prior, 1 - prior)
        plain = np.log((len(rows) + 1) / (both + 1)) + 1
        expected[term] = (plain * factor, plain)
    for term, weight in zip(terms, model.idf, strict=True):
        assert any(abs(weight - x) < 1e-9 for x in expected[term])  # a selected term counts in full
    assert {t[1:] for t in terms if t[0] == "="} == {w for _, text, _ in rows for w in text.split()}

    def vector(text):
        counts, unseen = {}, 0.0
        for word in set(text.split()):
            known = [t for t in T.terms_of(word) if t in expected]
            n = text.split().count(word)
            for t in known:
                counts[t] = counts.get(t, 0) + n
            unseen += 0 if known else (1 + np.log(n)) ** 2
        idf = dict(zip(terms, model.idf, strict=True))
        made = {t: (1 + np.log(n)) * idf[t] for t, n in counts.items()}
        length = np.sqrt(sum(x * x for x in made.values()) + unseen * model.unseen**2)
        return {t: x / length for t, x in made.items()}

    examples = {i: vector(text) for i, text, _ in rows}
    for text in [rows[0][1], rows[9][1], "vilest " + rows[2][1], "zzzz zzzz qqqq " + rows[5][1], words[0]]:
        own = vector(text)
        cosine = {i: sum(x * e.get(t, 0.0) for t, x in own.items()) for i, e in examples.items()}
        best = sorted(cosine, key=lambda i: -cosine[i])[: T.NEIGHBOURS]
        share, row, found = model.votes(*model.vector(text))
        assert np.allclose(found, [cosine[i] for i in best], atol=1e-6) and all(abs(cosine[int(model.ids[r])] - c) < 1e-6 for r, c in zip(row, found, strict=True))
        density = {t: 1.0 for t in (0, 1)}
        strength = [(density[rows[int(model.ids[r])][2]] * c / (1.05 - min(c, 1.0)), rows[int(model.ids[r])][2]) for r, c in zip(row, found, strict=True)]
        assert abs(share - (sum(s * t for s, t in strength) + prior) / (sum(s for s, _ in strength) + 1)) < 1e-6


def test_the_index_passes_the_driver_in_small_pieces(spark, monkeypatch):
    rows = [(i, f"you vile{i % 3} fool {i}" if i % 2 else f"kind word {i % 5} and more {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    whole = T.fit(docs, labels, F.lit(True))
    kept, write = {}, T.written
    monkeypatch.setattr(T, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(T, "PIECE", 64)
    cut = T.fit(docs, labels, F.lit(True))
    assert max(len(r.bytes) for r in kept["index"].collect()) <= 64
    assert cut.terms.equals(whole.terms) and (cut.idf == whole.idf).all() and (cut.ids == whole.ids).all()
    assert all((a == b).all() for a, b in zip(cut.lists, whole.lists, strict=True))
    assert (cut.slope, cut.shift) == (whole.slope, whole.shift)


def test_one_id_on_many_rows_stays_one_example(spark):
    rows = [(1, f"text number {i} of one id") for i in range(500)] + [(i, f"text of {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 60)], "doc_id bigint, quality int, toxic int")
    sample, total = T.labelled_sample(docs, labels, F.lit(True), 10)
    found = sample.collect()
    assert total == {0: 29, 1: 30} and sum(r.toxic for r in found) <= 10 and sum(1 - r.toxic for r in found) <= 10
    assert len({r.doc_id for r in found}) == len(found)
    every, _ = T.labelled_sample(docs, labels, F.lit(True), 1000)
    assert {r.doc_id: r.text for r in every.collect()}[1] == "text number 0 of one id"


def test_lists_of_every_length_find_the_exact_best_rows(monkeypatch):
    rng = np.random.default_rng(21)
    for long, block, hubs in ((1, 16, 0), (5, 64, 4), (40, 7, 4), (10_000, 64, 4)):
        for name, value in (("LONG", long), ("BLOCK_ROWS", block), ("HUBS", hubs)):
            monkeypatch.setattr(T, name, value)
        dense = np.where(rng.random((500, 80)) < rng.random(80) ** 4, rng.random((500, 80)), 0).astype(np.float32)
        term, row = np.nonzero(dense.T)
        known, sizes = np.unique(term, return_counts=True)
        index = T.Index(known.astype(np.int32), sizes, row.astype(np.int32), dense.T[term, row], 500, 90)
        asked = [np.sort(rng.choice(90, 20, replace=False)) for _ in range(30)]
        for (terms, weight), (found, worth) in zip(vectors := [(t, rng.random(len(t))) for t in asked], index.search(vectors, 15), strict=True):
            score = sum((dense[:, t].astype(float) * w for t, w in zip(terms, weight, strict=True) if t < 80), np.zeros(500))
            best = [r for r in np.argsort(-score, kind="stable") if score[r] > 0][:15]
            assert len(found) == len(best) and np.allclose(worth, score[best], atol=1e-5) and np.allclose(score[found], score[best], atol=1e-5)


def model_of(words, grams, rows=50):
    rng = np.random.default_rng(2)
    terms = sorted([*(f"={w}" for w in words), *grams])
    sizes = np.full(len(terms), 2)
    lists = (np.arange(len(terms), dtype=np.int32), sizes, np.tile(np.array([3, rows - 1], np.int32), len(terms)), np.full(2 * len(terms), 0.1, np.float32))
    none = np.zeros(rows)
    return T.Model(T.pa.array(terms), rng.random(len(terms)) + 0.5, lists, np.arange(rows), none, none, 0.1, 0.1)


def test_vectors_of_a_batch_by_definition(monkeypatch):
    monkeypatch.setattr(T, "WORDS", 3)
    model = model_of(["vile", "fool", "straße", "élan", "ab"], ["^vil", "ile$", "fool", "ßig$"])
    odd = "vile Vile, (FOOL)\x1cfoolish fool's a ab 12 v-ile ... ÉLAN élan! vileness lowßig StraSSe straße"
    texts = [odd, "", "  \n", "nothing known here", "12 a ...", odd + " " + odd, "x"]
    assert T.Model.vectors(model, []) == []
    found = model.vectors(texts)
    terms = model.terms.to_pylist()
    for text, (term, weight) in zip(texts, found, strict=True):
        counts, unseen = {}, 0.0
        for word in set(text.lower().split()):
            known, n = [terms.index(t) for t in T.terms_of(word) if t in terms], text.lower().split().count(word)
            for t in known:
                counts[t] = counts.get(t, 0) + n
            unseen += 0 if known else (1 + np.log(n)) ** 2
        made = {t: (1 + np.log(n)) * model.idf[t] for t, n in counts.items()}
        length = np.sqrt(sum(x * x for x in made.values()) + unseen * model.unseen**2)
        assert term.tolist() == sorted(made) and np.allclose(weight, [made[t] / length for t in sorted(made)], rtol=1e-12)
        alone = model.vector(text)
        assert alone[0].tolist() == term.tolist() and alone[1].tolist() == weight.tolist()


def test_a_word_is_looked_up_once_for_many_texts(monkeypatch):
    asked, look = [], T.bare_word
    monkeypatch.setattr(T, "bare_word", lambda word: asked.append(word) or look(word))
    model = model_of(["vile", "fool"], ["vile"])
    monkeypatch.setattr(T, "WORDS", 2)
    list(model.scores(["vile fool nice d'accord"] * 50, 1.0, 0.0))
    assert len(asked) <= 4


def test_memory_of_a_worker():
    """The index and the vectors of texts leave some bytes a posting and a term in a worker, no objects for every word."""
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'klmnopqrst'[i // 1000 % 10]}{'uvwxyz'[i // 10_000]}" for i in range(60_000)]
    model = model_of(words, ["vile"])
    texts = [" ".join(words[at : at + 600]) for at in range(0, 60_000, 600)]
    tracemalloc.start()
    list(model.scores(texts, 1.0, 0.0))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * len(words), held / len(words)


def test_long_texts_are_held_in_small_parts(monkeypatch):
    monkeypatch.setattr(T, "HELD_BYTES", 1000)
    texts = ["x" * n for n in (10, 400, 700, 5000, 3, 0)] + [None, "y" * 900, "z" * 200] + ["w"] * 1200
    batch = T.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": T.pa.array(texts, T.pa.string())})
    parts = [part.column("text").to_pylist() for part in T._held([batch])]
    assert [x for part in parts for x in part] == texts
    assert all(len(part) == 1 or sum(len(x or "") for x in part) <= 1000 for part in parts) and max(map(len, parts)) <= T.HELD <= 512
