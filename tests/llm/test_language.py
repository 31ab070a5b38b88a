import numpy as np
from pyspark import SparkContext
from pyspark.sql import functions as F

from corpusloom.llm import language as L
from corpusloom.llm.common import held_out


def test_spectrum_against_brute_force():
    letters = {ord(c): i + 1 for i, c in enumerate("abcé")}
    table = L.symbol_table(letters)
    for text in ["", "a", "ab", "Ab cé! b1", "日本 a", "zz\n\nab"]:
        flags = np.zeros(L.SPECTRUM, bool)
        L.spectrum(text, table, flags)
        symbols = [letters.get(ord(c), L.ALPHABET - 1 if c.isalpha() else 0) for c in text.lower()]
        grams = {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}
        assert flags.sum() == len(grams)


def test_kernel_is_the_normalised_intersection():
    texts = ["the cat sat", "the dog sat", "ein hund"]
    table = L.symbol_table({ord(c): i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")})
    rows = np.zeros((3, L.SPECTRUM), bool)
    for row, text in zip(rows, texts, strict=True):
        L.spectrum(text, table, row)
    features = np.flatnonzero(rows.any(0))
    model = L.Model([], {}, features, rows[:, features].astype(np.float32), np.sqrt(rows.sum(1)).astype(np.float32), np.eye(3, dtype=np.float32), np.zeros(3, np.float32))
    kernel = model.margins(rows, rows.sum(1))
    for i in range(3):
        for j in range(3):
            assert abs(kernel[i, j] - (rows[i] & rows[j]).sum() / np.sqrt(rows[i].sum() * rows[j].sum())) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    test = held_out(F.col("doc_id"), 5, 0)
    found = L.identify(docs, L.fit(docs, ~test)).join(docs.select("doc_id", "lang"), "doc_id").where(test)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98
    assert found.where("score < 0 or score > 1").isEmpty()


def test_odd_rows(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs, F.lit(True))
    found = L.identify(odd_docs, model).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3))
    assert by_id[6].lang_pred != "und" and by_id[9].lang_pred in model.languages
    kept = L.with_language(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (1, 2, 3)").isEmpty()


def test_nothing_to_learn_from(odd_docs, no_docs):
    model = L.fit(odd_docs, F.lit(True))  # every language is null
    assert model is None
    assert {r.lang_pred for r in L.identify(odd_docs, model).collect()} == {"und"}
    assert L.identify(no_docs, L.fit(no_docs, F.lit(True))).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    test = held_out(F.col("doc_id"), 5, 0)
    other = docs.withColumn("lang", F.when(test, "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, L.identify(d, L.fit(d, ~test)).collect())) for d in (docs, other))
    assert a == b


def test_rare_languages_get_their_share_of_the_sample(spark):
    sizes = {"aa": 20_000, "bb": 20_000, "cc": 20_000, "dd": 150, "ee": 7}
    docs = spark.range(sum(sizes.values())).selectExpr("id as doc_id", "concat('text ', id) as text", "array('aa', 'bb', 'cc', 'dd', 'ee')[cast(id >= 20000 as int) + cast(id >= 40000 as int) + cast(id >= 60000 as int) + cast(id >= 60150 as int)] as lang")
    again = docs.where("lang = 'dd' and doc_id % 2 = 0")  # copies take no other row's place
    counts = {r.lang: r["count"] for r in L.labelled_sample(docs.unionByName(again), F.lit(True), 100).groupBy("lang").count().collect()}
    assert counts == {"aa": 20, "bb": 20, "cc": 20, "dd": 20, "ee": 7}
    many = spark.range(600).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 300) as lang")
    assert L.labelled_sample(many, F.lit(True), 100).groupBy("lang").count().where("count = 1").count() == 300


def test_spectrum_of_all_letters_against_brute_force(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 4)
    letters = {ord(c): i + 1 for i, c in enumerate("abcé")}
    table = L.symbol_table(letters)
    for text in ["", "a", "Ab cé! b1", "日本 a日本", "zz\n\nab zyx", "жук 日 жжb a" * 3]:
        flags = np.zeros(L.SPECTRUM, bool)
        rare = L.whole_spectrum(text, table, flags)
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        grams = {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}
        assert flags.sum() == sum(all(c in "abcé " for c in gram) for gram in grams)
        assert len(rare) == len(set(rare.tolist())) == sum(any(c not in "abcé " for c in gram) for gram in grams)


def test_languages_whose_letters_are_not_among_the_most_frequent(spark):
    rng = np.random.default_rng(5)
    starts = {"zh": (0x4E00, 400), "ja": (0x6E00, 400), "ko": (0xAC00, 400), "am": (0x1200, 60), "en": (0x61, 26)}
    rows = []
    for number in range(500):
        lang, (first, count) = list(starts.items())[number % 5]
        length = 2000 if lang == "en" else 60
        points = first + np.minimum(rng.integers(0, count, length), rng.integers(0, count, length))
        rows.append((number, " ".join("".join(map(chr, points[i : i + 6])) for i in range(0, length, 6)), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = L.identify(docs, L.fit(docs, F.col("doc_id") < 400)).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id >= 400")
    assert found.where("lang = lang_pred").count() >= 98


def test_what_is_no_letter_is_no_text():
    """Numbers, fractions and signs are no letters, in whatever script."""
    texts = ["½ ² ① Ⅷ", "12 % €", "٣ ४", "_ -", "ª", "ß", "語"]
    assert [L.has_letter(t) for t in texts] == [False, False, False, False, True, True, True]


def test_rates_are_no_list_of_the_driver(spark, monkeypatch):
    rows = [(i, f"wort und satz {i}" if i % 2 else f"word and sentence {i}", "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")

    def refused(*_, **__):
        raise AssertionError("a list became an RDD, which has Python workers of its own")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert sorted(r.lang for r in L.labelled_sample(docs, F.lit(True), 10).collect()) == ["de"] * 5 + ["en"] * 5
    assert L.labelled_sample(docs.where("false"), F.lit(True), 10).count() == 0
