from collections import Counter

from corpusloom.llm import repetition as R


def brute(text, words):
    found = words(text, lower=False)
    covered = {}
    for size in dict.fromkeys((R.BASE_WINDOW, *R.WINDOW_LIMITS)):
        grams = [tuple(found[i : i + size]) for i in range(len(found) - size + 1)]
        count = Counter(grams)
        covered[size] = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(size)}
    chars = sum(map(len, found))
    lines = Counter(line for line in (text or "").split("\n") if words(line))
    dup_chars = sum(n * sum(map(len, words(line, lower=False))) for line, n in lines.items() if n > 1)
    by_size = [sum(len(found[i]) for i in covered[size]) for size in R.WINDOW_LIMITS]
    failed = len(found) < 10 or 100 * len(covered[5]) > 20 * len(found)
    bad = 100 * dup_chars > R.LINE_LIMIT * chars or any(100 * c > R.WINDOW_LIMITS[s] * chars for s, c in zip(R.WINDOW_LIMITS, by_size, strict=True))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(found), chars, symbols, sum(n - 1 for n in lines.values()), len(covered[5]), dup_chars, by_size, failed, not failed and not bad)


def test_against_brute_force(spark, odd_docs, words):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd_docs.unionByName(given, allowMissingColumns=True)
    expected = sorted((str(r.doc_id), *map(str, brute(r.text, words))) for r in docs.select("doc_id", "text").collect())
    found = sorted(tuple(map(str, r)) for r in R.repetition_rules(docs).collect())
    assert found == expected


def test_blocks_do_not_change_results(odd_docs, monkeypatch):
    from corpusloom.llm import common

    whole = sorted(map(str, R.repetition_rules(odd_docs).collect()))
    monkeypatch.setattr(common.text_blocks, "__defaults__", (False, 10))
    import pyarrow as pa

    column = pa.array([r.text for r in odd_docs.select("text").collect()])
    assert sum(b.n for b in common.text_blocks(column)) == len(column)
    assert len(whole) == len(column)


def test_no_rows(no_docs):
    assert R.repetition_rules(no_docs).collect() == []
