import random
import tracemalloc

import pyarrow as pa
from pyspark import SparkContext

from corpusloom.llm import neardup as N
from corpusloom.llm import packing
from corpusloom.llm.common import text_blocks
from corpusloom.llm.components import components
from corpusloom.llm.queries import tokenizer_path


def sets(text, words):
    found = words(text)
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} or ({tuple(found)} if found else set())


def brute(rows, words):
    made = [sets(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for i, s in enumerate(made):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for members in by_shingle.values():
        for j in members[1:]:
            for i in members:
                if i < j and root(i) != root(j):
                    both = len(made[i] & made[j])
                    if 100 * both >= 75 * len(made[i] | made[j]):
                        parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(str((d, len(s), c := least.get(root(i)) if d is not None else None, d is not None and d == c)) for i, ((d, _), s) in enumerate(zip(rows, made, strict=True)))


def check(docs, words):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in N.near_duplicates(docs).collect()) == brute(rows, words)


def vary(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_given_documents(spark, words):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), words)


def test_odd_rows(odd_docs, no_docs, words):
    rows = [tuple(r) for r in odd_docs.where("doc_id is not null").select("doc_id", "text").collect()]
    found = N.near_duplicates(odd_docs)
    known = found.where("doc_id is not null").collect()
    assert sorted(str(tuple(r)) for r in known) == brute(rows, words)
    assert all(r.component_id is None and not r.kept for r in found.where("doc_id is null").collect())
    kept = N.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null").count() == 2
    assert N.near_duplicates(no_docs).collect() == []


def test_large_groups_of_near_copies_and_common_passages(spark, words):
    """More members than a node may hold, chains, strangers that share a passage, and a second group close to the first."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    shared = [f"common{i}" for i in range(30)]
    texts = [vary(rng, base, 1) for _ in range(150)] + [" ".join(base)] * 20
    texts += [" ".join(shared + [f"own{j}_{i}" for i in range(40)]) for j in range(120)]
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # each link is near its neighbours only
        texts.append(" ".join(chain[step * 4 :] + [f"tail{i}" for i in range(step * 4)]))
    other = base[:80] + [f"z{i}" for i in range(40)]
    texts += [vary(rng, other, 1) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    check(docs, words)


def test_large_mixed_nodes_are_compared_block_by_block(spark, words, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "DEPTH", 1)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [vary(rng, base, rng.randrange(0, 6)) for _ in range(60)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words)


def test_pairs_of_blocks_of_a_large_mixed_node(spark, words, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "MATRIX", 64)
    monkeypatch.setattr(N, "DEPTH", 1)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [vary(rng, base, rng.randrange(0, 6)) for _ in range(60)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words)


def test_nodes_of_a_common_line_do_not_branch(spark, words, monkeypatch):
    """Hundreds of strangers that share a line, beside a loose group of near copies, are compared where they stand."""
    levels, branch = [], N._branch
    monkeypatch.setattr(N, "_branch", lambda rows, node, level: levels.append(level) or branch(rows, node, level))
    rng = random.Random(7)
    line, base = [f"line{i}" for i in range(9)], [f"w{i}" for i in range(60)]
    texts = [" ".join(line + [f"own{j}_{i}" for i in range(6)]) for j in range(700)]
    texts += [vary(rng, base, rng.randrange(0, 4)) for _ in range(300)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), words)
    assert not any(levels)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, each alone: the trees find nearly all of them."""
    rng = random.Random(7)
    rows = []
    for pair in range(300):
        base = [f"p{pair}w{i}" for i in range(104)]  # 100 shingles
        near = list(base)
        near[40], near[70] = f"x{pair}", f"y{pair}"  # 10 of them changed: 90 / 110
        near[100] = f"v{pair}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(near))]
    rng.shuffle(rows)
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found.where("not kept").count() >= 299


def test_sketch_sizes():
    block = next(text_blocks(pa.array(["a b c d e f a b c d e f", None, "a b", ""]), lower=True))
    row, key = N.shingles(block)
    assert row.tolist().count(0) == 6 and row.tolist().count(2) == 1 and len(set(key.tolist())) == 7
    assert 90 <= N.least_matches() <= 100


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(200, 201), (201, 200), (300, 300)]
    edges += [(a, b) for a, b in ((rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(40))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    expected = sorted((x, root(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges))
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, found)) == expected


class Inner:
    """Stands in for a DataFrame and keeps the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_a_worker_holds_the_arrays_of_few_texts_at_once():
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(500)) for _ in range(1400)]  # 4 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": texts})
    run = N.sketches(Inner()).run
    whole = [row for part in run(iter([batch])) for row in part.to_pylist()]
    alone = [row for at in range(0, len(texts), 100) for part in run(iter([batch.slice(at, 100)])) for row in part.to_pylist()]
    assert whole == alone
    sets = N._sets(batch.column("text"))
    assert [len(x) for x in sets] == [row["n"] for row in whole]
    for step in (lambda: [len(part) for part in run(iter([batch]))], lambda: N._sets(batch.column("text"))):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 45e6, peak


def test_no_step_starts_workers_for_a_list_of_the_driver(spark, monkeypatch, words):
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(20)], "doc_id bigint, text string")

    def refused(*_, **__):
        raise AssertionError("a list became an RDD, which has Python workers of its own")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    check(docs, words)


def test_a_worker_drops_what_other_steps_keep():
    path = tokenizer_path("word_bpe_49k.json")
    first = packing.token_ids("some words", path)
    packing._begin()
    assert packing._LOADED  # its own step keeps it
    list(N.sketches(Inner()).run(iter([])))
    assert not packing._LOADED
    assert packing.token_ids("some words", path) == first
