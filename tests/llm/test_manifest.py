import zlib
from hashlib import sha256

import pytest

from corpusloom.llm import manifest

LOWER = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """What remains, and of each node the siblings before and after it at every level."""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            low = p // 16 * 16
            paths[i].append((nodes[low:p], nodes[p + 1 : low + 16]))
            place[i] = p // 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: climb([leaf(r, r[1]) for r in groups[s]]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for source, top in zip(order, tops, strict=True):
        for row, path in zip(groups[source], trees[source][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            fold = leaf(row, row[1].translate(LOWER) if hit and row[1] is not None else row[1])
            for before, after in path + top:
                fold = h(*before, fold, *after)
            proof = h(*[x for before, after in path + top for x in before + after])
            out.append((row[0], leaf(row, row[1]), trees[source][0], root, proof, fold, fold == root))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def found(spark, rows, more=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in more:
        docs = docs.withColumn(name, docs.doc_id)
    return sorted([tuple(r) for r in manifest.audit(docs).collect()], key=str)


def made(count, source, first=0):
    return [(first + i, f"Text NUMBER {i} É", "en", source, i) for i in range(count)]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, "a"),
        made(16, "a"),
        made(17, "a"),
        made(300, "a") + made(1, "b", 1000) + made(40, None, 2000) + made(16, "", 3000),
        [row for s in range(40) for row in made(1 + s % 3, f"s{s}", 100 * s)],
        [(None, None, None, None, None), (None, "X", None, None, 3), (7, "Same", "en", "a", 4), (7, "Same", "en", "a", 4), (7, "Other", "fr", "é", 5), (-5, "", "", "", 0)]
        + [(5, "Long WORD " * 20_000, "en", "a", 1)],
    ],
    ids=["one", "a run", "two runs", "four sources", "many sources", "odd"],
)
def test_equals_brute_force(spark, rows):
    result = found(spark, rows, ("key", "n", "place", "leaf", "row", "forged", "node", "root"))
    assert result == brute(rows)


def test_nodes_above_a_block_stand_once_for_each(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_HEIGHT", 2)  # blocks of sixteen runs: nodes above them are copied
    rows = made(600, "hot") + made(20, "b", 1000) + made(3, "c", 2000)
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark, no_docs):
    assert manifest.audit(no_docs).collect() == []


def test_what_was_changed_is_found(spark):
    rows = made(100, "a")
    verified = {r[0]: r[-1] for r in found(spark, rows)}
    assert {i for i, ok in verified.items() if not ok} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    quiet = [(i, text.lower().replace("é", "e"), *rest) for i, text, *rest in rows]
    assert all(r[-1] for r in found(spark, quiet))  # lower-casing changes nothing there


def test_the_limit_of_recursion_rows_is_restored(spark):
    setting = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(setting, "7")
    try:
        rows = made(200, "a") + made(200, "b", 500)
        assert len(found(spark, rows)) == 400  # more than seven climbers
        assert spark.conf.get(setting) == "7"
    finally:
        spark.conf.unset(setting)
