"""Rules as data: the anchor index against fnmatch, and repositories with rules of their own."""

import random
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rule_table
from corpusloom.operators.repositories import decide_repositories
from corpusloom.operators.rule_table import anchors_of, decide_by_table, index_rules, literal_parts, rule_matches
from corpusloom.sources.rules import DEFAULT_PATTERNS, parse_rules


def brute(paths, rules):
    return {(path, kind, pattern) for path in paths for kind, pattern in rules if path is not None and pattern is not None and fnmatchcase(path, pattern)}


def matches(spark, paths, rules):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    index = index_rules(spark.createDataFrame(rules, "kind string, pattern string"))
    found = [tuple(r) for r in rule_matches(files, index).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_literal_parts():
    assert literal_parts("a*b?c") == ["a", "b", "c"]
    assert literal_parts("a[!]x]b") == ["a", "b"]
    assert literal_parts("a[b") == ["a[b"]
    assert literal_parts("*") == ["", ""]
    assert literal_parts("[ab]") == ["", ""]


def test_anchors():
    assert anchors_of("a/b.txt") == (True, [("exact", "a/b.txt")])
    assert anchors_of("docs/*") == (True, [("head", "docs/")])
    assert anchors_of("*.pyc") == (True, [("tail", ".pyc")])
    assert anchors_of("*") == (True, [])
    assert anchors_of("a?") == (False, [("head", "a")])
    assert anchors_of("*word?*") == (False, [("inner", "word")])
    assert anchors_of("*abc*") == (False, [])  # shorter than a gram


def test_random_patterns_against_fnmatch(spark):
    random.seed(7)
    parts = ["a", "b", "/", "*", "?", "[ab]", "[!a]", "[", "]", "docs", ".py", "é", "\n", "x-", "!"]
    patterns = {"".join(random.choices(parts, k=random.randint(1, 6))) for _ in range(1500)}
    paths = {"".join(random.choices(["a", "b", "/", "docs", ".py", "é", "\n", "x-", "[", "]", "!"], k=random.randint(1, 6))) for _ in range(400)}
    rules = [(random.choice(["ignore", "override"]), p) for p in patterns]
    expected = brute(paths, rules)
    assert len(expected) > 1000
    assert matches(spark, [*paths, *paths], rules) == expected


def test_bare_patterns_both_ways(spark, monkeypatch):
    paths, rules = ["a", "ab", "abc", "x/y", ""], [("ignore", p) for p in ("*", "?", "??", "[a-c]*", "*b*", "")]
    one = matches(spark, paths, rules)
    monkeypatch.setattr(rule_table, "BARE_PATTERNS", 2)
    monkeypatch.setattr(rule_table, "SALTS", 3)
    assert one == matches(spark, paths, rules) == brute(paths, rules)


def test_rarest_anchor_is_taken(spark):
    rules = [("ignore", f"*/name{i}/*.txt") for i in range(50)] + [("ignore", "*.txt")]
    index = index_rules(spark.createDataFrame(rules, "kind string, pattern string")).collect()
    kinds = {r.pattern: (r.anchor, r.key) for r in index}
    assert kinds["*.txt"] == ("tail", ".txt")
    assert all(anchor == "inner" for pattern, (anchor, _) in kinds.items() if pattern != "*.txt")  # fifty share the ending


def test_no_rules_no_paths_and_nulls(spark):
    assert matches(spark, ["a", None], [("ignore", None)]) == set()
    assert matches(spark, [], [("ignore", "a*")]) == set()
    files = spark.createDataFrame([("a",), (None,)], "path string")
    empty = spark.createDataFrame([], "kind string, pattern string")
    decided = decide_by_table(files, empty, F.lit("text")).collect()
    assert [(r.path, r.decision) for r in decided] == [("a", "kept"), (None, "kept")] or {r.decision for r in decided} == {"kept"}


def test_no_nested_loop_and_scoped_rules(spark):
    files = spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo"), F.concat(F.lit("src/f"), F.col("id").cast("string")).alias("path"))
    rules = [("r0", "ignore", "src/*7"), ("r1", "ignore", "src/f1*"), ("r1", "override", "*f1?"), ("r2", "ignore", "?"), ("r0", "ignore", "*[0-2]*")]
    table = spark.createDataFrame(rules, "repo string, kind string, pattern string")
    found = rule_matches(files, index_rules(table, ["repo"]), ["repo"])
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    expected = {(f"r{i % 3}", f"src/f{i}", kind, p) for i in range(3000) for repo, kind, p in rules if repo == f"r{i % 3}" and fnmatchcase(f"src/f{i}", p)}
    assert {tuple(r) for r in found.collect()} == expected


def test_hot_anchor_spreads(spark):
    """All paths and a thousand rules share an ending; the rules are told apart by what is rare."""
    files = spark.range(20_000).select(F.concat(F.lit("src/module"), (F.col("id") % 1000).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    rules = spark.range(1000).select(F.lit("ignore").alias("kind"), F.concat(F.lit("*/module"), F.format_string("%04d", F.col("id")), F.lit("/*.py")).alias("pattern"))
    index = index_rules(rules)
    assert index.where("key = '.py'").count() == 0
    assert index.groupBy("anchor", "key").count().agg(F.max("count")).first()[0] <= 112  # of a thousand; no gram tells more
    assert rule_matches(files, index).count() == 0  # no module has leading zeros but 0000
    few = rules.limit(0).unionAll(spark.createDataFrame([("ignore", "*/module12/*.py"), ("ignore", "*.py")], "kind string, pattern string"))
    assert rule_matches(files, index_rules(few)).groupBy("pattern").count().orderBy("count").collect()[0]["count"] == 20


def test_many_rules_are_not_broadcast(spark, monkeypatch):
    """Twelve thousand rules in a small file: the join is sorted, and rules that fours of characters do not tell apart are."""
    names = [f"*/alpha/doc{i * 77:06d}.*" for i in range(12_000)]
    rules = spark.createDataFrame([("ignore", name) for name in names] + [("override", "*.txt")], "kind string, pattern string")
    paths = [f"x/alpha/doc{i:06d}.txt" for i in range(0, 924_000, 1_540)]
    files = spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1)
    index = index_rules(rules)
    assert index.groupBy("anchor", "key").count().agg(F.max("count")).first()[0] <= 20
    expected = {(p, "ignore", names[i * 20]) for i, p in enumerate(paths)} | {(p, "override", "*.txt") for p in paths}
    monkeypatch.setattr(rule_table, "TASK_KEYS", 2000, raising=False)  # every path ends with .txt: dealt over shares
    found = rule_matches(files, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


LINES = {"a": ["*.txt", "!keep*", "docs/*"], "b": ["# nothing", "", "src/[ab]*.py", "!*.pyc"], "c": [f"gen{i}/*" for i in range(30)] + ["!gen7/x"]}
PATHS = ["x.txt", "keep.txt", "docs/a.md", "src/a1.py", "src/c.py", "m.pyc", "gen7/x", "gen7/y", "venv/a", "plain.md"]


def decision(repo, path):
    lines = [x for x in LINES.get(repo, []) if x and x[0] != "#"]
    if any(fnmatchcase(path, x[1:]) for x in lines if x[0] == "!"):
        return "override"
    return "ignored" if any(fnmatchcase(path, x) for x in [*DEFAULT_PATTERNS, *(x for x in lines if x[0] != "!")]) else "kept"


@pytest.mark.parametrize("row_rules", [500, 10])
def test_repositories_keep_their_own_rules(spark, row_rules):
    rows = [(repo, path) for repo in ("a", "b", "c", "d", None) for path in PATHS]
    files = spark.createDataFrame(rows, "repository string, path string")
    lines = spark.createDataFrame([(repo, line) for repo in LINES for line in LINES[repo]] + [(None, "*")], "repository string, value string")
    rules = parse_rules(lines.where("repository is not null"), by=["repository"])
    decided = decide_repositories(files, rules, F.when(F.col("path") == "plain.md", "binary").otherwise("text"), row_rules=row_rules)
    found = {(r.repository, r.path): r.decision for r in decided.collect()}
    assert found == {(repo, path): "binary" if path == "plain.md" else decision(repo, path) for repo, path in rows}
