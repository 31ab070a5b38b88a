"""Paths against rules that are data: a table of ``fnmatch`` patterns of any length, matched by an index of anchors.

A pattern can only match a path that holds its literal parts. Each pattern is filed under one of them, its anchor:

* ``exact``: a pattern without wildcards is the path;
* ``head``: what stands before the first wildcard is how the path begins;
* ``tail``: what stands after the last one is how the path ends;
* ``inner``: 4, 8 or 16 (``GRAMS``) characters in a row of a literal part stand somewhere in the path.

Of the anchors a pattern offers, the one that fewest patterns offer is taken, the longest of those, so that an ending that
thousands of patterns share is passed over for what tells them apart. Offers are counted in a table of fixed size by their hashes,
where a rare anchor may count for more than it is; no anchor is shuffled. A path has one key for itself, one for each length of head and
of tail in use, and its grams of the lengths in use. Paths and patterns meet by equality of these keys: few patterns are broadcast; many
meet the keys in a join whose tasks follow the number of both, and in which keys that very many paths have are dealt over several shares.
The pattern's regular expression then decides, unless the anchor itself says all (``docs/*``, ``*.pyc``).

Patterns without a literal part have no key. Up to ``BARE_PATTERNS`` of them become one predicate; more are met by salted keys, with
the same rows.

With ``scope`` columns (a repository) patterns apply only to paths of the same scope; keys then hold the scope.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import WILD, fnmatch_any, fnmatch_regex
from ..session import stage, task_count

#: Characters of an inner anchor; the longer ones tell apart what very many rules share by fours.
GRAMS = 4, 8, 16
#: Counters of offered anchors (8 bytes each on the driver and in a task), by hash.
COUNTERS = 1 << 20
#: Rules that are broadcast; Spark would go by the size of the staged file, which says little of what it holds.
BROADCAST_RULES = 10_000
#: Keys of paths, and rules, that a task of the join takes; a key of more than an eighth of that many paths is dealt over shares.
TASK_KEYS = 500_000
#: Counters of the keys of paths, by hash.
KEY_COUNTERS = 1 << 16
#: Patterns without any literal part that become a predicate; their number is the number of alternatives evaluated for each path.
BARE_PATTERNS = 200
#: Copies of a pattern without a literal part beyond that, each met by one share of the paths.
SALTS = 64

_INDEXED = "regex string, sure boolean, anchor string, key string"


def literal_parts(pattern: str) -> list[str]:
    """What stands before, between and after the wildcards of an ``fnmatch`` pattern; ``[`` without an end is itself."""
    parts, at = [""], 0
    while at < len(pattern):
        ch = pattern[at]
        at += 1
        if ch == "[":
            first = at + (pattern[at : at + 1] == "!")
            close = pattern.find("]", first + 1) if first < len(pattern) else -1
            if close >= 0:
                at = close + 1
                parts.append("")
                continue
        elif ch in WILD:
            parts.append("")
            continue
        parts[-1] += ch
    return parts


def anchors_of(pattern: str) -> tuple[bool, list[tuple[str, str]]]:
    """Whether an anchor alone decides, and the anchors that the pattern offers."""
    parts = literal_parts(pattern)
    if len(parts) == 1:
        return True, [("exact", parts[0])]
    head, tail = parts[0], parts[-1]
    if len(parts) == 2 and "*" in (pattern[len(head) :], pattern[: len(pattern) - len(tail)]):  # docs/*, *.pyc
        found = [("head", head)] if head else [("tail", tail)]
        return True, [(kind, key) for kind, key in found if key]
    found = [("head", head), ("tail", tail)]
    found += [("inner", part[at : at + n]) for n in GRAMS for part in parts for at in range(len(part) - n + 1)]
    return False, list(dict.fromkeys((kind, key) for kind, key in found if key))


def _distinct(rows: DataFrame) -> DataFrame:
    """The distinct rows as a staged table; dealt first, by their number, so that no task holds the rows of a whole file."""
    rows = stage(rows)
    return stage(rows.repartition(task_count(rows.sparkSession, rows.count(), TASK_KEYS), *rows.columns).distinct())


def _counter(anchor: tuple[str, str]) -> int:
    return zlib.crc32("\0".join(anchor).encode()) % COUNTERS


def _offers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many patterns offer an anchor of each counter."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        offered = [_counter(anchor) for pattern in batch["pattern"] for anchor in anchors_of(pattern)[1]]
        np.add.at(total, np.array(offered, np.int64), 1)
    used = np.flatnonzero(total)
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pd.DataFrame({"counter": part, "n": total[part]})


def index_rules(rules: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct rules (``scope``, ``kind``, ``pattern``) with ``regex``, ``sure``, ``anchor`` and ``key``, as a staged table.

    Null patterns are no rules. Rules without an anchor have a null one. The only row-wise Python is this translation of patterns.
    """
    scope = scope or []
    names = _distinct(rules.select(*scope, "kind", "pattern").where("pattern is not null"))
    spark = rules.sparkSession
    counted = names.select("pattern").mapInPandas(_offers, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    sharers = np.zeros(COUNTERS, np.int64)  # the driver holds these counters, however many rules there are
    sharers[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    known = spark.sparkContext.broadcast(sharers)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            described = []
            for pattern in batch["pattern"]:
                sure, found = anchors_of(pattern)
                best = min(found, key=lambda a: (known.value[_counter(a)], -len(a[1]), a), default=(None, None))
                described.append((fnmatch_regex(pattern), sure, *best))
            yield pd.concat([batch, pd.DataFrame(described, batch.index, ["regex", "sure", "anchor", "key"])], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema)
    return stage(names.mapInPandas(describe, f"{fields}, {_INDEXED}"))


def _lengths(index: DataFrame, anchor: str) -> list[int]:
    """The lengths in use; no more than the characters of the longest pattern."""
    rows = index.where(F.col("anchor") == anchor).select(F.length("key").alias("n")).distinct().collect()
    return sorted(row.n for row in rows)


def path_keys(path: Column, heads: list[int], tails: list[int], exact: bool, grams: list[int]) -> Column:
    """The keys under which a path looks for patterns: an array of ``anchor`` and ``key``."""

    def keys(anchor: str, values: Column) -> Column:
        return F.transform(values, lambda key: F.struct(F.lit(anchor).alias("anchor"), key.alias("key")))

    length = F.length(path)
    found = [keys("exact", F.array(path))] if exact else []

    def fitting(lengths: list[int]) -> Column:
        return F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= length)

    if heads:
        found.append(keys("head", F.transform(fitting(heads), lambda n: F.left(path, n))))
    if tails:
        found.append(keys("tail", F.transform(fitting(tails), lambda n: F.right(path, n))))

    def inner(n: int) -> Column:
        starts = F.when(length >= n, F.sequence(F.lit(1), length - n + 1)).otherwise(F.array().cast("array<int>"))
        return keys("inner", F.array_distinct(F.transform(starts, lambda at: F.substr(path, at, F.lit(n)))))

    found += [inner(n) for n in grams]
    return F.concat(*found)


def _met(looking: DataFrame, index: DataFrame, on: list[str], path: str) -> DataFrame:
    """Rows of both sides with equal keys; the tasks follow the number of rows, and keys of very many paths are dealt over shares."""
    rules = index.count()
    if rules <= BROADCAST_RULES:
        return looking.join(F.broadcast(index), on)
    spark, counter, many = looking.sparkSession, F.pmod(F.xxhash64(*on), F.lit(KEY_COUNTERS)), TASK_KEYS // 8
    counted = {row.c: row["count"] for row in looking.groupBy(counter.alias("c")).count().collect()}  # KEY_COUNTERS rows at most
    hot = [c for c, n in counted.items() if n > many]
    shares = -(-max(counted.values(), default=0) // many)
    tasks = task_count(spark, sum(counted.values()) + rules, TASK_KEYS)
    is_hot = counter.isin(hot) if hot else F.lit(False)
    dealt = looking.withColumn("_share", F.when(is_hot, F.pmod(F.xxhash64(path), F.lit(shares)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(max(shares - 1, 0)))).otherwise(F.array(F.lit(0)))
    copied, by = index.withColumn("_share", F.explode(copies)), [*on, "_share"]
    return dealt.repartition(tasks, *by).join(copied.repartition(tasks, *by).hint("merge"), by)


def rule_matches(files: DataFrame, index: DataFrame, scope: list[str] | None = None, path: str = "path") -> DataFrame:
    """``(scope, path, kind, pattern)``: every distinct path with every pattern that it matches, each pair once."""
    scope = scope or []
    paths = _distinct(files.select(*scope, path).where(F.col(path).isNotNull()))
    kinds = {row.anchor for row in index.select("anchor").distinct().collect()}  # five at most
    found = []
    if kinds - {None}:
        keys = path_keys(F.col(path), _lengths(index, "head"), _lengths(index, "tail"), "exact" in kinds, _lengths(index, "inner"))
        looking = paths.select(*scope, path, F.explode(keys).alias("k")).select(*scope, path, "k.anchor", "k.key")
        met = _met(looking, index.where("anchor is not null"), [*scope, "anchor", "key"], path)
        found.append(met.where(F.col("sure") | F.rlike(F.col(path), F.col("regex"))))
    if None in kinds:
        bare = index.where("anchor is null").drop("anchor", "key")
        if not scope and bare.count() <= BARE_PATTERNS:
            rows = bare.collect()
            each = [F.when(fnmatch_any(F.col(path), [r.pattern]), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.pattern).alias("pattern"))) for r in rows]
            met = paths.select(path, F.explode(F.array_compact(F.array(*each))).alias("r")).select(path, "r.kind", "r.pattern")
            found.append(met)
        else:
            salted = bare.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = paths.withColumn("_salt", F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int")).join(salted, [*scope, "_salt"])
            found.append(met.where(F.rlike(F.col(path), F.col("regex"))))
    if not found:
        return paths.join(index.select(*scope, "kind", "pattern"), scope).where(F.lit(False)) if scope else paths.withColumns(
            {"kind": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string")}
        ).where(F.lit(False))
    columns = [*scope, path, "kind", "pattern"]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in found])


def match_rules(files: DataFrame, rules: DataFrame, scope: list[str] | None = None, path: str = "path") -> DataFrame:
    """Add ``ignore_rules`` and ``override_rules`` to each file: how many distinct patterns of either kind it matches.

    ``rules`` has ``kind`` (``ignore`` or ``override``) and ``pattern``. Files with a null path match nothing.
    """
    scope = scope or []
    matches = rule_matches(files, index_rules(rules, scope), scope, path)
    counts = matches.groupBy(*scope, path).agg(
        F.count_if(F.col("kind") == "ignore").alias("ignore_rules"), F.count_if(F.col("kind") == "override").alias("override_rules")
    )
    joined = files.join(counts, [*scope, path], "left")
    none = {name: F.coalesce(name, F.lit(0).cast("bigint")) for name in ("ignore_rules", "override_rules")}
    return joined.select(*files.columns, "ignore_rules", "override_rules").withColumns(none)


def decide_by_table(files: DataFrame, rules: DataFrame, kind: Column, scope: list[str] | None = None, path: str = "path") -> DataFrame:
    """``ignore.decide`` with the rules in a table: adds ``decision``."""
    matched = match_rules(files.withColumn("_kind", kind), rules, scope, path)
    decision = (
        F.when(F.col("_kind") == "binary", "binary")
        .when(F.col("override_rules") > 0, "override")
        .when(F.col("ignore_rules") > 0, "ignored")
        .otherwise("kept")
    )
    return matched.withColumn("decision", decision).drop("_kind", "ignore_rules", "override_rules")
