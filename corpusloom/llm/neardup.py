"""Near duplicates by a chosen-path set similarity join over word shingles.

A document's set holds its distinct word shingles. Documents with equal sets form a class; one row stands for each
class. Every class gets a sketch of minwise tokens. In each of several independent trees a node holds the classes that
agree in the tokens chosen on the path to it; a node chooses one or two tokens to branch by, 1 / threshold on average, so
that a pair at the threshold is expected to stay together on one path at every depth. Nodes with few classes are
compared exhaustively; the others branch on. The trees repeat until the target recall.

Groups of thousands of near copies would keep nodes large at every depth and give pairs without number. So a first pass
makes few links: the classes of a large node to the few pivots that they are similar to, and each class of a small node to the
most similar one behind it; the components of these links are confirmed first. The second pass drops nodes whose classes
all belong to one component; in the others every pair of different components is compared on the full sets, in place.

Candidates have passed the size bound and a comparison of one-bit sketches; every link is then confirmed on the full sets.
The result is one row per document, with the smallest id of its component.

Documents without words (null and empty ones too) have an empty set and are linked with nothing. A text with fewer words
than a shingle is one shingle. Rows with the same id are judged each by its text. A null id is never a component.
Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Texts, give_back, mix, small_batches, text_blocks, written
from .components import components

SHINGLE = 5
#: Similarity in percent from which documents are linked.
THRESHOLD = 75
TREES, TOKENS = 12, 8
#: Depth after which a large node is compared block by block, classes of a block, and classes up to which a node is compared at once:
#: as many comparisons of sketches cost less than the rows by which such a node would branch on.
DEPTH, BLOCK, SMALL = 5, 256, 2048
#: Numbers of the matrix that holds a slice of a group's shingles.
MATRIX = 1 << 22
#: Classes of a large node, chosen by chance, that all others are compared with.
PIVOTS = 8
#: Minwise functions; each tree uses ``TOKENS`` of them, the sketch one bit of all.
FUNCTIONS = 128
#: Bytes of texts whose shingles are made at once (a longer text is handled alone): some forty bytes of arrays for a byte.
SHINGLED_BYTES = 512 << 10
#: Ids (8 bytes each) up to which the texts to confirm are picked by a broadcast instead of a shuffle.
BROADCAST_IDS = 1_000_000

_A = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, FUNCTIONS + 1001, dtype=np.uint64))


def least_matches(threshold: int = THRESHOLD) -> int:
    """Equal sketch bits from which a pair is confirmed: four standard deviations below what the threshold gives."""
    p = (1 + threshold / 100) / 2
    return math.floor(FUNCTIONS * (p - 4 * math.sqrt(p * (1 - p) / FUNCTIONS)))


def shingles(block: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of every row, by row."""
    row, start, end = block.words()
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = Rolling(block.hashes(start, end))
    count = np.bincount(row, minlength=block.n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    rows = np.concatenate([row[at], short])
    keys = np.concatenate([rolled.slices(at, at + size), rolled.slices(first[short], first[short] + count[short])])
    _, found = np.unique(mix(keys + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)
    order = found[np.argsort(rows[found], kind="stable")]
    return rows[order], keys[order]


SKETCH = "doc_id bigint, n bigint, h0 bigint, h1 bigint, b0 bigint, b1 bigint, tokens binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, fingerprint of the set, one-bit sketch and the trees' tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for block in text_blocks(batch.column("text"), lower=True, limit=SHINGLED_BYTES):
                row, key = shingles(block)
                n = np.bincount(row, minlength=block.n)
                full = np.flatnonzero(n)
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64)
                h = np.zeros((2, block.n), np.uint64)
                low = np.zeros((FUNCTIONS, len(full)), np.uint32)
                if len(full):
                    h[0, full] = np.add.reduceat(mix(key ^ _B[0]), starts)
                    h[1, full] = np.add.reduceat(mix(key ^ _B[1]), starts)
                    for j in range(FUNCTIONS):
                        low[j] = np.minimum.reduceat(((key * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
                bits = np.packbits((low ^ (low >> 7) ^ (low >> 15)) & 1, axis=0).astype(np.uint8)
                two = np.zeros((2, block.n), np.int64)
                if len(full):
                    two[:, full] = np.ascontiguousarray(bits.T).view(np.int64).reshape(len(full), 2).T
                tokens = [None] * block.n
                packed = np.ascontiguousarray(low[: TREES * TOKENS].T)
                for i, at in enumerate(full.tolist()):
                    tokens[at] = packed[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.n), pa.array(n.astype(np.int64)),
                        pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(two[0]), pa.array(two[1]),
                        pa.array(tokens, pa.binary()),
                    ],
                    ["doc_id", "n", "h0", "h1", "b0", "b1", "tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def _token(own: Column, index: int) -> Column:
    return F.substring(own, 4 * index + 1, 4)


def _branch(rows: DataFrame, node: Column, level: int) -> DataFrame:
    """Children: by the level's own token, and in one node of three by a second one."""
    own = F.col("own")
    keys = F.array(F.xxhash64(node, F.lit(level), _token(own, level)))
    if TOKENS - 1 - level > DEPTH - 1:
        also = F.array(F.xxhash64(node, F.lit(level), F.lit("second"), _token(own, TOKENS - 1 - level)))
        keys = F.when(F.pmod(F.xxhash64(node, F.lit(level)), F.lit(3)) == 0, F.concat(keys, also)).otherwise(keys)
    return rows.withColumn("node", F.explode(keys))


def _roots(classes: DataFrame) -> DataFrame:
    """Nodes of the first level in all trees."""
    trees = classes.withColumn("tree", F.explode(F.array(*(F.lit(t) for t in range(TREES)))))
    width = 4 * TOKENS
    trees = trees.withColumn("own", F.expr(f"substring(tokens, tree * {width} + 1, {width})")).drop("tokens")
    return _branch(trees, F.xxhash64(F.lit("root"), "tree"), 0).drop("tree")


def _alike(b0: Column, b1: Column, c0: Column, c1: Column, n: Column, m: Column, threshold: int) -> Column:
    equal = FUNCTIONS - F.bit_count(b0.bitwiseXOR(c0)) - F.bit_count(b1.bitwiseXOR(c1))
    return (equal >= least_matches(threshold)) & (100 * F.least(n, m) >= threshold * F.greatest(n, m))


def _star_links(classes: DataFrame, threshold: int) -> list[DataFrame]:
    """Few links that hold most groups together: at most ``PIVOTS`` per class, node and level.

    In a large node every class is compared with the node's pivots, and those like one leave the tree; in a small one every
    class is linked with the one behind it that is most like it.
    """
    links, rows = [], _roots(classes)
    chance = F.xxhash64("rep", F.pmod("node", F.lit(3)))  # three sets of pivots, so that most classes are like one
    for level in range(DEPTH):
        member = F.struct(chance.alias("h"), F.col("rep"), F.col("n"), F.col("b0"), F.col("b1"))
        firsts = [F.min(F.when(F.pmod(chance, F.lit(PIVOTS)) == i, member)).alias(f"p{i}") for i in range(PIVOTS)]
        nodes = rows.groupBy("node").agg(F.count("*").alias("c"), *firsts).where("c > 1")
        pivots = F.when(F.col("c") > SMALL, F.array_compact(F.array(*(f"p{i}" for i in range(PIVOTS)))))
        found = rows.join(nodes.select("node", "c", pivots.alias("pivots")), "node")
        alike = F.filter("pivots", lambda p: _alike(F.col("b0"), F.col("b1"), p["b0"], p["b1"], F.col("n"), p["n"], threshold))
        seen = written(found.withColumn("near", F.transform(alike, lambda p: p["rep"])).drop("pivots"), "stars")
        small = seen.where(F.col("c") <= SMALL).withColumn("label", F.col("rep")).withColumn("side", F.lit(0))
        links.append(_nearest_pairs(small, "node", threshold))
        large = seen.where(F.col("c") > SMALL)
        links.append(large.select(F.col("rep").alias("a"), F.explode("near").alias("b")).where("a <> b"))
        if level + 1 == DEPTH or large.isEmpty():
            break
        alone = F.size(F.array_remove("near", F.col("rep"))) == 0
        rows = written(_branch(large.where(alone).drop("c", "near"), F.col("node"), level + 1), "branches")  # read twice
    return links


_MEMBER = "rep", "label", "n", "b0", "b1"


def _candidates(part: dict[str, np.ndarray], threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every row of a group the later rows it may be linked with, and in how many sketch bits they differ.

    Rows of one label are never candidates; rows with ``side`` 1 and 2 are compared with each other only.
    """
    most = FUNCTIONS - least_matches(threshold)
    for i in range(len(part["rep"]) - 1):
        rest = slice(i + 1, None)
        ok = part["label"][rest] != part["label"][i]
        if part["side"][i]:
            ok &= part["side"][rest] != part["side"][i]
        n, m = part["n"][rest], part["n"][i]
        ok &= 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
        if ok.any():
            differ = np.bitwise_count(part["b0"][rest] ^ part["b0"][i]) + np.bitwise_count(part["b1"][rest] ^ part["b1"][i])
            hit = np.flatnonzero(ok & (differ <= most))
            if len(hit):
                yield i, hit + i + 1, differ[hit]


def _groups(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The lists of every row of a batch as arrays; sketches without sign, whose bits can be counted."""
    ends = batch.column("rep").offsets.to_numpy()
    flat = {c: batch.column(c).values.to_numpy() for c in (*_MEMBER, "side")}
    flat |= {c: flat[c].view(np.uint64) for c in ("b0", "b1")}
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        yield {c: v[low:high] for c, v in flat.items()}


def _lists(rows: DataFrame, key: str) -> DataFrame:
    fields = (*_MEMBER, "side")
    return rows.groupBy(F.col(key).alias("key")).agg(*(F.collect_list(c).alias(c) for c in fields)).select("key", *fields)


def _nearest_pairs(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    """In groups of bounded size, a pair of each row with the most similar one behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            for part in _groups(batch):
                rep = part["rep"]
                pairs += [(int(rep[i]), int(rep[hit[differ.argmin()]])) for i, hit, differ in _candidates(part, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

    return _lists(rows, key).mapInArrow(run, "a bigint, b bigint")


MEMBERS = "key bigint, rep bigint, label bigint, side int"


def _members(rows: DataFrame, key: str, threshold: int) -> DataFrame:
    """In groups of bounded size, the rows that may be linked with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], {c: [] for c in ("rep", "label", "side")}
            for key, part in zip(batch.column("key").to_pylist(), _groups(batch), strict=True):
                flags = np.zeros(len(part["rep"]), bool)
                for i, hit, _ in _candidates(part, threshold):
                    flags[i] = flags[hit] = True
                keys += [key] * int(flags.sum())
                for c, found in kept.items():
                    found.append(part[c][flags])
            columns = [np.concatenate(found) if found else np.zeros(0, np.int64) for found in kept.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *(pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32), strict=True))],
                ["key", "rep", "label", "side"],
            )

    return _lists(rows, key).mapInArrow(run, MEMBERS)


def _leaf_members(classes: DataFrame, threshold: int) -> list[DataFrame]:
    """From all leaves, the classes that may be linked with one of another label, by leaf."""
    found, rows = [], _roots(classes)
    for level in range(DEPTH):
        stats = rows.groupBy("node").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        live = written(rows.join(stats.where("c > 1 and lo < hi").select("node", "c"), "node"), "nodes")
        found.append(_members(live.where(F.col("c") <= SMALL).withColumn("side", F.lit(0)), "node", threshold))
        large = live.where(F.col("c") > SMALL)
        if large.isEmpty():
            return found
        if level + 1 < DEPTH:
            rows = written(_branch(large.drop("c"), F.col("node"), level + 1), "branches")  # read twice
    # what is still large: blocks of about BLOCK classes, every pair of blocks compared in a group of its own
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep", "node"), blocks).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = dealt.withColumn("key", F.xxhash64("node", low, high)).withColumn(
        "side", F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)
    )
    return [*found, _members(dealt, "key", threshold)]


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of the given ids (one column ``doc_id``) as a written table."""
    ids = written(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").where("text is not null")
    return written(found.distinct(), "texts")


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The shingles of every text of a column."""
    made: list[np.ndarray] = []
    for block in text_blocks(column, lower=True, limit=SHINGLED_BYTES):
        row, key = shingles(block)
        made.extend(np.split(key, np.cumsum(np.bincount(row, minlength=block.n))[:-1]))
    return made


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(x) + len(y) - both)


def _confirmed_members(members: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links between members of one group and of different labels, by their full sets.

    All pairs of a group, which is bounded, are compared; as many links come out as join its labels.
    """
    members = written(members, "members")
    texts = _texts(members.select(F.col("rep").alias("doc_id")), docs)

    def run(table: pa.Table) -> pa.Table:
        rep, label, side = (table.column(c).to_numpy() for c in ("rep", "label", "side"))
        sets = _sets(table.column("text"))
        size = np.array([len(x) for x in sets])
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        width = max(1, min(len(every), 1 << 14, MATRIX // len(sets)))
        holds = np.zeros((len(sets), width), np.float32)
        both = np.zeros((len(sets), len(sets)), np.float32 if size.max() < 1 << 24 else np.float64)  # exact
        row = np.repeat(np.arange(len(sets)), size)
        for low in range(0, len(every), width):  # a slice of the shingles at a time
            holds[:] = 0
            mine = (at >= low) & (at < low + width)
            holds[row[mine], at[mine] - low] = 1
            both += holds @ holds.T
        head = {int(x): int(x) for x in label}

        def root(x: int) -> int:
            while head[x] != x:
                x = head[x]
            return x

        links = []
        for i in range(len(sets) - 1):
            rest = slice(i + 1, None)
            common = both[i, rest].astype(np.int64)
            linked = (common > 0) & (100 * common >= threshold * (size[i] + size[rest] - common))
            linked &= (label[rest] != label[i]) & ((side[i] == 0) | (side[rest] != side[i]))
            for j in (np.flatnonzero(linked) + i + 1).tolist():
                one, two = root(int(label[i])), root(int(label[j]))
                if one != two:
                    head[two] = one
                    links.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    joined = members.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return joined.groupBy("key").applyInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = written(pairs.distinct(), "pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = zip(_sets(part.column("text_a")), _sets(part.column("text_b")), strict=True)
                part = part.filter(pa.array([_linked(x, y, threshold) for x, y in sets], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs`` (``doc_id``, ``text``)."""
    small_batches(docs.sparkSession)
    sketch = written(sketches(docs), "sketches")
    key = ["h0", "h1", "n"]
    classes = sketch.where("n > 0 and doc_id is not null").groupBy(*key)
    classes = classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("b0", "b1", "tokens")))
    classes = written(classes, "classes")
    shown = classes.select("rep", "n", "b0", "b1", "tokens")
    first = written(_confirmed(_union(_star_links(shown, threshold)), docs, threshold), "links")
    label = components(first).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    labelled = shown.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = _union(_leaf_members(written(labelled, "labelled"), threshold))
    second = _confirmed_members(members, docs, threshold)
    every = components(first.unionByName(second)).select(F.col("node").alias("rep"), "component")
    # only classes with copies or links can have another component than their own document
    known = classes.select(*key, "rep", "copies").join(every, "rep", "left")
    known = known.where("copies > 1 or component is not null").select(*key, F.coalesce("component", "rep").alias("component"))
    found = sketch.select("doc_id", *key).join(known, key, "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The whole rows of ``docs`` that are kept; rows without an id always are."""
    gone = written(near_duplicates(docs, threshold).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
