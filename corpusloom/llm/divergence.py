"""How the sources of a language differ in their words: a recount over minimal perfect hashes of the frequent terms.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z in lower case. The work is done in three steps.

1. *Exact frequency filter.* Tasks count, for each language, the documents that hold a term; Spark adds the counts. Terms of
   ``LEAST_DOCS`` documents or more are kept.
2. *Sharded minimal perfect hashes.* The kept terms of a language are dealt to shards of about ``SHARD_TERMS`` by a digest of the
   term. A task gives each term of a shard a slot of its own, without gaps: terms fall into small buckets, the larger buckets come
   first, and each is moved by the first number that sends all its terms to free slots. A shard stores its moves and its terms in slot order.
3. *Recount.* Shards are broadcast and the texts are read again. A term's slot is computed from its digest, and it counts only if the
   term stored there is the same, so a term that was not kept never counts. Tasks increment dense slots, an array for each
   (language, source); when the arrays of a task hold ``SLOTS`` numbers, what they counted leaves and they start again. A broadcast
   holds ``WAVE_BYTES`` at most, which is checked; more shards go out in several waves, each with a scan of its own.

The slots of one shard with all sources of its language are then compared in one task; sums over a language's shards give the values.
A hot source or language thus means more increments and more shards, not a larger group. A comparison of one shard holds (sources
of the language) times ``SHARD_TERMS`` numbers and gives a row for each two sources; since the result has a row for each ordered pair
of a language's sources anyway, it is larger than that.

For a group of N kept occurrences and a language of V kept terms, ``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))`` and two groups differ in a
term by ``floor((p - q)^2 / (p + q))``, in whole numbers throughout. Part ``pair`` ranks the other sources of the language by the sum over all kept
terms (0 without any), part ``term`` the ``TOP`` terms which a source has more of than its language. Ranks go by value, then by the
item's UTF-8 bytes.

Null text, lang and source count as empty text. Repeated rows count each; ids are not looked at. Texts of any length are read whole.
A group without terms has pairs but no terms; a single source has no pairs. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Texts, mix, text_blocks, written

LEAST_DOCS, TOP, SCALE = 10, 10, 10**9
SHARD_TERMS, BUCKET_TERMS = 1024, 3
#: Bytes of shards in one broadcast.
WAVE_BYTES = 64 << 20
#: Numbers that a task holds in dense slots, and rows of counted terms that it holds, before they leave; bound memory, not results.
SLOTS, HELD_ROWS = 1 << 22, 1 << 20
#: Pairs of a language and a term in a block that have a place of their own in a table; beyond, they are sorted.
TABLE = 1 << 22
#: Bytes of text that are cut into terms at once (a longer text is cut alone).
BLOCK = 4 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def terms_of(block: Texts) -> tuple[np.ndarray, pa.Array]:
    """The row of every term of a block, and the terms."""
    folded = Texts(_FOLD[block.data], block.offsets, block.first)
    row, start, end = folded.words()
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    data = folded.data[~SPACE[folded.data]]
    return row, pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def counted(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``code``, all below ``size``, and how often each occurs."""
    if size > TABLE:
        return np.unique(code, return_counts=True)
    n = np.bincount(code, minlength=size)
    found = np.flatnonzero(n)
    return found, n[found]


# --- the exact filter ------------------------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang``, ``term`` and the documents that hold it, over the rows of a task."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])

    for batch in batches:
        for block in text_blocks(batch.column("text"), limit=BLOCK):
            row, words = terms_of(block)
            if not len(row):
                continue
            index, known = _coded(words)
            lang, langs = _coded(batch.column("lang").slice(block.first, block.n))
            once = np.unique(row * len(known) + index)  # a document counts a term once
            code, n = counted(lang[once // len(known)] * len(known) + once % len(known), len(langs) * len(known))
            names, found = langs.take(pa.array(code // len(known))), known.take(pa.array(code % len(known)))
            held.append(pa.table({"lang": names.cast(pa.string()), "term": found.cast(pa.string()), "n": pa.array(n, pa.int64())}))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [merged()]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().combine_chunks().to_batches(1 << 16)
    if held:
        yield from merged().combine_chunks().to_batches(1 << 16)


# --- minimal perfect hashes ------------------------------------------------------------


def digests(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each term, from a digest that no two terms share."""
    found = b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in terms])
    both = np.frombuffer(found, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(one: np.ndarray, two: np.ndarray, shards) -> np.ndarray:
    return (mix(one + mix(two)) % np.asarray(shards).astype(np.uint64)).astype(np.int64)


def _buckets(one: np.ndarray, size) -> np.ndarray:
    return (one % (np.asarray(size) // BUCKET_TERMS + 1).astype(np.uint64)).astype(np.int64)


def _places(two: np.ndarray, move, size) -> np.ndarray:
    return (mix(two + np.asarray(move).astype(np.uint64) * _STEP) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def perfect_hash(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Moves of the buckets, and the slot of each term: all numbers below ``len(terms)``, each once.

    The only term of a bucket is sent straight to a free slot: its move is that slot, counted down from -1.
    """
    size = len(terms)
    one, two = digests(terms)
    bucket = _buckets(one, size)
    moves, slots, free = np.zeros(size // BUCKET_TERMS + 1, np.int64), np.full(size, -1), np.ones(size, bool)
    order = np.argsort(bucket, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if size else []
    for group in sorted((m for m in members if len(m) > 1), key=len, reverse=True):
        first = 1
        while True:
            tried = np.arange(first, first + 64)
            places = _places(two[group][None, :], tried[:, None], size)
            ordered = np.sort(places, axis=1)
            good = np.flatnonzero(free[places].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                break
            first += 64
        moves[bucket[group[0]]], slots[group] = tried[good[0]], places[good[0]]
        free[slots[group]] = False
    alone = [m[0] for m in members if len(m) == 1]
    left = np.flatnonzero(free)
    slots[alone], moves[bucket[alone]] = left, -left - 1
    return moves, slots


SHARDS = "lang string, shard int, shards int, size bigint, moves array<bigint>, terms array<string>"


def _with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = digests(batch.column("term").cast(pa.binary()).to_pylist())
        shard = shard_of(one, two, batch.column("shards").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])


def _build(table: pa.Table) -> pa.Table:
    """The perfect hash of one shard, as one row."""
    terms = table.column("term").cast(pa.binary()).to_pylist()
    moves, slots = perfect_hash(terms)
    stored = table.column("term").take(pa.array(np.argsort(slots))).to_pylist()
    size = sum(map(len, terms)) + 8 * len(terms) + 8 * len(moves)
    return pa.table(
        {
            "lang": table.column("lang").slice(0, 1),
            "shard": table.column("shard").slice(0, 1),
            "shards": table.column("shards").slice(0, 1),
            "size": pa.array([size], pa.int64()),
            "moves": pa.array([moves.tolist()], pa.list_(pa.int64())),
            "terms": pa.array([stored], pa.list_(pa.string())),
        }
    )


class Slots:
    """Shards as flat arrays; slots are numbered through, those of a language in a row."""

    def __init__(self, shards: pa.Table):
        shards = shards.sort_by([("lang", "ascending"), ("shard", "ascending")]).combine_chunks()
        self.shard = shards.column("shard").to_numpy()
        sizes = pc.list_value_length(shards.column("terms")).to_numpy().astype(np.int64)
        lengths = pc.list_value_length(shards.column("moves")).to_numpy().astype(np.int64)
        self.size, self.base = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.first_move = np.concatenate([[0], np.cumsum(lengths)])
        self.moves = np.asarray(pc.list_flatten(shards.column("moves")).to_numpy())
        stored = pc.list_flatten(shards.column("terms"))
        self.terms = (stored.combine_chunks() if isinstance(stored, pa.ChunkedArray) else stored).cast(pa.large_string())
        #: Of each language the row of every shard (-1: not here), and its slots' bounds.
        self.rows: dict[str, np.ndarray] = {}
        self.bounds: dict[str, tuple[int, int]] = {}
        for row, (lang, count) in enumerate(zip(shards.column("lang").to_pylist(), shards.column("shards").to_pylist(), strict=True)):
            self.rows.setdefault(lang, np.full(count, -1))[self.shard[row]] = row
            self.bounds[lang] = (self.bounds.get(lang, (int(self.base[row]),))[0], int(self.base[row + 1]))

    def find(self, lang: str, terms: pa.Array) -> np.ndarray:
        """The slot of every term, -1 for one that is not stored."""
        found = np.full(len(terms), -1)
        rows = self.rows.get(lang)
        if rows is None or not len(terms):
            return found
        one, two = digests(terms.cast(pa.large_binary()).to_pylist())
        row = rows[shard_of(one, two, len(rows))]
        at = np.flatnonzero(row >= 0)
        one, two, row = one[at], two[at], row[at]
        move = self.moves[self.first_move[row] + _buckets(one, self.size[row])]
        slot = self.base[row] + np.where(move < 0, -move - 1, _places(two, np.abs(move), self.size[row]))
        same = pc.equal(self.terms.take(pa.array(slot)), terms.take(pa.array(at))).to_numpy(zero_copy_only=False)
        found[at[same]] = slot[same]
        return found


# --- the recount -----------------------------------------------------------------------

CELLS = "lang string, source string, shard int, slot int, n bigint"


def _recount(shards: pa.Table, first_wave: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the stored terms by group; in the first wave also a row (shard -1) for every group."""
    slots, names = Slots(shards), [x.split()[0] for x in CELLS.split(", ")]
    dense: dict[tuple[str, str], np.ndarray] = {}
    groups: set[tuple[str, str]] = set()
    held = 0

    def leave() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in dense.items():
            at = np.flatnonzero(counts)
            slot = at + slots.bounds[lang][0]
            row = np.searchsorted(slots.base, slot, side="right") - 1
            for low in range(0, len(at), 1 << 16):
                part = slice(low, low + (1 << 16))
                n = len(at[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(slots.shard[row[part]], pa.int32()),
                        pa.array(slot[part] - slots.base[row[part]], pa.int32()), pa.array(counts[at[part]], pa.int64()),
                    ],
                    names,
                )
        dense.clear()

    for batch in batches:
        for block in text_blocks(batch.column("text"), limit=BLOCK):
            lang, langs = _coded(batch.column("lang").slice(block.first, block.n))
            source, sources = _coded(batch.column("source").slice(block.first, block.n))
            both, group = np.unique(lang * len(sources) + source, return_inverse=True)
            named = [(langs[int(g) // len(sources)].as_py(), sources[int(g) % len(sources)].as_py()) for g in both]
            groups.update(named)
            row, words = terms_of(block)
            if not len(row):
                continue
            index, known = _coded(words)
            code, size = lang[row] * len(known) + index, len(langs) * len(known)
            pair = counted(code, size)[0]
            slot, edge = np.empty(len(pair), np.int64), np.searchsorted(pair, np.arange(len(langs) + 1) * len(known))
            for number, name in enumerate(langs.to_pylist()):
                low, high = edge[number], edge[number + 1]
                slot[low:high] = slots.find(name, known.take(pa.array(pair[low:high] % len(known))))
            if size > TABLE:
                token = slot[np.searchsorted(pair, code)]
            else:
                table = np.full(size, -1)
                table[pair] = slot
                token = table[code]
            kept = token >= 0
            total = max(1, int(slots.base[-1]))
            code, n = np.unique(group[row[kept]] * total + token[kept], return_counts=True)
            for number, low, high in zip(range(len(both)), *(np.searchsorted(code, np.arange(len(both)) * total + x) for x in (0, total)), strict=True):
                if low == high:
                    continue
                key = named[number]
                start, stop = slots.bounds[key[0]]
                if key not in dense:
                    if held and held + stop - start > SLOTS:
                        yield from leave()
                        held = 0
                    dense[key] = np.zeros(stop - start, np.int64)
                    held += stop - start
                dense[key][code[low:high] - number * total - start] += n[low:high]
    yield from leave()
    if first_wave and groups:
        lang, source = (pa.array(x, pa.string()) for x in zip(*sorted(groups), strict=True))
        none = pa.array(np.full(len(groups), -1), pa.int32())
        yield pa.RecordBatch.from_arrays([lang, source, none, none, pa.array(np.zeros(len(groups), np.int64))], names)


def waves_of(shards: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``wave`` for each shard such that the shards of a wave hold ``limit`` bytes at most (or are one)."""
    total = shards.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // limit))
    while True:
        dealt = shards.withColumn("wave", F.pmod(F.xxhash64("lang", "shard"), F.lit(count)).cast("int"))
        most = dealt.groupBy("wave").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1").agg(F.max("size")).first()[0]
        if most is None or most <= limit:
            return dealt, count
        count *= 2


# --- the comparison --------------------------------------------------------------------


def probability(count: np.ndarray, total, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``; in two steps, so that counts up to 10^14 stay exact in 64 bits."""
    half = 31250
    below = np.maximum(np.asarray(total, np.int64) + 2 * terms, 1)
    high, rest = np.divmod((count + 2) * half, below)
    return 1 + high * (SCALE // half) + rest * (SCALE // half) // below


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


PARTS = "lang string, source string, item string, pair boolean, value bigint"


def _compare(table: pa.Table) -> pa.Table:
    """Every two sources over the terms of one shard, and each source's ``TOP`` terms of it."""
    kind = table.column("kind").to_numpy()
    take = lambda number: table.filter(pa.array(kind == number))
    groups, cells, stored = take(0), take(1), take(2)
    lang = groups.column("lang")[0].as_py()
    sources = groups.column("source").to_pylist()
    order = sorted(range(len(sources)), key=lambda i: sources[i].encode())
    sources = [sources[i] for i in order]
    totals = groups.column("n").to_numpy()[order]
    terms = int(groups.column("terms")[0].as_py())
    names = [b""] * stored.num_rows
    for slot, term in zip(stored.column("slot").to_pylist(), stored.column("term").to_pylist(), strict=True):
        names[slot] = term.encode()
    counts = np.zeros((len(sources), len(names)), np.int64)
    place = {source: i for i, source in enumerate(sources)}
    at = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
    counts[at, cells.column("slot").to_numpy()] = cells.column("n").to_numpy()
    own = probability(counts, totals[:, None], terms)
    whole = probability(counts.sum(axis=0), int(totals.sum()), terms)
    first, second, values = [], [], []
    for i in range(len(sources) - 1):
        values.append(difference(own[i + 1 :], own[i]).sum(axis=1))
        first.append(np.full(len(values[-1]), i))
        second.append(np.arange(i + 1, len(sources)))
    known = pa.array(sources, pa.string())
    picks = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (first, second)]
    pairs = pa.table(
        {
            "lang": pa.repeat(pa.scalar(lang, pa.string()), len(picks[0])),
            "source": known.take(picks[0]),
            "item": known.take(picks[1]),
            "pair": pa.repeat(True, len(picks[0])),
            "value": pa.array(np.concatenate([np.zeros(0, np.int64), *values]), pa.int64()),
        }
    )
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    rows: list[tuple] = []
    for i, source in enumerate(sources):
        more = np.flatnonzero((counts[i] > 0) & (own[i] > whole))
        gain = difference(own[i, more], whole[more])
        for j in np.lexsort((rank[more], -gain))[:TOP]:
            rows.append((lang, source, names[more[j]].decode(), False, int(gain[j])))
    return pa.concat_tables([pairs, pa.Table.from_pylist([dict(zip(pairs.schema.names, r, strict=True)) for r in rows], pairs.schema)])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank`` of all sources of ``docs`` (``text``, ``lang``, ``source``)."""
    spark = docs.sparkSession
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")])

    counted = rows.select("text", "lang").mapInArrow(_frequencies, "lang string, term string, n bigint")
    kept = written(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term"), "terms")
    sizes = written(kept.groupBy("lang").agg(F.count("*").alias("terms")), "sizes")  # a row a language
    shards_of = F.ceil(F.col("terms") / SHARD_TERMS).cast("int")
    dealt = kept.join(sizes, "lang").select("lang", "term", shards_of.alias("shards"))
    dealt = dealt.mapInArrow(_with_shard, "lang string, term string, shards int, shard int")
    shards = written(dealt.groupBy("lang", "shard").applyInArrow(_build, SHARDS), "shards")

    waves, count = waves_of(shards, wave_bytes)
    cells = None
    for wave in range(count):
        table = waves.where(F.col("wave") == wave).select("lang", "shard", "shards", "moves", "terms").toArrow()  # wave_bytes at most
        sent = spark.sparkContext.broadcast(table)
        recount = lambda batches, sent=sent, first=wave == 0: _recount(sent.value, first, batches)
        # a task sends a slot once (or once each time it starts again), so adding up before the exchange would find nothing to add
        dealt_out = rows.mapInArrow(recount, CELLS).repartition("lang", "source", "shard", "slot")
        found = dealt_out.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        found = written(found, "cells")
        sent.unpersist()
        cells = found if cells is None else cells.unionByName(found)

    no_text, no_number = F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("terms")
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    every_shard = F.explode(F.sequence(F.lit(0), F.greatest(shards_of, F.lit(1)) - 1)).alias("shard")
    groups = groups.select("lang", every_shard, F.lit(0).alias("kind"), "source", F.lit(None).cast("int").alias("slot"), "n", "terms", no_text)
    counts = cells.where("shard >= 0").select("lang", "shard", F.lit(1).alias("kind"), "source", "slot", "n", no_number, no_text)
    stored = shards.select("lang", "shard", F.posexplode("terms").alias("slot", "term"))
    stored = stored.select("lang", "shard", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("source"), "slot", F.lit(None).cast("bigint").alias("n"), no_number, "term")
    parts = written(groups.unionByName(counts).unionByName(stored).groupBy("lang", "shard").applyInArrow(_compare, PARTS), "parts")

    pairs = parts.where("pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    within = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(within).cast("int")
    pair_rows = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    best = parts.where(~F.col("pair")).withColumn("rank", place).where(F.col("rank") <= TOP)
    return pair_rows.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
