"""Exact BM25 top-k search with a sharded inverted index and block-max pruning.

A task turns its rows into shards: the rows of a shard stand in an order that puts similar texts together, and its
postings (term, row, count) go to a written table, one row per shard. Document counts of the queries' terms are added up
over all shards in buckets of the hash space, so every shard scores with the same global statistics (number of rows,
average length, document counts). Queries are taken in batches of bounded size, and in a batch in groups of similar ones. A batch
is sent to all shards, a few of them first: the k-th best score that they give a query is where the others start from. A shard
searches a whole group at once, block by block, with dynamic pruning; its best rows are exact, and the shards' answers are merged.

Scores are sums of whole millionths: ``count in the query * round(10^6 idf tf (K1 + 1) / (tf + K1 (1 - B + B length / average)))``
with ``idf = ln(1 + (N - n + 0.5) / (n + 0.5))``. So every order of adding gives the same score, and ties are ties. Ties go to
the smaller id (null first).

Terms are lower-cased (A-Z) words. Null and empty texts are rows without terms: they count, and are never found. Repeated
rows are found each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blockmax import BlockMaxIndex, Group, ranges
from .common import Texts, deltas, give_back, mix, pack, small_batches, text_blocks, unpack, written

K1, B = 1.2, 0.75
TOP = 10
#: Bytes of text in a shard (one text at least), rows in a block of the index, bytes per bucket of terms, about.
SHARD_BYTES, BLOCK_ROWS, BUCKET_BYTES = 14 << 20, 4096, 8 << 20
#: Bytes of text that are cut into words at once.
PART_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 32
_ODD = 0x9E3779B97F4A7C15
#: Bytes of packed queries that are sent to the shards at once.
QUERY_BYTES = 32 << 20
#: Queries that are searched together, and different terms of all of them (one query at least).
GROUP_QUERIES, GROUP_TERMS = 512, 1 << 19
#: A round of the search has so many times the shards of the rounds before; the first has that many at least.
ROUND = 8


def _hashes(block: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: its bytes in steps of eight, each scrambled with what came before; of long words as they are."""
    data = np.append(block.data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(block.data) + 1, "<u8", data, strides=(1,))  # the eight bytes from every position on
    size = end - start
    found = size.astype(np.uint64) * np.uint64(_ODD)
    for step in range(0, LONG_WORD, 8):
        at = np.flatnonzero(size > step) if step else slice(None)
        if step and not len(at):
            break
        unused = np.maximum(8 - (size[at] - step), 0).astype(np.uint64) * np.uint64(8)
        found[at] = mix(found[at] ^ (eight[start[at] + step] << unused))
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        found[long] = block.hashes(start[long], end[long])
    return found


def _postings(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and count of every distinct word of every row, by term and row; words per row."""
    row, start, end = block.words()
    terms, term = np.unique(_hashes(block, start, end), return_inverse=True)
    both = np.sort(term * block.n + row)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    term, row_of = np.divmod(both[at], block.n)
    return terms[term], row_of, np.diff(np.append(at, len(both))), np.bincount(row, minlength=block.n)


def _similar_order(term: np.ndarray, row: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows with the same most frequent word together, by length."""
    most = np.zeros(len(length), count.dtype)
    np.maximum.at(most, row, count)
    last = np.flatnonzero(count == most[row])
    lead = np.zeros(len(length), np.uint64)
    np.maximum.at(lead, row[last], term[last].astype(np.uint64))
    return np.lexsort((length, lead))


SHARDS = "kind int, bucket int, terms binary, counts binary, ids binary, lengths binary, sizes binary, rows binary, n bigint, words bigint"
_NAMES = [x.split()[0] for x in SHARDS.split(", ")]
_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64()]


def _raw_ids(ids: pa.Array) -> np.ndarray:
    return np.concatenate([ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64), ids.fill_null(0).to_numpy().view(np.uint64)])


def _by_bucket(terms: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    bucket = (terms >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(terms), np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(terms)]])
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if high > low:
            yield int(bucket[low]), low, high


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        columns = zip(*rows[at : at + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _shards(docs: DataFrame, bits: int) -> DataFrame:
    """Kind 0: a shard; kind 1: document counts of its terms in one bucket."""

    def shard(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0, *(len(p[3]) for p in parts)])
        term, count, length = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
        row = np.concatenate([p[1] + n for p, n in zip(parts, before, strict=False)])
        ids = pa.concat_arrays([p[4] for p in parts])
        parts.clear()
        order = _similar_order(term, row, count, length)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, term = np.unique(term, return_inverse=True)
        found = np.bincount(term, minlength=len(terms))
        again = np.argsort(term * len(order) + place[row])
        row, count = place[row][again], count[again]
        raw = _raw_ids(ids.take(pa.array(order)))
        rows: list[tuple] = [
            (0, -1, pack(deltas(terms)), pack(count), pack(raw), pack(length[order]), pack(found), pack(row), len(order), int(length.sum()))
        ]
        for bucket, low, high in _by_bucket(terms, bits):
            rows.append((1, bucket, pack(deltas(terms[low:high])), pack(found[low:high]), *[None] * 4, 0, 0))
        yield from _emit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], SHARD_BYTES
        for batch in batches:
            for block in text_blocks(batch.column("text"), lower=True, limit=min(PART_BYTES, SHARD_BYTES)):
                if parts and len(block.data) > room:
                    yield from shard(parts)
                    room = SHARD_BYTES
                parts.append((*_postings(block), batch.column("doc_id").slice(block.first, block.n)))
                room -= len(block.data)
        if parts:
            yield from shard(parts)

    return docs.select("doc_id", "text").mapInArrow(run, SHARDS)


QUERIES = "part bigint, bucket int, terms binary, counts binary, ids binary, sizes binary"


def _query_parts(queries: DataFrame, bits: int) -> DataFrame:
    """Queries in parts of bounded size; and, per bucket, the terms whose document counts a part needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        names, kinds = [x.split()[0] for x in QUERIES.split(", ")], [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            for block in text_blocks(batch.column("text"), lower=True, limit=PART_BYTES):
                term, row, count, _ = _postings(block)
                order = np.lexsort((term, row))
                ids = batch.column("doc_id").slice(block.first, block.n)
                sizes = np.bincount(row, minlength=block.n)
                rows = [(part, -1, pack(term[order]), pack(count[order]), pack(ids.to_numpy().view(np.uint64)), pack(sizes))]
                asked = np.unique(term)
                for bucket, low, high in _by_bucket(asked, bits):
                    rows.append((part, bucket, pack(deltas(asked[low:high])), None, None, None))
                part += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return queries.select("doc_id", "text").mapInArrow(run, QUERIES)


def _document_counts(have: pa.Table, ask: pa.Table) -> pa.Table:
    """Over all shards, the document counts of the terms that each part of the queries asks for in one bucket."""
    empty = [np.zeros(0, np.uint64)]
    terms = np.concatenate([np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in have.column("terms")] or empty)
    found = np.concatenate([unpack(x.as_py()) for x in have.column("counts")] or empty)
    every, at = np.unique(terms, return_inverse=True)
    total = np.bincount(at, weights=found.astype(np.float64), minlength=len(every)).astype(np.uint64)
    rows = []
    for part, asked in zip(ask.column("part").to_pylist(), ask.column("terms"), strict=True):
        wanted = np.cumsum(unpack(asked.as_py()), dtype=np.uint64)
        spot = np.minimum(np.searchsorted(every, wanted), max(0, len(every) - 1))
        counts = np.where(every[spot] == wanted, total[spot], 0) if len(every) else np.zeros(len(wanted), np.uint64)
        rows.append((part, asked.as_py(), pack(counts)))
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table({"part": pa.array(columns[0], pa.int64()), "terms": pa.array(columns[1], pa.binary()), "found": pa.array(columns[2], pa.binary())})


def impacts(count: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """The part of a score that depends on the row, before the document count's weight."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


def idf(found: np.ndarray, rows: int) -> np.ndarray:
    return np.log(1 + (rows - found + 0.5) / (found + 0.5))


def shard_index(row: dict, terms: np.ndarray, found: np.ndarray, rows: int, average: float) -> tuple[BlockMaxIndex, np.ndarray, np.ndarray]:
    """One shard's index of the terms that the queries hold, by their place in ``terms``; its rows' ids, and which are null."""
    own = np.cumsum(unpack(row["terms"]), dtype=np.uint64)
    sizes, length = unpack(row["sizes"]).astype(np.int64), unpack(row["lengths"]).astype(np.float64)
    raw = unpack(row["ids"])
    at = np.minimum(np.searchsorted(terms, own), max(0, len(terms) - 1))
    used = np.flatnonzero(terms[at] == own) if len(terms) else np.zeros(0, np.int64)  # terms of no query are left out
    first = np.cumsum(sizes) - sizes
    posting = ranges(first[used], sizes[used])
    posting_row, count = (unpack(row[c]).view(np.int64)[posting] for c in ("rows", "counts"))
    del posting
    weight = idf(found[at[used]].astype(np.float64), rows)
    part = impacts(count, length[posting_row], average)
    impact = np.round(1e6 * np.repeat(weight, sizes[used]) * part)
    del count, part
    index = BlockMaxIndex(np.repeat(at[used], sizes[used]), posting_row, impact, int(row["n"]), BLOCK_ROWS)
    return index, raw[row["n"] :].view(np.int64), raw[: row["n"]].astype(bool)


class Best:
    """The ``k`` best rows so far of every query, by score and then id (null first)."""

    def __init__(self, floor: np.ndarray, k: int):
        """Rows below ``floor`` don't count."""
        self.k, self.least = k, floor.astype(np.float64)
        self.query, self.id, self.null, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
        self.new: list[tuple] = []

    def add(self, query: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        self.new.append((query, ids, null, score))

    def merge(self) -> None:
        touched = np.zeros(len(self.least), bool)
        for query, *_ in self.new:
            touched[query] = True
        held, again = (self.query, self.id, self.null, self.score), touched[self.query]
        query, ids, null, score = (np.concatenate(x) for x in zip(tuple(x[again] for x in held), *self.new, strict=True))
        self.new = []
        order = np.lexsort((ids, ~null, -score, query))
        query, ids, null, score = query[order], ids[order], null[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last, best = place == self.k - 1, place < self.k
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        found = (x[best] for x in (query, ids, null, score))
        self.query, self.id, self.null, self.score = (np.concatenate([x[~again], y]) for x, y in zip(held, found, strict=True))


RESULT = "query bigint, query_id bigint, doc_id bigint, total bigint"


def _answers(shards: DataFrame, sent: Broadcast, floor: np.ndarray, rows: int, average: float, k: int) -> DataFrame:
    """The best ``k`` rows of every task for every query of the batch that ``sent`` holds, none with a score below ``floor``."""
    floors = shards.sparkSession.sparkContext.broadcast(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        queries = sent.value
        best = Best(floors.value, k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                index, ids, null = shard_index(row, queries["terms"], queries["found"], rows, average)
                for block in index.block_views(len(queries["terms"])):
                    for first, group in queries["groups"]:
                        query, hit, score = block.search(group, best.least[first : first + group.n], k)
                        if len(query):
                            best.add(query + first, ids[hit], null[hit], score)
                    if best.new:
                        best.merge()
        low, high = (np.searchsorted(queries["as"], best.query, side=side) for side in ("left", "right"))
        query, of = ranges(low, high - low), np.repeat(np.arange(len(best.query)), high - low)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query + queries["first"]),
                pa.array(queries["ids"][query]),
                pa.array(best.id[of], mask=best.null[of]),
                pa.array(best.score[of].astype(np.int64)),
            ],
            ["query", "query_id", "doc_id", "total"],
        )

    return shards.select("terms", "counts", "ids", "lengths", "sizes", "rows", "n").mapInArrow(run, RESULT)


def _groups(query: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, Group]]]:
    """An order of ``n`` queries that puts similar ones together, and groups of them with the number of their first."""
    order = _similar_order(term, query, count, np.bincount(query, weights=count, minlength=n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    query = place[query]
    again = np.lexsort((term, query))
    query, term, count = query[again], term[again], count[again]
    edge = np.searchsorted(query, np.arange(n + 1))
    groups, low = [], 0
    while low < n:
        high = int(np.searchsorted(edge, edge[low] + GROUP_TERMS, side="right")) - 1
        high = min(n, low + GROUP_QUERIES, max(low + 1, high))
        part = slice(edge[low], edge[high])
        groups.append((low, Group(query[part] - low, term[part], count[part], high - low)))
        low = high
    return order, groups


def _batches(parts: DataFrame, counts: DataFrame) -> Iterator[dict]:
    """Queries in groups, and their terms' document counts, in batches of at most QUERY_BYTES packed bytes (one part at least).

    ``ids`` has every query, ``as`` the number that it has in the groups, in this order.
    """
    size = F.sum(F.length("terms") + F.coalesce(F.length("counts"), F.lit(0)))
    sized = parts.groupBy("part").agg(size.alias("bytes")).orderBy("part")
    taken: list[list[int]] = []
    room = 0
    for part, size in sized.toLocalIterator():  # two numbers a part
        if not taken or size > room:
            taken.append([])
            room = QUERY_BYTES
        taken[-1].append(part)
        room -= size
    first = 0
    for some in taken:
        low, high = some[0], some[-1]
        known = counts.where(f"part between {low} and {high}").select("terms", "found").collect()
        pairs = [(np.cumsum(unpack(r.terms), dtype=np.uint64), unpack(r.found)) for r in known]
        del known
        terms, at = np.unique(np.concatenate([t for t, _ in pairs] or [np.zeros(0, np.uint64)]), return_index=True)
        found = np.concatenate([f for _, f in pairs] or [np.zeros(0, np.uint64)])[at]
        del pairs, at
        ids, as_, query, term, count = [], [], [], [], []
        seen: dict[bytes, int] = {}
        for row in parts.where(f"bucket = -1 and part between {low} and {high}").select("terms", "counts", "ids", "sizes").collect():
            sizes, own, times = unpack(row.sizes).astype(np.int64), unpack(row.terms), unpack(row.counts).astype(np.int64)
            end = np.cumsum(sizes)
            for q, start, stop in zip(unpack(row.ids).view(np.int64).tolist(), (end - sizes).tolist(), end.tolist(), strict=True):
                if start == stop:
                    continue
                new = len(seen)
                number = seen.setdefault(blake2b(own[start:stop].tobytes() + times[start:stop].tobytes()).digest(), new)
                ids.append(q)
                as_.append(number)
                if number == new:  # queries with the same words are searched once
                    query.append(np.full(stop - start, number, np.int32))
                    term.append(np.searchsorted(terms, own[start:stop]).astype(np.int32))
                    count.append(times[start:stop])
        if not ids:
            continue
        order, groups = _groups(np.concatenate(query), np.concatenate(term), np.concatenate(count), len(seen))
        place = np.empty(len(seen), np.int64)
        place[order] = np.arange(len(seen))
        as_ = place[np.array(as_)]
        by = np.argsort(as_, kind="stable")
        yield {"terms": terms, "found": found, "groups": groups, "ids": np.array(ids)[by], "as": as_[by], "first": first, "n": len(seen)}
        first += len(ids)


def _rounds(table: DataFrame, shards: int) -> Iterator[DataFrame]:
    """All shards, some files of them after the other: few first, then ROUND times as many as before."""
    lot = F.crc32(F.encode(F.col("_metadata.file_name"), "UTF-8"))
    edges = [0, 1]
    while shards // (edges[-1] * ROUND) >= ROUND:
        edges.append(edges[-1] * ROUND)
    share = F.pmod(lot, F.lit(edges[-1]))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield table.where((F.col("kind") == 0) & (share >= low) & (share < high))


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("total"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order))


def search(docs: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best rows of ``docs`` (``doc_id``, ``text``) for every row
    that ``is_query`` selects (rows without an id are no queries; rows that repeat an id are one query each by its text)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // BUCKET_BYTES).bit_length())
    table = written(_shards(docs, bits), "shards")
    rows, words, shards = (int(x or 0) for x in table.agg(F.sum("n"), F.sum("words"), F.count_if(F.col("kind") == 0)).first())
    average = max(words / max(rows, 1), 1e-9)
    queries = docs.select("doc_id", "text").where(is_query & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    parts = written(_query_parts(queries, bits), "queries")
    have = table.where("kind = 1").select("bucket", "terms", "counts").groupBy("bucket")
    ask = parts.where("bucket >= 0").select("bucket", "part", "terms").groupBy("bucket")
    counts = written(have.cogroup(ask).applyInArrow(_document_counts, "part bigint, terms binary, found binary"), "counts")
    found = None
    for batch in _batches(parts, counts):
        sent, floor = docs.sparkSession.sparkContext.broadcast(batch), np.zeros(batch["n"])  # at most QUERY_BYTES packed, or one part of it
        own = None
        for some in _rounds(table, shards):
            if own is not None:
                for query, total in _ranked(own).where(F.col("rank") == k).select("query", "total").collect():
                    floor[batch["as"][query - batch["first"]]] = total
            part = written(_answers(some, sent, floor, rows, average, k), "answers")
            own = part if own is None else own.unionByName(part)
        sent.destroy()
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], RESULT)
    return _ranked(found).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", (F.col("total") / F.lit(1e6)).alias("score"))
