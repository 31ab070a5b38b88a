"""Language-model scores from a weighted backoff automaton over n-grams of the whole corpus.

States are the contexts (up to ``order - 1`` tokens) seen in training. An arc for a seen continuation weighs
``log10((c(context, token) + KAPPA * p) / (c(context) + KAPPA))``, where p is the probability one state further down; the
failure arc to the context without its first token weighs ``log10(KAPPA / (c(context) + KAPPA))``, and unseen contexts fail at
no cost. The lowest state holds ``(c(token) + 1) / (N + V + 1)``. Every state's weights are a distribution (a Dirichlet prior
around the next lower state). A text is read once, left to right, from the begin state to the end token.

The automaton grows with the corpus, so no task holds all of it. Texts are cut into chunks of whole rows; a chunk sends the
sorted hashes of its distinct n-grams, with its own counts, to buckets of the hash space. A bucket adds the counts of all
chunks and answers every chunk with the totals in the order asked. With these each chunk builds the part of the automaton that
its own texts can reach, which gives the same scores as the whole. All steps go through written tables, so lost executors
cost a step and nothing more, and both sides of an answer keep one order.

Tokens are lower-cased (A-Z) words and one end per text. Null texts count as empty: the end token alone. Repeated rows count
each; a null id counts as training. Without training texts every base probability is 1. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deltas, mix, pack, text_blocks, unpack, written

ORDER, KAPPA = 2, 40.0
#: Bytes of text in a chunk and, about, per bucket of the hash space; a chunk holds one text at least.
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: Bytes of text that are cut into tokens at once, and tokens that are scored at once; a chunk's wide arrays are of this size.
PART_BYTES, PART_TOKENS = 1 << 20, 1 << 17

_BEGIN, _END = (mix(np.array([x], np.uint64))[0] for x in (0xB0B, 0xE0D))
_TAG = np.uint64(7)  # the lowest bits of an n-gram's hash hold its order
_DOWN = np.uint64(0x9E3779B97F4A7C15)


def _sequence(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows, begin and end included; the row's first position; positions per row."""
    row, start, end = block.words()
    words = np.bincount(row, minlength=block.n)
    size = words + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    tokens = np.empty(int(size.sum()), np.uint64)
    tokens[first], tokens[first + size - 1] = _BEGIN, _END
    inside = np.ones(len(tokens), bool)
    inside[first], inside[first + size - 1] = False, False
    tokens[inside] = block.hashes(start, end)
    return tokens, first, size


def _grams(tokens: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at every position, from one token to ``order``; 0 where the text is too short."""
    found, run = [], np.zeros(len(tokens), np.uint64)
    for n in range(1, order + 1):
        run = run * _DOWN + (tokens if n == 1 else np.concatenate([np.zeros(n - 1, np.uint64), tokens[: 1 - n]]))
        gram = (mix(run) & ~_TAG) | np.uint64(n)
        found.append(np.where(place >= n - 1, gram, np.uint64(0)))
    return found


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(first, size)


def _firsts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def _distinct(arrays: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of all arrays."""
    found = np.concatenate(arrays)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def counted(parts: list[tuple], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct n-grams of a chunk's parts (tokens, positions per row, ..., held out) and their training counts."""
    hashes, counts = [], []
    for tokens, size, _, held in parts:
        grams = _grams(tokens, _places(_firsts(size), size), order)
        found, at = np.unique(np.concatenate(grams), return_inverse=True)
        n = np.bincount(at[np.tile(np.repeat(~held, size), order)], minlength=len(found)).astype(np.uint32)
        hashes.append(found[found > 0])
        counts.append(n[found > 0])
    every = _distinct(hashes)
    total = np.zeros(len(every), np.uint64)
    for found, n in zip(hashes, counts, strict=True):
        total[np.searchsorted(every, found)] += n
    return every, total


def _slices(size: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Whole rows and their positions, about ``PART_TOKENS`` at a time."""
    ends = np.cumsum(size)
    low = 0
    while low < len(size):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + PART_TOKENS, side="right")))
        yield slice(low, high), slice(before, int(ends[high - 1]))
        low = high


CHUNKS = "chunk bigint, bucket int, hashes binary, counts binary, tokens binary, vocabulary binary, sizes binary, ids binary, held binary"


def _chunks(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """A row per chunk (bucket -1) that holds its texts as numbers, and one per chunk and bucket with n-grams to count."""

    names, kinds = [x.split()[0] for x in CHUNKS.split(", ")], [pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def rows_of(number: int, parts: list[tuple]) -> Iterator[tuple]:
        size, ids, held = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        vocabulary = _distinct([np.unique(tokens) for tokens, *_ in parts])
        at = np.concatenate([np.searchsorted(vocabulary, tokens).astype(np.uint32) for tokens, *_ in parts])
        raw = ids.reshape(-1, 2).T.ravel()
        yield number, -1, None, None, pack(at), pack(deltas(vocabulary)), pack(size), pack(raw), pack(held)
        del at, vocabulary
        every, counts = counted(parts, order)
        parts.clear()
        bucket = (every >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(every)]])
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            yield number, int(bucket[low]), pack(deltas(every[low:high])), pack(counts[low:high]), *[None] * 5

    def send(number: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in rows_of(number, parts):
            rows.append(row)
            if len(rows) == 32:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, room = TaskContext.get().partitionId() << 32, CHUNK_BYTES
        parts: list[tuple] = []
        for batch in batches:
            for block in text_blocks(batch.column("text"), lower=True, limit=min(PART_BYTES, CHUNK_BYTES)):
                if parts and len(block.data) > room:
                    yield from send(number, parts)
                    number, room = number + 1, CHUNK_BYTES
                tokens, _, size = _sequence(block)
                ids = batch.column("doc_id").slice(block.first, block.n)
                held = batch.column("held").slice(block.first, block.n).to_numpy(zero_copy_only=False).astype(bool)
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
                parts.append((tokens, size, np.stack([null, ids.fill_null(0).to_numpy().view(np.uint64)], 1).ravel(), held))
                room -= len(block.data)
        if parts:
            yield from send(number, parts)

    return docs.mapInArrow(run, CHUNKS)


ANSWERS = "chunk bigint, bucket int, totals binary, n bigint, v bigint"


def _answer(table: pa.Table) -> pa.Table:
    """Totals over all chunks of one bucket, as each chunk asked; tokens and their kinds are counted on the first row."""
    hashes = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in table.column("hashes")]
    counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")])
    sizes = [len(x) for x in hashes]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=counts.astype(np.float64), minlength=len(every)).astype(np.uint64)
    begin = (mix(np.array([_BEGIN], np.uint64)) & ~_TAG) | np.uint64(1)
    single = ((every & _TAG) == 1) & (every != begin[0])
    rows = len(sizes)
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "totals": pa.array([pack(x) for x in np.split(total[at], np.cumsum(sizes)[:-1])], pa.binary()),
            "n": pa.array([int(total[single].sum()), *[0] * (rows - 1)], pa.int64()),
            "v": pa.array([int((total[single] > 0).sum()), *[0] * (rows - 1)], pa.int64()),
        }
    )


def traverse(grams: list[np.ndarray], every: np.ndarray, totals: np.ndarray, place: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the token at every position (0 at begins), and its count.

    The state before a token is its context; for each length of context the arc's weight follows from that of the state
    below, so all positions are read at once.
    """
    count = [np.where(g > 0, totals[np.minimum(np.searchsorted(every, g), len(every) - 1)], 0).astype(np.float64) for g in grams]
    probability = (count[0] + 1) / (n + v + 1)
    for length in range(2, len(grams) + 1):
        context = np.concatenate([[0.0], count[length - 2][:-1]])
        known = (place >= length - 1) & (context > 0)
        probability = np.where(known, (count[length - 1] + KAPPA * probability) / (context + KAPPA), probability)
    return np.where(place > 0, np.log10(probability), 0.0), count[0]


def scored(tokens: np.ndarray, size: np.ndarray, totals: np.ndarray, order: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row of a chunk the known tokens, the base score and the score; ``totals`` are those of the chunk's sorted n-grams."""

    def grams_of() -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        for rows, span in _slices(size):
            first = _firsts(size[rows])
            place = _places(first, size[rows])
            yield rows, first, place, _grams(tokens[span], place, order)

    every = _distinct([np.unique(np.concatenate([g[g > 0] for g in grams])) for *_, grams in grams_of()])
    known, base, score = np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size))
    for rows, first, place, grams in grams_of():
        log, count = traverse(grams, every, totals, place, n, v)
        known[rows] = np.add.reduceat(((count > 0) & (place > 0)).astype(np.int64), first)
        base[rows] = np.add.reduceat(np.where(place > 0, np.log10((count + 1) / (n + 1 * (v + 1))), 0.0), first)
        score[rows] = np.add.reduceat(log, first)
    return known, base, score


RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def score(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id``, ``text``); rows for which ``held_out`` holds are not learned from."""
    if not 1 <= order < 8:
        raise ValueError("order: 1 to 7")
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // BUCKET_BYTES).bit_length())
    table = written(_chunks(rows, order, bits), "chunks")
    asked = table.where("bucket >= 0").select("chunk", "bucket", "hashes", "counts")
    answers = written(asked.groupBy("bucket").applyInArrow(_answer, ANSWERS), "answers")
    n, v = (int(x or 0) for x in answers.agg(F.sum("n"), F.sum("v")).first())

    def read(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        at, delta, size, raw, held = (unpack(texts.column(c)[0].as_py()) for c in ("tokens", "vocabulary", "sizes", "ids", "held"))
        tokens = np.cumsum(delta, dtype=np.uint64)[at.astype(np.int64)]
        del at, delta, texts
        size = size.astype(np.int64)
        parts = sorted(zip(found.column("bucket").to_pylist(), found.column("totals"), strict=True), key=lambda x: x[0])
        totals = np.concatenate([unpack(x.as_py()) for _, x in parts])
        del parts, found
        known, base, log = scored(tokens, size, totals, order, n, v)
        rows = len(size)
        return pa.table(
            {
                "doc_id": pa.array(raw[rows:].view(np.int64), mask=raw[:rows].astype(bool)),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": pa.array(size - 1),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(rows, n, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(log),
            }
        )

    texts = table.where("bucket = -1").select("chunk", "tokens", "vocabulary", "sizes", "ids", "held")
    both = texts.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "totals").groupBy("chunk"))
    return both.applyInArrow(read, RESULT)
