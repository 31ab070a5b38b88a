"""Packing of tokenised documents into sequences: a configuration linear program over the length histogram.

Documents become token ids; one longer than a sequence is cut into full pieces and a rest. Only the histogram of
piece lengths, at most ``capacity`` numbers, reaches the driver. There the covering program

    minimise the number of sequences, so that the chosen patterns hold every length as often as it occurs,

whose columns are all multisets of lengths that fit, is solved approximately by multiplicative weights: prices of
lengths start in proportion to the lengths, an unbounded knapsack by dynamic programming finds the dearest pattern
around every length, patterns near the dearest are bought, and prices of lengths covered too often fall while the others
rise. The average is rounded: patterns with least waste first, each as often as bought (rounded up) while pieces last;
what is left goes into the open sequences, longest first, each into the tightest gap. Rounding works on
counts, so its cost depends on the number of distinct lengths and not on the number of pieces.

Pieces are then numbered within their length without gathering a length in one place: a task numbers its own
pieces, and the counts of the tasks before it are added. The plan maps (length, number) to a sequence and an offset.

Null and empty texts are the closing id alone. Repeated rows are packed each for itself. Further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, give_back, written

CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights, their step, and how near the dearest a pattern must be to be bought.
ROUNDS, STEP, NEAR = 12, 0.3, 0.05
#: Share of the tokens that the rounded program places; the rest, of many different lengths, closes the gaps.
SHARE = 0.8
#: Words whose ids a task remembers; bounds memory, not results.
REMEMBERED = 500_000

# ---------------------------------------------------------------- token ids


class _Words(dict):
    """Ids of white-space separated words as little-endian bytes, worked out where they are first met.

    The tokenizer normalises, lower-cases and splits within words only, so the ids of a text are those of its words. Words
    of Latin letters go straight to the merge model; any others go through the whole tokenizer.
    """

    #: Characters whose lower case and normal form do not depend on their neighbours.
    PLAIN = re.compile(r"[!-~¡-įĲ-ſ]+")
    #: The tokenizer's own splitting pattern (fixed by its file).
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.units: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.visible = str.maketrans({b: 256 + i for i, b in enumerate(hidden)})  # byte-level alphabet of the model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one unit, whatever the pattern
            found = self.unit(word.lower())
        elif not self.PLAIN.fullmatch(word):
            found = self.whole(word)
        else:
            found = b"".join(self.unit(x) for x in self.SPLIT.findall(word.lower()))
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.visible)  # "!" to "~" are themselves
            found = [t.id for t in self.model.tokenize(letters)]
            found = struct.pack(f"<{len(found)}I", *found)
            if len(self.units) > REMEMBERED:
                self.units.clear()
            self.units[unit] = found
        return found

    #: Python splits at these, the tokenizer does not.
    ODD = re.compile("[\x1c-\x1f]")

    def ids(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, _Words] = {}
KEPT.append(_LOADED)


def _begin() -> None:
    """A function of the module, so that a worker keeps its own ``_LOADED``."""
    give_back(_LOADED)


def token_ids(text: str | None, path: str) -> bytes:
    """Ids of a text and the closing id, four bytes each, little-endian."""
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    return _LOADED[path].ids(text or "") + END_ID.to_bytes(4, "little")


PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, number bigint"
)


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document, numbered within their length by the task that makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        task = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        wide = 4 * capacity
        for batch in batches:
            made: list[tuple[int | None, int, int, int, int, int, int]] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), path)
                for piece, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    length = len(part) // 4
                    made.append((doc_id, piece, at // 4, length, zlib.crc32(part), task, int(used[length])))
                    used[length] += 1
            columns = list(zip(*made, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the linear program


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest total price for every room from 0, and the length taken first (0: none); lengths may repeat."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = price[1 : room + 1] + best[room - 1 :: -1][:room]
        at = int(worth.argmax())
        if worth[at] > best[room - 1] + 1e-12:
            best[room], first[room] = worth[at], at + 1
        else:
            best[room], first[room] = best[room - 1], 0
    return best, first


def _around(lengths: np.ndarray, first: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """The dearest pattern that holds each length, longest first."""
    skip = np.arange(capacity + 1)
    for room in range(1, capacity + 1):
        if not first[room]:
            skip[room] = skip[room - 1]
    columns, room = [lengths], skip[capacity - lengths]
    while (took := first[room]).any():
        columns.append(took)
        room = skip[room - took]
    table = -np.sort(-np.stack(columns, 1), axis=1)
    return [tuple(x for x in row if x) for row in table.tolist()]


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Patterns and how often to use them, an approximate solution of the configuration program."""
    lengths = np.flatnonzero(counts)
    bought: dict[tuple[int, ...], float] = {}
    if not len(lengths):
        return bought
    need = counts[lengths].astype(float)
    price = np.zeros(capacity + 1)
    price[lengths] = lengths / capacity
    for _ in range(rounds):
        best, first = knapsack(np.where(price > 0, price, -1.0), capacity)
        around = _around(lengths, first, capacity)
        worth = price[lengths] + best[capacity - lengths]
        covered = np.zeros(capacity + 1)
        for at in np.flatnonzero(worth >= (1 - NEAR) * worth.max()):
            pattern = around[at]
            times = need[at] / pattern.count(int(lengths[at])) / rounds
            bought[pattern] = bought.get(pattern, 0.0) + times
            for length in pattern:
                covered[length] += times
        rate = covered[lengths] * rounds / need
        price[lengths] *= np.exp(-STEP * (np.clip(rate, 0, 3) - 1))
        price /= max(best[capacity], 1e-300)
        price[lengths] = np.clip(price[lengths], 1e-9, None)
    total = np.zeros(capacity + 1)
    for pattern, times in bought.items():
        for length in pattern:
            total[length] += times
    over = max(1.0, float((total[lengths] * lengths).sum() / (need * lengths).sum()))
    return {pattern: times / over for pattern, times in bought.items()}


def integral(counts: np.ndarray, capacity: int, bought: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """Whole patterns with their numbers that hold every piece exactly once."""
    left = counts.astype(np.int64).copy()
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def add(pattern: tuple[int, ...], times: int) -> None:
        group = open_.setdefault(capacity - sum(pattern), {})
        group[pattern] = group.get(pattern, 0) + times

    room = SHARE * float((left * np.arange(capacity + 1)).sum())
    for pattern, times in sorted(bought.items(), key=lambda x: (capacity - sum(x[0]), -x[1], x[0])):
        if room <= 0:
            break
        wanted: dict[int, int] = {}
        for length in pattern:
            wanted[length] = wanted.get(length, 0) + 1
        use = min(int(np.ceil(times - 1e-9)), min(int(left[length]) // k for length, k in wanted.items()))
        if use > 0:
            for length, k in wanted.items():
                left[length] -= use * k
            room -= use * sum(pattern)
            add(pattern, use)
    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        for gap in sorted(g for g in open_ if g >= length):
            if not rest:
                break
            each = gap // length
            for pattern, times in list(open_[gap].items()):
                full = min(times, rest // each)
                spare = rest - full * each if full < times else 0
                taken = full + (1 if spare else 0)
                if not taken:
                    continue
                open_[gap][pattern] -= taken
                if not open_[gap][pattern]:
                    del open_[gap][pattern]
                if full:
                    add(pattern + (length,) * each, full)
                if spare:
                    add(pattern + (length,) * spare, 1)
                rest -= full * each + spare
                if not rest:
                    break
        if rest:
            each = capacity // length
            if rest // each:
                add((length,) * each, rest // each)
            if rest % each:
                add((length,) * (rest % each), 1)
    return [(p, n) for gap in sorted(open_) for p, n in sorted(open_[gap].items()) if n]


@dataclass
class Plan:
    """Where the piece of a length with a number goes; one entry per pattern and length, sorted by length and number."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length.astype(np.float64), self.first)
        at = np.empty(len(length), np.int64)
        low = np.searchsorted(key[0], length, side="left")
        high = np.searchsorted(key[0], length, side="right")
        for value in np.unique(length):  # few entries per length; a search inside them
            mine = length == value
            a, b = int(low[mine][0]), int(high[mine][0])
            at[mine] = a + np.searchsorted(self.first[a:b], number[mine], side="right") - 1
        within = number - self.first[at]
        return self.sequence[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The packing of ``counts[length]`` pieces of every length from 1 to ``capacity``."""
    patterns = integral(counts, capacity, fractional(counts, capacity, rounds))
    entries, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            entries.append((length, int(used[length]), each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    entries.sort()
    columns = [np.array(c, np.int64) for c in zip(*entries, strict=True)] if entries else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences=sequence)


RESULT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Every piece of ``docs`` (``doc_id``, ``text``) with its sequence and its place there."""
    pieces = written(pieces_of(docs, path, capacity), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per_task = written(per_task.withColumn("before", F.coalesce(before, F.lit(0))), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    made = plan(counts, capacity, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = made.place(length, number)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = pieces.join(per_task.select("task", "length", "before"), ["task", "length"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before")).drop("task", "before")
    return numbered.mapInArrow(run, RESULT)
