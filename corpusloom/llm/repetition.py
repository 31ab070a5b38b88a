"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes of all word windows of a text are compared with each other; the characters of
words inside a window that occurs twice or more are covered. Lines are compared in the same way. A text fails where the
covered share of its characters exceeds the limit of a length, or that of the lines.

Everything happens inside a row, so there is no shuffle. Null and empty texts have zero counts and fail the base rule
(fewer than ten words); one row comes out for each row that comes in, repeated rows included; further columns are
ignored. Columns may have any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, Texts, mix, repeated, text_blocks

#: Words in a window, and the share of word characters in percent that repeated windows of this length may cover.
WINDOW_LIMITS = {5: 20, 8: 18, 12: 16}
#: Share of word characters in percent that lines occurring twice or more may hold.
LINE_LIMIT = 30
MIN_WORDS = 10
BASE_WINDOW, BASE_PERCENT = 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_chars bigint, covered_chars array<bigint>, base_failed boolean, kept boolean"
)


def _measure(block: Texts, limits: dict[int, int], line_limit: int) -> dict[str, np.ndarray]:
    n = block.n
    row, start, end = block.words()
    points = block.points()
    chars = points[end] - points[start]
    total = lambda weight, of=row: np.bincount(of, weights=weight, minlength=n).astype(np.int64)
    words, word_chars = np.bincount(row, minlength=n).astype(np.int64), total(chars)
    marks = np.flatnonzero(_SYMBOL[block.data])
    symbols = np.bincount(block.rows_of(marks), minlength=n).astype(np.int64)
    rolled = Rolling(block.hashes(start, end))

    def covered(size: int) -> np.ndarray:
        at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, int)
        keys = mix(rolled.slices(at, at + size) + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        twice = at[repeated(keys)]
        change = np.bincount(twice, minlength=len(row) + 1) - np.bincount(twice + size, minlength=len(row) + 1)
        return np.cumsum(change)[: len(row)] > 0

    cover = {size: covered(size) for size in dict.fromkeys((BASE_WINDOW, *limits))}
    repeat_words = total(cover[BASE_WINDOW])
    by_length = [total(chars * cover[size]) for size in limits]

    breaks = np.flatnonzero(block.data == 10) + 1
    begin = np.unique(np.concatenate([block.offsets[:-1], breaks]))
    begin = begin[begin < len(block.data)]
    stop = np.append(begin[1:], len(block.data))
    stop = stop - (block.data[stop - 1] == 10) if len(stop) else stop
    line_of_word = np.searchsorted(begin, start, side="right") - 1
    filled = np.bincount(line_of_word, minlength=len(begin)) > 0
    line_chars = np.bincount(line_of_word, weights=chars, minlength=len(begin))
    begin, stop, line_chars = begin[filled], stop[filled], line_chars[filled]
    line_row = block.rows_of(begin)
    keys = mix(block.hashes(begin, stop) + line_row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    twice = repeated(keys)
    dup_line_chars = total(line_chars * twice, line_row)
    _, firsts = np.unique(keys, return_index=True)
    dup_lines = np.bincount(line_row, minlength=n) - np.bincount(line_row[firsts], minlength=n)

    failed = (words < MIN_WORDS) | (100 * repeat_words > BASE_PERCENT * words)
    bad = 100 * dup_line_chars > line_limit * word_chars
    for part, limit in zip(by_length, limits.values(), strict=True):
        bad |= 100 * part > limit * word_chars
    return {
        "n_words": words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": repeat_words, "dup_line_chars": dup_line_chars, "covered_chars": np.stack(by_length, 1),
        "base_failed": failed, "kept": ~failed & ~bad,
    }


def repetition_rules(
    docs: DataFrame, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT
) -> DataFrame:
    """Counts, covered characters and the verdict of every row of ``docs`` (``doc_id``, ``text``)."""
    limits = dict(limits or WINDOW_LIMITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                found = _measure(block, limits, line_limit)
                columns = [batch.column("doc_id").slice(block.first, block.n)]
                for name, values in found.items():
                    if values.ndim == 2:
                        ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
                        columns.append(pa.ListArray.from_arrays(ends, pa.array(values.ravel())))
                    else:
                        columns.append(pa.array(values))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
