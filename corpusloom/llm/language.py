"""Language identification with string kernels.

A text's blended spectrum is the set of its character n-grams of length one to three (lower case, every character that
is no letter counts as a space). The kernel of two texts is the size of the intersection of their spectra over the
geometric mean of their sizes. Nyström landmarks, whole labelled texts, turn it into features; one-versus-rest kernel
ridge regression over them gives one margin per language. A block of texts is scored by two matrix products.

The classifier is fitted on a sample of labelled rows: ``SAMPLE`` in all, equally many for each language (all rows of a language
that has fewer, one at least), and ``LANDMARKS`` of them are landmarks, one for each language at least.
The most frequent letters of the sample have a small symbol, and n-grams of them are flags of a fixed table. N-grams with any
other letter are kept as numbers made of their code points, so no two letters count as the same.

A null text, or one without a letter, is ``und`` with score 0; so is everything if no row is labelled. One row comes out
per row that comes in; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blockmax import ranges
from .common import written

SAMPLE = 1600
LANDMARKS = 240
#: Symbols of the table of flags: the space, letters, and one for all other letters, whose n-grams stand outside the table.
ALPHABET = 48
RIDGE, SHARPNESS = 1e-2, 4.0
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_TABLE = 0x110000
SPECTRUM = ALPHABET + ALPHABET**2 + ALPHABET**3
#: Characters of a text whose n-grams outside the table are made distinct at once; bounds memory, not results.
SLICE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    letters: dict[int, int]
    features: np.ndarray
    landmarks: np.ndarray
    landmark_norm: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    #: N-grams outside the table, sorted, and of each the landmarks that hold it: ``holders[starts[i] : starts[i + 1]]``.
    rare: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    holders: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    _symbols: np.ndarray | None = None

    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = symbol_table(self.letters)
        return self._symbols

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_symbols": None}

    def margins(self, present: np.ndarray, size: np.ndarray, rare: list[np.ndarray] | None = None) -> np.ndarray:
        """Margins of texts with flags ``present``, ``rare`` n-grams outside the table and ``size`` n-grams in all."""
        shared = present[:, self.features].astype(np.float32) @ self.landmarks.T
        for row, grams in enumerate(rare or []):
            if len(grams) and len(self.rare):
                at = np.minimum(np.searchsorted(self.rare, grams), len(self.rare) - 1)
                at = at[self.rare[at] == grams]
                held = self.holders[ranges(self.starts[at], self.starts[at + 1] - self.starts[at])]
                shared[row] += np.bincount(held, minlength=shared.shape[1])
        kernel = shared / (np.sqrt(np.maximum(size, 1))[:, None] * self.landmark_norm[None, :])
        return kernel @ self.weights + self.bias


def symbol_table(letters: dict[int, int]) -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, the last one for letters outside the alphabet."""
    table = np.zeros(_TABLE, np.uint8)
    common = 0x3000  # beyond, letters are told apart where they occur
    table[:common] = [ALPHABET - 1 if chr(c).isalpha() else 0 for c in range(common)]
    table[common:] = 255
    for point, symbol in letters.items():
        table[point] = symbol
    return table


def _symbols(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point and symbol of every character, lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = table[points]
    late = np.flatnonzero(code == 255)
    if len(late):
        code[late] = [ALPHABET - 1 if chr(c).isalpha() else 0 for c in points[late].tolist()]
    return points, code.astype(np.int64)


def _mark(code: np.ndarray, out: np.ndarray) -> None:
    out[code] = True
    if len(code) > 1:
        pair = code[:-1] * ALPHABET + code[1:]
        out[ALPHABET + pair] = True
        if len(code) > 2:
            out[ALPHABET + ALPHABET**2 + pair[:-1] * ALPHABET + code[2:]] = True


def spectrum(text: str, table: np.ndarray, out: np.ndarray) -> None:
    """Mark the n-grams of ``text`` in ``out``, a row of ``SPECTRUM`` flags."""
    _mark(_symbols(text, table)[1], out)


def _rare_grams(point: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distinct n-grams that hold a letter for which ``other`` is true: code points, 21 bits each."""
    found = [point[other]]
    if len(point) > 1:
        pair, either = point[:-1] << 21 | point[1:], other[:-1] | other[1:]
        found.append(pair[either])
        if len(point) > 2:
            found.append((pair[:-1] << 21 | point[2:])[either[:-1] | other[2:]])
    return np.unique(np.concatenate(found))


def whole_spectrum(text: str, table: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Mark the n-grams of letters of the alphabet in ``out``; the sorted n-grams with any other letter are returned."""
    points, code = _symbols(text, table)
    _mark(code, out)
    other = code == ALPHABET - 1
    if not other.any():
        return np.zeros(0, np.int64)
    for part in (out[:ALPHABET], out[ALPHABET : ALPHABET + ALPHABET**2], out[ALPHABET + ALPHABET**2 :]):
        part[_merged(len(part))] = False
    point = np.where(code > 0, points, 1).astype(np.int64)  # what is no letter is 1, which is none either
    parts = [_rare_grams(point[at : at + SLICE + 2], other[at : at + SLICE + 2]) for at in range(0, len(point), SLICE)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@cache
def _merged(size: int) -> np.ndarray:
    """Flags of the n-grams that hold the symbol of all other letters, among ``size`` flags of n-grams of one length."""
    at, found = np.arange(size), np.zeros(size, bool)
    while size > 1:
        found |= at % ALPHABET == ALPHABET - 1
        at, size = at // ALPHABET, size // ALPHABET
    return found


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(text.lower())
    found = [c for c in counts if c.isalpha()]
    yield pa.RecordBatch.from_pydict(
        {"letter": pa.array([ord(c) for c in found], pa.int32()), "n": pa.array([counts[c] for c in found], pa.int64())}
    )


def labelled_sample(docs: DataFrame, learn: Column, size: int = SAMPLE) -> DataFrame:
    """``text``, ``lang`` and an order ``h`` of ``size`` different labelled rows, as many of each language, as a written table."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # one row a language
    each = max(1, size // max(1, len(counts)))
    enough = 1.25 * each + 6 * math.sqrt(each) + 10  # rows to expect, so that a hash filter leaves ``each`` or more
    # as an Arrow table: of a list, Spark would start a second set of Python workers in each executor
    rate = pa.array([min(2.0, enough / max(1, row.n)) for row in counts], pa.float64())
    rates = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([row.lang for row in counts], pa.string()), "rate": rate}))
    share = (F.col("h").cast("double") / F.lit(2.0**64)) + 0.5
    near = known.join(F.broadcast(rates), "lang").where(share < F.col("rate"))
    near = near.groupBy("lang", "h").agg(F.first("text").alias("text"))  # about ``enough`` rows a language
    at = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return written(near.withColumn("at", at).where(F.col("at") <= each).select("text", "lang", "h"), "languages")


def fit(docs: DataFrame, learn: Column, size: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """Model from the labelled rows for which ``learn`` (a condition on ``docs``) holds; None without any."""
    sample = labelled_sample(docs, learn, size)
    found = sample.mapInArrow(_letters, "letter int, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    common = found.orderBy(F.desc("n"), "letter").limit(ALPHABET - 2).collect()
    letters = {row.letter: i + 1 for i, row in enumerate(common)}

    marked = sample.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    languages = sorted(row.lang for row in sample.select("lang").distinct().collect())
    if not languages:
        return None
    marked = marked.where(F.col("at") <= max(1, landmarks // len(languages))).select("text", "lang", "h")

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(letters)
        for batch in batches:
            packed, others = [], []
            for text in batch.column("text").to_pylist():
                flags = np.zeros(SPECTRUM, bool)
                others.append(whole_spectrum(text, table, flags).tobytes())
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"lang": batch.column("lang"), "h": batch.column("h"), "flags": pa.array(packed, pa.binary()), "others": pa.array(others, pa.binary())}
            )

    held = marked.mapInArrow(spectra, "lang string, h bigint, flags binary, others binary").collect()  # the landmarks alone
    held = sorted(held, key=lambda r: (r.lang, r.h))
    marks = np.stack([np.unpackbits(np.frombuffer(r.flags, np.uint8), count=SPECTRUM).astype(bool) for r in held])
    others = [np.frombuffer(r.others, np.int64) for r in held]
    gram = np.concatenate(others)
    order = np.argsort(gram, kind="stable")
    rare, starts = np.unique(gram[order], return_index=True)
    holders = np.repeat(np.arange(len(held)), [len(x) for x in others])[order].astype(np.int32)
    features = np.flatnonzero(marks.any(0))
    model = Model(
        languages, letters, features, marks[:, features].astype(np.float32),
        np.sqrt(marks.sum(1) + [len(x) for x in others]).astype(np.float32), np.eye(len(held), dtype=np.float32), np.zeros(len(held), np.float32),
        rare, np.append(starts, len(gram)), holders,
    )

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row.astype(np.float64).tobytes() for row, _ in _margins(batch.column("text").to_pylist(), model)]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "kernel": pa.array(found, pa.binary())})

    # one number for each row of the sample and landmark
    rows = sorted(sample.mapInArrow(kernels, "lang string, h bigint, kernel binary").collect(), key=lambda r: (r.h, r.lang))
    place = {(r.lang, r.h): i for i, r in enumerate(rows)}
    chosen = [place[r.lang, r.h] for r in held]
    kernel = np.stack([np.frombuffer(r.kernel, np.float64) for r in rows])
    between = kernel[chosen]
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ root
    lang_of = np.array([languages.index(r.lang) for r in rows])
    share = 1.0 / (np.bincount(lang_of, minlength=len(languages))[lang_of] * len(languages))  # every language counts alike
    target = np.where(lang_of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    mean, aim = share @ mapped, share @ target
    centred = mapped - mean
    ridge = (centred * share[:, None]).T @ centred + RIDGE * np.eye(centred.shape[1]) / len(rows)
    beta = np.linalg.solve(ridge, (centred * share[:, None]).T @ (target - aim))
    model.weights = (root @ beta).astype(np.float32)
    model.bias = (aim - mean @ beta).astype(np.float32)
    return model


def _margins(texts: list[str], model: Model, block: int = 128) -> Iterator[tuple[np.ndarray, int]]:
    """Margins of every text, in order, with its number."""
    present = np.zeros((block, SPECTRUM), bool)
    for at in range(0, len(texts), block):
        part = present[: len(texts) - at]
        part[:] = False
        rare = [whole_spectrum(text, model.symbols(), flags) for flags, text in zip(part, texts[at : at + block], strict=True)]
        size = np.count_nonzero(part, axis=1) + np.array([len(x) for x in rare])
        for number, margins in enumerate(model.margins(part, size, rare), at):
            yield margins, number


def predict(column: pa.Array, model: Model | None, block: int = 128) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of an Arrow column."""
    names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
    for at in range(0, len(column) if model is not None else 0, block):
        texts = column.slice(at, block).to_pylist()
        known = [i for i, text in enumerate(texts) if has_letter(text)]
        for margins, number in _margins([texts[i] for i in known], model, block):
            odds = np.exp(SHARPNESS * (margins - margins.max()))
            names[at + known[number]] = model.languages[int(odds.argmax())]
            scores[at + known[number]] = min(1.0, float(odds.max() / odds.sum()))
    return names, scores


SCHEMA = "doc_id bigint, lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``lang_pred`` and ``score`` of every row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def with_language(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The whole rows of ``docs`` whose language is known with a score of at least ``least``.

    Without a model (no labelled row) every row that has a letter stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                keep = [has_letter(text) for text in batch.column("text").to_pylist()]
            else:
                names, scores = predict(batch.column("text"), model)
                keep = [name != UNKNOWN and p >= least for name, p in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
