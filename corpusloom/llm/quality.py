"""Quality of whole texts by a byte-level convolutional network, trained and run in numpy.

A text is its UTF-8 bytes, filled up with a padding symbol to whole segments of ``SEGMENT`` bytes. Every byte has a learned
vector; ``FILTERS`` learned filters over ``WIDTH`` consecutive bytes give rectified responses at every position of the text.
Two neighbouring segments are a chunk, so chunks overlap by half and cover the whole text. A chunk keeps each filter's
greatest response, a rectified layer of ``HIDDEN`` units judges the chunk, the text keeps each unit's greatest and mean value over its
chunks, and a logistic unit makes one probability of these. Since bytes are symbols, a filter is a sum of rows of ``WIDTH`` small
tables, one for each place; scoring needs nothing else.

Fitting takes a bounded sample: at most ``PER_CLASS`` labelled rows of each class, different ids, and of a text at most
``SEGMENTS`` segments, spread evenly over it (all of a shorter one). It runs on the driver over these bytes; classes count alike,
and the logit is moved to the share of the classes among all labelled rows afterwards. Scoring covers every byte of every row.

Null and empty texts are one segment of padding and get the score of that. An id that is labelled more than once counts as low
quality if any of its labels is 0; of an id with several texts the smallest is learned from. Rows with a null label or id teach
nothing. Without both classes every score is the share of label 1 (0.5 without any label). One row comes out per row that comes
in; repeated rows score alike; a very long text is read in slabs; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

PER_CLASS, SEGMENTS = 1500, 128
SEGMENT, WIDTH, FILTERS, HIDDEN, EMBEDDING = 128, 6, 16, 8, 8
PADDING, SYMBOLS = 256, 257
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 32, 0.01, 1e-4, 11
#: A score of at least this counts as good.
THRESHOLD = 0.3
#: Segments whose responses are held at once, and bytes of text laid out at once; bound memory, not results.
SLAB, BLOCK = 64, 1 << 20


def segments_of(length):
    """Segments of texts of so many bytes; the last one has room for a filter to run out of the text."""
    return np.maximum(1, -(-(np.asarray(length) + WIDTH - 1) // SEGMENT))


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, each filled up to whole segments, with one more window of padding; the first segment of each text."""
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(segments_of(size))]).astype(np.int64)
    symbols = np.full(first[-1] * SEGMENT + WIDTH - 1, PADDING, np.int16)
    symbols[np.arange(offsets[0], offsets[-1]) + np.repeat(first[:-1] * SEGMENT - offsets[:-1], size)] = data[offsets[0] : offsets[-1]]
    return symbols, first


def responses(symbols: np.ndarray, first: np.ndarray, tables: np.ndarray, bias: np.ndarray, low: int, high: int) -> np.ndarray:
    """Filter responses at the positions of segments ``low`` to ``high``: segment, place, filter.

    The last windows of a text's last segment would run into the next text; they are all padding, which adds nothing to the bias.
    """
    size = (high - low) * SEGMENT
    part = symbols[low * SEGMENT : high * SEGMENT + WIDTH - 1].astype(np.intp)
    found, more = np.empty((2, size, tables.shape[2]), np.float32)
    np.take(tables[0] + bias, part[:size], axis=0, out=found, mode="clip")
    for place in range(1, WIDTH):
        np.take(tables[place], part[place : place + size], axis=0, out=more, mode="clip")
        found += more
    found = found.reshape(high - low, SEGMENT, -1)
    ends = first[1:] - 1
    found[ends[(ends >= low) & (ends < high)] - low, SEGMENT - WIDTH + 1 :] = bias
    return found


def chunks(peaks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each segment the chunk that starts there: the greater of its and its successor's peaks within the text."""
    following = np.zeros_like(peaks)
    following[:-1] = peaks[1:]
    following[first[1:] - 1] = 0
    return np.maximum(peaks, following)


@dataclass
class Model:
    tables: np.ndarray
    bias: np.ndarray
    judge: np.ndarray
    judge_bias: np.ndarray
    weights: np.ndarray
    offset: float
    prior: float

    def peaks(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        segments = int(first[-1])
        found = np.empty((segments, len(self.bias)), np.float32)
        for low in range(0, segments, SLAB):
            high = min(low + SLAB, segments)
            found[low:high] = np.maximum(responses(symbols, first, self.tables, self.bias, low, high).max(axis=1), 0)
        return found

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        symbols, first = layout(data, offsets)
        judged = np.maximum(chunks(self.peaks(symbols, first), first) @ self.judge + self.judge_bias, 0)
        top = np.maximum.reduceat(judged, first[:-1], axis=0)
        mean = np.add.reduceat(judged, first[:-1], axis=0) / np.diff(first)[:, None]
        return np.concatenate([top, mean], axis=1).astype(np.float64) @ self.weights + self.offset

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """``quality``, ``doc_id`` and ``text`` of the sample, and all labelled ids by label."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    total = {int(quality): n for quality, n in known.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id")
    share = order.cast("double") / F.lit(2.0**64) + 0.5
    parts = []
    for label in (0, 1):
        rate = 1.2 * per_class / max(1, total.get(label, 0))
        part = known.where((F.col("quality") == label) & (share <= rate)).orderBy(order, "doc_id").limit(per_class)
        parts.append(part)
    chosen = parts[0].unionByName(parts[1])  # at most two times per_class pairs of numbers
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), total


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes to learn from: whole segments, evenly spread where a text has too many."""
    for batch in batches:
        found = []
        for block in text_blocks(batch.column("text")):
            for low, high in zip(block.offsets[:-1], block.offsets[1:], strict=True):
                data = block.data[low:high]
                count = -(-len(data) // SEGMENT)
                if count > SEGMENTS:
                    at = np.linspace(0, count // 2 - 1, SEGMENTS // 2).astype(np.int64)  # pairs of neighbours: chunks stay whole
                    data = np.concatenate([data[2 * i * SEGMENT : 2 * (i + 1) * SEGMENT] for i in at])
                found.append(data.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "data"])


class _Adam:
    """Steps of bounded size along averaged slopes, for a list of arrays that it changes in place."""

    def __init__(self, values: list[np.ndarray]):
        self.values, self.count = values, 0
        self.mean, self.square = ([np.zeros_like(v) for v in values] for _ in range(2))

    def step(self, slopes: list[np.ndarray], rate: float) -> None:
        self.count += 1
        for value, slope, mean, square in zip(self.values, slopes, self.mean, self.square, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            value -= rate * mean / (1 - 0.9**self.count) / (np.sqrt(square / (1 - 0.999**self.count)) + 1e-8)


def train(texts: list[bytes], quality: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Network fitted to texts and labels by gradient steps over small batches; the classes count alike."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    vectors, filters, bias = draw(0.5, SYMBOLS, EMBEDDING), draw(0.35, WIDTH, EMBEDDING, FILTERS), np.zeros(FILTERS, np.float32)
    judge, judge_bias, weights, offset = draw(0.3, FILTERS, HIDDEN), np.full(HIDDEN, 0.1, np.float32), draw(0.2, 2 * HIDDEN), np.zeros(1, np.float32)
    vectors[PADDING] = 0
    steps = _Adam([vectors, filters, bias, judge, judge_bias, weights, offset])
    share = 0.5 / np.maximum(np.bincount(quality, minlength=2), 1)
    counted = (share[quality] * len(quality)).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])]).astype(np.int64)
            symbols, first = layout(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), offsets)
            segments, starts = int(first[-1]), first[:-1]
            tables = np.einsum("se,wef->wsf", vectors, filters)
            found = responses(symbols, first, tables, bias, 0, segments)
            place = found.argmax(axis=1)
            peaks = np.maximum(np.take_along_axis(found, place[:, None, :], axis=1)[:, 0, :], 0)
            pooled = chunks(peaks, first)
            judged = np.maximum(pooled @ judge + judge_bias, 0)
            top, n = np.maximum.reduceat(judged, starts, axis=0), np.diff(first)
            features = np.concatenate([top, np.add.reduceat(judged, starts, axis=0) / n[:, None]], axis=1)
            odds = 1 / (1 + np.exp(-np.clip(features @ weights + offset[0], -30, 30)))
            slope = ((odds - quality[rows]) * counted[rows] / len(rows)).astype(np.float32)
            # back through the logistic unit, the greatest and mean units, the chunks and the greatest responses
            back = slope[:, None] * weights
            text_of = np.repeat(np.arange(len(rows)), n)
            hit = judged == top[text_of]
            ties = np.add.reduceat(hit, starts, axis=0, dtype=np.float32)
            to_judged = hit * (back[:, :HIDDEN] / ties)[text_of] + (back[:, HIDDEN:] / n[:, None])[text_of]
            to_judged *= judged > 0
            to_pooled = to_judged @ judge.T
            own = peaks >= pooled  # else the successor is the greater
            to_peaks = to_pooled * own
            to_peaks[1:] += (to_pooled * ~own)[:-1]
            to_peaks *= peaks > 0
            segment, kind = np.nonzero(to_peaks)
            amount = to_peaks[segment, kind]
            position = segment * SEGMENT + place[segment, kind]
            inside = amount * ~(np.isin(segment, first[1:] - 1) & (place[segment, kind] > SEGMENT - WIDTH))
            to_filters, to_vectors = np.empty_like(filters), np.zeros_like(vectors)
            for w in range(WIDTH):
                flat = np.bincount(symbols[position + w].astype(np.int64) * FILTERS + kind, inside, SYMBOLS * FILTERS)
                to_table = flat.reshape(SYMBOLS, FILTERS).astype(np.float32)
                to_filters[w] = vectors.T @ to_table
                to_vectors += to_table @ filters[w].T
            to_vectors[PADDING] = 0
            slopes = [to_vectors, to_filters, np.bincount(kind, amount, FILTERS).astype(np.float32)]
            slopes += [pooled.T @ to_judged, to_judged.sum(0), slope @ features, slope.sum(keepdims=True)]
            for value, change in zip(steps.values, slopes, strict=True):
                if value.ndim > 1:
                    change += DECAY * value
            steps.step(slopes, RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            vectors[PADDING] = 0
    return Model(np.einsum("se,wef->wsf", vectors, filters), bias, judge, judge_bias, weights.astype(np.float64), float(offset[0]), 0.5)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> Model:
    """Model from the labelled rows for which ``learn`` (a condition on ``labels``) holds."""
    sample, total = training_rows(docs, labels, learn, per_class)
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5
    rows = sample.mapInArrow(_spread, "doc_id bigint, quality int, data binary").collect()  # bounded rows of bounded bytes
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    quality = np.array([r.quality for r in rows], np.int64)
    if not 0 < quality.sum() < len(quality):
        empty = np.zeros((WIDTH, SYMBOLS, 1), np.float32)
        flat = np.clip(prior, 1e-6, 1 - 1e-6)
        return Model(empty, np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), np.zeros(2), float(np.log(flat / (1 - flat))), prior)
    model = train([bytes(r.data) for r in rows], quality, epochs)
    model.offset += float(np.log(prior / (1 - prior)))
    model.prior = prior
    return model


SCHEMA = "doc_id bigint, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``score`` and ``predicted`` of every row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(block.data, block.offsets) for block in text_blocks(batch.column("text"), limit=BLOCK)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
