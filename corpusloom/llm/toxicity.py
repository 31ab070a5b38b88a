"""Toxicity by the nearest labelled examples.

Labelled texts become TF-IDF vectors over all words of the sampled texts, and over the character n-grams inside words whose
presence depends most on the label, towards toxic. A word that tells little weighs little: its weight is multiplied by a factor that
grows with the distance between the share of toxic texts among those that hold it and that among all. A text's exact cosine neighbours
come from a block-max inverted index; their distance-weighted votes, each class weighted by how densely it was sampled, are calibrated
into a score. The neighbours are the evidence.

Most postings are those of few words that stand in most texts and weigh little, and no bound can pass over them. The ``HUBS`` longest lists
are therefore kept dense, and their part of all cosines is one matrix product for a batch of texts. Lists shorter than ``LONG`` are read
whole. The k-th greatest sum of these parts is a floor for the k-th cosine, since the other lists only add. Of those, a block is read only
if the greatest sum in it and the maxima of its postings together reach the floor.

The index holds a bounded sample of labelled rows: at most ``PER_CLASS`` of each label, smallest id hashes first; of an id with several
texts the smallest. The terms and their counts come from the same sample. Everything that is scored is scored whole.

Terms are counted, texts turned into vectors, postings sorted and votes calibrated by tasks, through written tables, each once. The driver
passes on the terms with their weights and the finished postings, packed, as one broadcast, whose size follows the sample and not the table.

Null texts count as empty; a text without any term has no neighbours and gets the share of toxic rows among
such labelled texts. Labels that are null are left out; if a document has several labels the greatest counts. With no
labelled rows at all every score is 0. One row comes out per row that comes in; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blockmax import ranges
from .common import give_back, small_batches, text_blocks, written

#: Labelled rows of each class in the index, at most.
PER_CLASS = 5000
#: Selected terms, at most; the least chi-squared value of a term, the least share of toxic texts that hold it, and the least
#: share of toxic texts among those that hold it, every class counted by its size in the whole table.
TERMS, LEAST_CHI2, LEAST_SHARE, LEAST_PRECISION = 4096, 12.0, 0.01, 0.3
GRAMS = (4, 5, 6)
#: Texts, by which the share of toxic texts among those that hold a word is drawn towards the share of all texts.
DRAWN = 5.0
#: Factor of the weight of a word that tells nothing; the factor grows to one with the distance of both shares.
LEAST_FACTOR = 0.05
NEIGHBOURS = 15
#: Rows that the calibration is fitted on, about.
CALIBRATION = 2000
#: Rows of a block of the index, postings of a list that is cut into blocks, at least, terms whose lists are kept dense, at most, and the
#: least share of the rows that such a term stands in.
BLOCK_ROWS, LONG, HUBS, LEAST_HUB = 128, 96, 512, 1 / 12
#: Texts that are scored at once, texts and bytes of texts that become vectors at once, and words searched for n-grams at once; they bound
#: memory only.
BATCH, HELD, HELD_BYTES, WORDS = 32, 512, 4 << 20, 4096
#: Bytes of a row of the written index.
PIECE = 256 << 10
#: Relative slack of bounds of sums of single precision.
SLACK = 1e-5


def bare_word(word: str) -> str:
    """The letters of a word."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def bare_words(words: pa.Array) -> pa.Array:
    """:func:`bare_word` of every lower-case word, null if it has less than two letters."""
    bare = pc.ascii_trim(words, characters=".,;:!?()\"'")  # leaves most words bare
    other = pc.invert(pc.ascii_is_alpha(bare))
    found = [bare_word(word) for word in words.filter(other).to_numpy(zero_copy_only=False)]
    bare = pc.replace_with_mask(bare, other, pa.array(found, words.type))
    return pc.if_else(pc.greater(pc.utf8_length(bare), 1), bare, pa.scalar(None, words.type))


@lru_cache(20_000)
def terms_of(word: str) -> frozenset[str]:
    """The word without outer punctuation and its character n-grams, word ends marked."""
    bare = bare_word(word)
    if len(bare) < 2:
        return frozenset()
    marked = f"^{bare}$"
    return frozenset([f"={bare}", *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))])


class Index:
    """Exact cosine search: the longest lists dense, the shortest read whole, those between cut into blocks with their maxima."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, row: np.ndarray, impact: np.ndarray, rows: int, vocabulary: int):
        """Postings have to be sorted by term, then row."""
        self.rows, self.row, self.impact = rows, row.astype(np.uint16) if rows <= 1 << 16 else row, impact
        first = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes >= max(1.0, LEAST_HUB * rows))
        long = np.sort(long[np.argsort(-sizes[long], kind="stable")[:HUBS]])
        #: Of each term the row of the dense matrix, -1 for other terms.
        self.place = np.full(vocabulary, -1, np.int32)
        self.place[terms[long]] = np.arange(len(long))
        self.dense = np.zeros((len(long), rows), np.float32)
        for place, at in enumerate(long):
            part = slice(first[at], first[at] + sizes[at])
            self.dense[place, row[part]] = impact[part]
        cut = sizes >= LONG
        cut[long] = False
        middle = np.flatnonzero(cut)
        #: Of each term the row of the tables of blocks, -1 for other terms.
        self.middle = np.full(vocabulary, -1, np.int32)
        self.middle[terms[middle]] = np.arange(len(middle))
        self.starts = np.arange(0, rows, BLOCK_ROWS)
        blocks = len(self.starts)
        posting = ranges(first[middle], sizes[middle])
        block = np.repeat(np.arange(len(middle)) * blocks, sizes[middle]) + row[posting] // BLOCK_ROWS
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        self.most = np.zeros(len(middle) * blocks, np.float32)
        if len(edge):
            self.most[block[edge]] = np.maximum.reduceat(impact[posting], edge)
        self.most = self.most.reshape(-1, blocks)
        #: Where the postings of each block begin, and where the last block's end.
        self.begin = np.zeros((len(middle), blocks + 1), np.int64)
        np.cumsum(np.bincount(block, minlength=len(middle) * blocks).reshape(-1, blocks), axis=1, out=self.begin[:, 1:])
        self.begin += first[middle][:, None]
        rest = ~cut
        rest[long] = False
        #: Of each term the first posting and the number of postings of its list, 0 for those above.
        self.first, self.size = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int32)
        self.first[terms[rest]], self.size[terms[rest]] = first[rest], sizes[rest]

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every vector the ``k`` nearest rows with a positive cosine, by cosine and then row, without the row to ``skip``."""
        asked = np.zeros((len(vectors), len(self.dense)), np.float32)
        for number, (term, weight) in enumerate(vectors):
            place = self.place[term]
            asked[number, place[place >= 0]] = weight[place >= 0]
        return [
            self._complete(base, term, weight, k, skip[number] if skip else -1)
            for number, (base, (term, weight)) in enumerate(zip(asked @ self.dense, vectors, strict=True))
        ]

    def _sums(self, posting: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row.take(posting), weights=weight * self.impact.take(posting), minlength=self.rows)

    def _complete(self, base: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        size, at = self.size[term], self.middle[term]
        score = base + self._sums(ranges(self.first[term], size), np.repeat(weight, size))
        if skip >= 0:
            score[skip] = -1.0
        floor = max(0.0, float(np.partition(score, -k)[-k])) if len(score) >= k else 0.0
        at, weight = at[at >= 0], weight[at >= 0]
        bound = weight @ self.most[at] + np.maximum.reduceat(score, self.starts)
        read = np.flatnonzero(bound * (1 + SLACK) >= floor)  # rows of other blocks stay below the floor
        begin = self.begin[at]
        first = begin[:, read]
        length = (begin[:, read + 1] - first).ravel()
        score += self._sums(ranges(first.ravel(), length), np.repeat(np.repeat(weight, len(read)), length))
        if skip >= 0:
            score[skip] = -1.0
        hit = np.flatnonzero(score >= floor * (1 - SLACK) if floor > 0 else score > 0)
        if len(hit) > k:
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
        best = hit[np.lexsort((hit, -score[hit]))[:k]]
        return best, score[best]


@dataclass
class Model:
    """Terms with their weights, the index, and what turns votes into scores; what is not sent is built where it is used, once a worker."""

    terms: pa.Array
    idf: np.ndarray
    #: Lists in order of terms: the terms, the length of each list; all rows and impacts, list after list.
    lists: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    ids: np.ndarray
    toxic: np.ndarray
    vote: np.ndarray
    prior: float
    empty: float
    #: Weight of a word that no sampled text holds.
    unseen: float = 1.0
    _grams: ahocorasick.Automaton | None = None
    _index: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_grams": None, "_index": None}

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(*self.lists, len(self.ids), len(self.terms))
        return self._index

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a vector of length one; both empty if no term occurs."""
        return self.vectors([text])[0]

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`vector` of every text. The terms of a word are looked up once for all texts.

        Words that no sampled text holds make the vector longer and match nothing, as in a cosine over all words.
        """
        if not texts:
            return []
        split = pc.utf8_split_whitespace(pa.array([text.lower() for text in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        inside = pc.binary_length(split.flatten()).to_numpy() > 0  # blanks at the ends leave empty words
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())[inside]
        kinds, size = max(1, len(coded.dictionary)), max(1, len(self.terms))
        found, times = np.unique(text * kinds + coded.indices.to_numpy()[inside], return_counts=True)
        text, word = found // kinds, found % kinds
        first, term = self._known(coded.dictionary)
        count = first[word + 1] - first[word]
        other = count == 0
        unseen = np.bincount(text[other], weights=(1 + np.log(times[other])) ** 2, minlength=len(texts)) * self.unseen**2
        found, at = np.unique(np.repeat(text, count) * size + term[ranges(first[word], count)], return_inverse=True)
        times = np.bincount(at, weights=np.repeat(times, count))
        text, term = found // size, found % size
        weight = (1 + np.log(times)) * self.idf[term]
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        parts = [slice(low, high) for low, high in zip(edge[:-1], edge[1:], strict=True)]
        lengths = [math.sqrt(float((weight[x] * weight[x]).sum()) + float(more)) for x, more in zip(parts, unseen, strict=True)]
        return [(term[x], weight[x] / length if x.stop > x.start else weight[x]) for x, length in zip(parts, lengths, strict=True)]

    def _prepare(self) -> None:
        """An automaton that finds the selected n-grams."""
        self._grams = ahocorasick.Automaton()
        own = pc.starts_with(self.terms, "=")
        for number in np.flatnonzero(~own.to_numpy(zero_copy_only=False)).tolist():
            self._grams.add_word(self.terms[number].as_py(), number)
        if len(self._grams):
            self._grams.make_automaton()

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the terms of every word, each once, one word after another, and where each word's begin.

        Of ``terms_of(word)`` these are the ones that the model has.
        """
        if self._grams is None:
            self._prepare()
        bare = bare_words(words)
        equal, begin, end, none = (pa.scalar(x, bare.type) for x in ("=", "^", "$", ""))
        own = pc.index_in(pc.binary_join_element_wise(equal, bare, none).cast(self.terms.type), value_set=self.terms)
        own = pc.fill_null(own, -1).to_numpy()
        word, term = [np.flatnonzero(own >= 0)], [own[own >= 0].astype(np.int64)]
        for at in range(0, len(bare) if len(self._grams) else 0, WORDS):
            marked = pc.fill_null(pc.binary_join_element_wise(begin, bare.slice(at, WORDS), end, none), none)
            ends = np.cumsum(pc.utf8_length(marked).to_numpy())
            # no n-gram has a word's end before a word's begin, so none is found across two words
            hits = np.array(list(self._grams.iter("".join(marked.to_numpy(zero_copy_only=False)))), np.int64).reshape(-1, 2)
            word.append(at + np.searchsorted(ends, hits[:, 0], side="right"))
            term.append(hits[:, 1])
        size = max(1, len(self.terms))
        pair = np.unique(np.concatenate(word) * size + np.concatenate(term))
        return np.searchsorted(pair // size, np.arange(len(bare) + 1)), pair % size

    def votes(self, term: np.ndarray, weight: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of the vote for toxic, and the neighbours with their cosines."""
        return next(self.votes_of([(term, weight)], [skip]))

    def votes_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """:meth:`votes` of a batch of vectors, in order."""
        none = np.zeros(0, np.int64)
        found = self.index.search(vectors, NEIGHBOURS, skip) if len(self.ids) else [(none, np.zeros(0))] * len(vectors)
        for row, cosine in found:
            if not len(row):
                yield self.empty, row, cosine
                continue
            strength = self.vote[row] * cosine / (1.05 - np.minimum(cosine, 1.0))
            yield (float((strength * self.toxic[row]).sum()) + self.prior) / (float(strength.sum()) + 1.0), row, cosine

    def scores(self, texts: list[str], slope: float, shift: float) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Score, neighbours and cosines of every text, in order."""
        vectors = self.vectors(texts)
        for at in range(0, len(vectors), BATCH):
            for share, row, cosine in self.votes_of(vectors[at : at + BATCH]):
                if not len(row):
                    yield share, row, cosine
                    continue
                logit = slope * math.log((share + 1e-6) / (1 - share + 1e-6)) + shift
                yield 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), row, cosine


@dataclass
class Fitted:
    """A model that has been sent to the workers, and the logistic curve over its votes."""

    sent: Broadcast
    slope: float = 1.0
    shift: float = 0.0

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.sent.value, name)


def _calibrate(share: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes' log odds, by a few Newton steps."""
    x = np.log((share + 1e-6) / (1 - share + 1e-6))
    a, b = 1.0, 0.0
    target = np.where(toxic > 0, 1 - 1 / (toxic.sum() + 2), 1 / ((1 - toxic).sum() + 2))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([(r * x).sum() + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
        hessian = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id``, ``text``, ``toxic`` of the sampled rows as a written table, and all labelled rows by label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = {int(toxic): n for toxic, n in known.groupBy("toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        share = (F.xxhash64("doc_id").cast("double") / F.lit(2.0**64)) + 0.5
        part = known.where((F.col("toxic") == label) & (share <= 1.2 * per_class / max(1, total.get(label, 0))))
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)  # of about as many rows
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most two times per_class pairs of numbers, so the sample can be sent to every task; an id on many rows stays one
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    return written(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled"), total


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label hold a term, over the rows of a task."""
    give_back()
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(set().union(*(terms_of(word) for word in set(text.lower().split()))))
    terms_of.cache_clear()  # the worker goes on to other steps
    terms = list({*counts[0], *counts[1]})
    for at in range(0, len(terms), 100_000):
        part = terms[at : at + 100_000]
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(part, pa.string()),
                "clean": pa.array([counts[0][t] for t in part], pa.int64()),
                "toxic": pa.array([counts[1][t] for t in part], pa.int64()),
            }
        )


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``HELD`` rows at most and, about, ``HELD_BYTES`` of text."""
    for batch in batches:
        for block in text_blocks(batch.column("text"), limit=HELD_BYTES):
            for at in range(0, block.n, HELD):
                yield batch.slice(block.first + at, min(HELD, block.n - at))


VECTOR = "doc_id bigint, toxic int, lead int, term binary, weight binary"


def _vectors(sent: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector of every sampled text, and its strongest term (-1 without any)."""
    for batch in _held(batches):
        made = sent.value.vectors(batch.column("text").to_pylist())
        lead = [int(term[int(np.argmax(weight))]) if len(term) else -1 for term, weight in made]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "toxic": batch.column("toxic"),
                "lead": pa.array(lead, pa.int32()),
                "term": pa.array([t.astype(np.int32).tobytes() for t, _ in made], pa.binary()),
                "weight": pa.array([w.astype(np.float32).tobytes() for _, w in made], pa.binary()),
            }
        )


#: Arrays of the index, in this order.
INDEX_KINDS = (np.int64, np.int32, np.int32, np.int32, np.int32, np.float32)
INDEX = "array int, piece int, bytes binary"


def _lists(table: pa.Table, size: int) -> pa.Table:
    """The index of the sampled texts, which one task holds; texts with the same strongest term stand together, so that few blocks hold it.

    A row is a piece of ``size`` bytes of an array.
    """
    table = table.sort_by([("lead", "ascending"), ("doc_id", "ascending")])
    terms = [np.frombuffer(t, np.int32) for t in table.column("term").to_pylist()]
    term = np.concatenate(terms)
    row = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    weight = np.frombuffer(b"".join(table.column("weight").to_pylist()), np.float32)
    order = np.lexsort((row, term))
    known, sizes = np.unique(term, return_counts=True)
    ids, toxic = (table.column(c).to_numpy() for c in ("doc_id", "toxic"))
    packed = (ids, toxic, known, sizes.astype(np.int32), row[order], weight[order])
    pieces = [(number, at // size, x[at : at + size]) for number, x in enumerate(x.tobytes() for x in packed) for at in range(0, len(x), size)]
    array, piece, data = zip(*pieces, strict=True)
    return pa.table({"array": pa.array(array, pa.int32()), "piece": pa.array(piece, pa.int32()), "bytes": pa.array(data, pa.binary())})


def _gathered(index: DataFrame, pieces: int) -> list[np.ndarray]:
    """The arrays of a written index; a few pieces at a time pass through the driver's JVM."""
    found: list[dict[int, bytes]] = [{} for _ in INDEX_KINDS]
    for row in index.repartition(max(1, pieces // 4)).toLocalIterator():
        found[row.array][row.piece] = bytes(row.bytes)
    return [np.frombuffer(b"".join(x.pop(at) for at in sorted(x)), kind) for x, kind in zip(found, INDEX_KINDS, strict=True)]


def _shares(sent: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vote on sampled texts by the others."""
    model = sent.value
    place = {int(doc_id): i for i, doc_id in enumerate(model.ids)}
    for batch in batches:
        rows = [place[i] for i in batch.column("doc_id").to_pylist()]
        pairs = zip(rows, batch.column("term").to_pylist(), batch.column("weight").to_pylist(), strict=True)
        asked = [((np.frombuffer(t, np.int32).astype(np.int64), np.frombuffer(w, np.float32)), i) for i, t, w in pairs]
        shares = []
        for at in range(0, len(asked), BATCH):
            vectors, skip = zip(*asked[at : at + BATCH], strict=True)
            shares += [share for share, _, _ in model.votes_of(list(vectors), list(skip))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "share": pa.array(shares, pa.float64()), "toxic": batch.column("toxic")})


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Fitted:
    """Model from the labelled rows for which ``learn`` (a condition on ``labels``) holds."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    sample, total = labelled_sample(docs, labels, learn, per_class)
    held = {int(toxic): n for toxic, n in sample.groupBy("toxic").count().collect()}
    n0, n1 = held.get(0, 0), held.get(1, 0)
    prior = total.get(1, 0) / max(1, sum(total.values()))
    nothing = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    model = Model(pa.array([], pa.string()), np.zeros(0), nothing, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), prior, prior)
    if not n0 or not n1:
        return Fitted(context.broadcast(model))
    found = sample.select("text", "toxic").mapInArrow(_presence, "term string, clean bigint, toxic bigint")
    found = written(found.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "presence")
    share = F.col("toxic") / F.lit(float(n1)) - F.col("clean") / F.lit(float(n0))
    mean = (F.col("toxic") + F.col("clean")) / F.lit(float(n0 + n1))
    chi2 = share * share / (F.greatest(mean * (1 - mean), F.lit(1e-12)) * F.lit(1 / n0 + 1 / n1))  # 0: in every text
    precise = F.col("toxic") * F.lit(total[1] / n1) >= F.col("clean") * F.lit(total[0] / n0 * LEAST_PRECISION / (1 - LEAST_PRECISION))
    common = F.col("toxic") >= F.lit(max(2.0, LEAST_SHARE * n1))
    best = found.where(precise & common).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    picked = best.orderBy(F.desc("chi2"), "term").limit(TERMS).select("term", F.lit(True).alias("picked"))
    d0, d1 = total[0] / n0, total[1] / n1
    clean, toxic = F.col("clean") * F.lit(d0), F.col("toxic") * F.lit(d1)
    drawn = (toxic + F.lit(DRAWN * prior)) / (toxic + clean + F.lit(DRAWN))
    tells = F.lit(LEAST_FACTOR) + F.lit(1 - LEAST_FACTOR) * F.abs(drawn - F.lit(prior)) / F.lit(max(prior, 1 - prior))
    chosen, rows_in_all = F.coalesce("picked", F.lit(False)), sum(total.values()) + 1
    weight = (F.log(F.lit(float(rows_in_all)) / (clean + toxic + 1)) + 1) * F.when(chosen, 1.0).otherwise(tells)
    weighted = found.join(F.broadcast(picked), "term", "left")  # at most TERMS
    weighted = weighted.where(F.col("term").startswith("=") | chosen).select("term", weight.alias("weight"))
    words = weighted.toArrow().sort_by("term").combine_chunks()  # the different words of the sampled texts, and the selected terms
    model = replace(model, terms=words["term"].combine_chunks(), idf=words["weight"].to_numpy(), unseen=(math.log(rows_in_all) + 1) * LEAST_FACTOR)
    sent = context.broadcast(model)

    vectors = written(sample.mapInArrow(lambda batches: _vectors(sent, batches), VECTOR), "vectors")
    bare = {int(r.toxic): r["count"] for r in vectors.where("lead < 0").groupBy("toxic").count().collect()}
    density = {0: d0, 1: d1}
    model.empty = (d1 * bare.get(1, 0) + prior) / (d0 * bare.get(0, 0) + d1 * bare.get(1, 0) + 1)
    full = vectors.where("lead >= 0")
    size = PIECE
    index = full.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda table: _lists(table, size), INDEX)
    index = written(index, "index")  # eight bytes and some for a posting of the sample
    pieces = index.count()
    sent.destroy()
    if not pieces:
        return Fitted(context.broadcast(model))
    ids, labels_of, *lists = _gathered(index, pieces)
    model = replace(model, lists=tuple(lists), ids=ids, toxic=labels_of.astype(float), vote=np.where(labels_of > 0, d1, d0))
    indexed = context.broadcast(model)
    del lists, words

    tried = full.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, round(len(ids) / CALIBRATION)))) == 0)
    voted = tried.mapInArrow(lambda batches: _shares(indexed, batches), "doc_id bigint, share double, toxic int").collect()  # about CALIBRATION rows
    if not voted:
        return Fitted(indexed)
    voted.sort()
    shares, toxic_of = np.array([r.share for r in voted]), np.array([float(r.toxic) for r in voted])
    slope, shift = _calibrate(shares, toxic_of, np.where(toxic_of > 0, density[1], density[0]))
    return Fitted(indexed, slope, shift)


SCHEMA = "doc_id bigint, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>"


def score(docs: DataFrame, fitted: Fitted, evidence: int = 3) -> DataFrame:
    """``score``, ``predicted`` and the nearest labelled examples of every row of ``docs`` (``doc_id``, ``text``)."""
    sent, slope, shift = fitted.sent, fitted.slope, fitted.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = sent.value
        for batch in _held(batches):
            scores, nearest = [], []
            for value, row, cosine in model.scores([text or "" for text in batch.column("text").to_pylist()], slope, shift):
                scores.append(min(1.0, max(0.0, value)))
                nearest.append(
                    [
                        {"doc_id": int(model.ids[r]), "cosine": float(c), "toxic": int(model.toxic[r])}
                        for r, c in zip(row[:evidence], cosine[:evidence], strict=True)
                    ]
                )
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array([int(x >= 0.5) for x in scores], pa.int32()),
                    "evidence": pa.array(nearest, kind),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """The whole rows of ``docs`` that are not predicted as toxic."""
    sent, slope, shift = fitted.sent, fitted.slope, fitted.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = sent.value
        for batch in _held(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([value < 0.5 for value, _, _ in model.scores(texts, slope, shift)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
