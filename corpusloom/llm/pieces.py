"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary (pieces, scores, byte pieces) comes from a model file, which is only read. A unigram model's scores are log
probabilities and are used as they are; the scores of other models are ranks, which become log probabilities by Zipf's
law (the piece of rank r has probability 1 / (r H)). The normaliser has to be the identity with a leading marker.

A space becomes the marker, and one marker is put in front. No piece holds a marker behind another character, so the best
path of a text is made of the best paths of its parts, each cut in front of a run of markers; this is checked when the
vocabulary is loaded, and the text stays one part if it does not hold. All new parts of a block of texts go through the trie
and the Viterbi recursion together, position by position; parts met before are remembered.

Characters without a piece cost ten below the lowest score and become byte pieces. Of paths with equal scores the one
whose last piece starts first wins, at every position. Decoding joins the pieces, turns markers into spaces and takes the
leading one away; it gives the text back exactly unless the text itself holds the marker U+2581, which comes back as a space.

Null and empty texts have no pieces. One row comes out per row that comes in; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blockmax import ranges

MARKER = "▁"
#: What an unknown character costs below the lowest score (the library's value).
UNKNOWN_PENALTY = 10.0
#: Parts that a task remembers, and bytes of new parts taken through the trie at once; they bound memory, not results.
REMEMBERED, TOGETHER = 400_000, 2 << 20


class Trie:
    """Byte-wise double-array trie: from state s over byte b to ``base[s] + b`` if ``check`` of that is s."""

    def __init__(self, words: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, word in enumerate(words):
            node = 0
            for byte in word:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
            ends.setdefault(node, number)
        size = 2 * len(children) + 1024
        base, check, value = (np.full(size, -1, np.int32) for _ in range(3))
        taken = bytearray(size)
        taken[0], place, free, wide, base[0] = 1, {0: 0}, 1, 1, 0
        if 0 in ends:
            value[0] = ends[0]
        for node, below in enumerate(children):  # parents come before their children
            if not below:
                continue
            codes = sorted(below)
            free = taken.index(0, free)
            if len(codes) == 1 and free > codes[0]:
                start = free - codes[0]  # single children fill the holes
            else:
                start = wide = max(wide, free - codes[0], 1)
                while any(taken[start + c] for c in codes):
                    start += 1
                    if start + 512 >= len(taken):
                        taken.extend(bytes(len(taken)))
                if start - wide > 32:  # crowded: leave it to single children
                    wide = start
            if start + 1024 >= len(taken):
                taken.extend(bytes(len(taken)))
            if len(base) < len(taken):
                more = np.full(len(taken) - len(base), -1, np.int32)
                base, check, value = (np.concatenate([a, more]) for a in (base, check, value))
            at = place[node]
            base[at] = start
            for code in codes:
                child, slot = below[code], start + code
                taken[slot], check[slot], place[child] = 1, at, slot
                value[slot] = ends.get(child, -1)
        base[base < 0] = len(base)  # leaves lead to the empty end
        self.base = base
        self.check = np.concatenate([check, np.full(256, -1, np.int32)])
        self.value = np.concatenate([value, np.full(256, -1, np.int32)])

    def matches(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words that begin at ``start`` and end by ``stop``: index into ``start``, end position, number of the word."""
        who, state, at = np.arange(len(start)), np.zeros(len(start), np.int32), start.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            go = at < stop[who]
            who, state, at = who[go], state[go], at[go]
            target = self.base[state] + data[at]
            go = self.check[target] == state
            who, state, at = who[go], target[go], at[go] + 1
            number = self.value[state]
            hit = number >= 0
            found.append((who[hit], at[hit], number[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


@dataclass
class Vocabulary:
    """Pieces and scores by id; ``bytes_`` are the ids of the 256 byte pieces, ``plain`` the ids in the trie."""

    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray
    bytes_: np.ndarray
    trie: Trie
    split: str | None
    lowest: float
    _memory: dict[str, tuple[bytes, float]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}}


def zipf_scores(scores: np.ndarray) -> np.ndarray:
    """Log probabilities by rank; the highest score is first, equal scores by position."""
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
    return -np.log(rank) - np.log((1 / np.arange(1, len(scores) + 1)).sum())


def build(pieces: list[str], scores: np.ndarray, plain: np.ndarray, bytes_: np.ndarray) -> Vocabulary:
    """``scores`` holds a score for every id in ``plain``."""
    scores = np.round(scores * 2.0**20) / 2.0**20  # sums of such scores are exact, so equal paths tie
    full = np.zeros(len(pieces))
    full[plain] = scores
    words = [pieces[i] for i in plain.tolist()]
    apart = not any(MARKER in word.lstrip(MARKER) for word in words)
    line = not any("\n" in word for word in words)
    split = None
    if apart:
        split = f"{MARKER}*[^{MARKER}\n]+|{MARKER}+|\n" if line else f"{MARKER}*[^{MARKER}]+|{MARKER}+"
    return Vocabulary(pieces, full, plain, bytes_, Trie([w.encode() for w in words]), split, float(scores.min()))


def load_vocabulary(path: str, unigram: bool = False) -> Vocabulary:
    """Vocabulary of a model file; ``unigram`` says that its scores are log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(" a  ﬁ ") != f"{MARKER * 2}a{MARKER * 2}ﬁ{MARKER}":
        raise ValueError("the model's normaliser is not the identity with a leading marker")
    n = model.vocab_size()
    bytes_ = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not all(model.is_byte(int(i)) for i in bytes_):
        raise ValueError("the model has no byte pieces")
    plain = np.array([i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))])
    scores = np.array([model.get_score(int(i)) for i in plain])
    return build([model.id_to_piece(i) for i in range(n)], scores if unigram else zipf_scores(scores), plain, bytes_)


def viterbi(parts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the best paths of all parts, how many each part has, and the paths' scores."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    stop = np.cumsum(size)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(begins, len(data)))
    part = np.searchsorted(stop, begins, side="right")
    who, end, number = vocabulary.trie.matches(data, begins, stop[part])
    single = np.zeros(len(begins), bool)
    single[who[end - begins[who] == width[who]]] = True
    lone = np.flatnonzero(~single)
    # nodes: a position of its own for every byte and for the end of every part
    source = np.concatenate([begins[who] + part[who], begins[lone] + part[lone]])
    target = np.concatenate([end + part[who], begins[lone] + width[lone] + part[lone]])
    ids = np.concatenate([vocabulary.plain[number], np.full(len(lone), -1)])
    score = np.concatenate([vocabulary.scores[vocabulary.plain[number]], np.full(len(lone), vocabulary.lowest - UNKNOWN_PENALTY)])
    low = stop - size + np.arange(len(parts))
    depth = target - low[np.concatenate([part[who], part[lone]])]
    order = np.lexsort((source, target, depth))
    source, target, ids, score, depth = source[order], target[order], ids[order], score[order], depth[order]
    best, back = np.zeros(len(data) + len(parts)), np.zeros(len(data) + len(parts), np.int64)
    for a, b in _runs(depth):
        worth = best[source[a:b]] + score[a:b]
        heads = np.flatnonzero(np.append(True, target[a + 1 : b] != target[a : b - 1]))
        top = np.maximum.reduceat(worth, heads)
        tied = worth == np.repeat(top, np.diff(np.append(heads, b - a)))
        chosen = np.minimum.reduceat(np.where(tied, np.arange(b - a), b - a), heads)
        best[target[a + heads]], back[target[a + heads]] = top, a + chosen
    node, owner, steps = stop + np.arange(len(parts)), np.arange(len(parts)), []
    total = best[node]
    while True:
        active = node > low[owner]
        node, owner = node[active], owner[active]
        if not len(node):
            break
        edge = back[node]
        steps.append((owner, edge))
        node = source[edge]
    if not steps:
        return np.zeros(0, np.int64), np.zeros(len(parts), np.int64), total
    owner = np.concatenate([o for o, _ in steps])[::-1]
    edge = np.concatenate([e for _, e in steps])[::-1]
    order = np.argsort(owner, kind="stable")
    owner, edge = owner[order], edge[order]
    unknown = ids[edge] < 0
    length = np.where(unknown, target[edge] - source[edge], 1)
    out = np.repeat(ids[edge], length)
    raw = ranges(source[edge[unknown]] - owner[unknown], length[unknown])
    out[np.repeat(unknown, length)] = vocabulary.bytes_[data[raw]]
    return out, np.bincount(owner, weights=length, minlength=len(parts)).astype(np.int64), total


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(values):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
        yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _learn(parts: list[str], vocabulary: Vocabulary) -> None:
    memory, at = vocabulary._memory, 0
    while at < len(parts):
        size, last = 0, at
        while last < len(parts) and (last == at or size < TOGETHER):
            size += len(parts[last])
            last += 1
        ids, count, total = viterbi([p.encode() for p in parts[at:last]], vocabulary)
        flat, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(count)
        for part, low, high, worth in zip(parts[at:last], (ends - 4 * count).tolist(), ends.tolist(), total.tolist(), strict=True):
            memory[part] = flat[low:high], worth
        at = last


def encode(texts: list[str | None], vocabulary: Vocabulary) -> list[tuple[bytes, float]]:
    """Ids (four bytes each, little-endian) and log probability of every text."""
    memory = vocabulary._memory
    if len(memory) > REMEMBERED:
        memory.clear()
    cut: list[list[str]] = []
    for text in texts:
        shown = MARKER + text.replace(" ", MARKER) if text else ""
        cut.append(re.findall(vocabulary.split, shown) if vocabulary.split else [shown] * bool(shown))
    fresh = {part for parts in cut for part in parts if part not in memory}
    _learn(sorted(fresh), vocabulary)
    made = []
    for parts in cut:
        known = [memory[part] for part in parts]
        made.append((b"".join(x for x, _ in known), float(sum(x for _, x in known))))
    return made


def decode(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of the ids; ids of no text (begin, end) are passed over."""
    table = getattr(vocabulary, "_bytes_of", None)
    if table is None:
        table = [b""] * len(vocabulary.pieces)
        for i in vocabulary.plain.tolist():
            table[i] = vocabulary.pieces[i].replace(MARKER, " ").encode()
        for byte, i in enumerate(vocabulary.bytes_.tolist()):
            table[i] = bytes([byte])
        vocabulary._bytes_of = table
    text = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
    return text.removeprefix(" ")


SCHEMA = (
    "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, log_prob double, n_chars bigint, round_trip boolean"
)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs`` (``doc_id``, ``text``), decoded again; with ``keep_ids`` the ids themselves as well."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        is_byte = np.zeros(len(known.pieces), bool)
        is_byte[known.bytes_] = True
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                made = encode(texts, known)
                rows = [np.frombuffer(x, "<u4") for x, _ in made]
                back = [decode(x, known) for x, _ in made]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_pieces": pa.array([len(x) for x in rows], pa.int64()),
                    "n_byte_pieces": pa.array([int(is_byte[x].sum()) for x in rows], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x, _ in made], pa.int64()),
                    "log_prob": pa.array([x for _, x in made], pa.float64()),
                    "n_chars": pa.array([len(x) for x in back], pa.int64()),
                    "round_trip": pa.array([x == (t or "").replace(MARKER, " ") for x, t in zip(back, texts, strict=True)], pa.bool_()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
