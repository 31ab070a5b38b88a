"""Shared by the operators: whole texts as byte arrays, word and window hashes, written tables.

Texts are taken from Arrow buffers without building Python strings. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D; both are ASCII, so byte and code point boundaries agree.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text handled at once inside a task (a longer text is handled alone); bounds memory, not results.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch that the JVM and a worker pass each other, about; both hold a batch more than once. Bounds memory, not results.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.cumprod(run, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Polynomial prefix hashes: the hash of any slice in constant time.

    For short runs of values that are hashes themselves, such as windows of words. Long runs of few different values, such as the characters of
    a word, can collide by their structure, whatever the base; :meth:`Texts.hashes` is for those.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], dtype=np.uint64, out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(found + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """Rows ``first`` to ``last`` of a batch as one byte array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool = False):
        self.first, self.offsets = first, offsets
        self.data = LOWER[data] if lower else data
        self.n = len(offsets) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every slice; slices ascend and do not overlap. Each different slice is hashed once."""
        step = np.zeros(len(self.data) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        data = self.data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        slices = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = np.array([xxhash.xxh3_64_intdigest(x) for x in slices.dictionary.to_pylist()], np.uint64)
        return known[slices.indices.to_numpy()]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, start and end of every word."""
        solid = ~SPACE[self.data]
        size = len(solid)
        if not size:
            none = np.zeros(0, np.int64)
            return none, none, none
        cut = np.zeros(size + 1, bool)
        cut[self.offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | cut[1:-1]
        ends = solid
        ends[:-1] &= ~solid[1:] | cut[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return self.rows_of(start), start, end

    def rows_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, side="right") - 1

    def points(self) -> np.ndarray:
        """Code points before each byte position."""
        counted = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=counted[1:])
        return counted

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode()


def text_blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """The texts of one Arrow column in blocks of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        low, high = offsets[first], offsets[last]
        yield Texts(data[low:high], offsets[first : last + 1] - low, first, lower)
        first = last


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences of sorted values; ``np.cumsum`` gives the values back."""
    return np.diff(values, prepend=np.uint64(0))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: What operators keep in a worker from one task to the next.
KEPT: list[dict] = []


def give_back(own: dict | None = None) -> None:
    """Drop what other operators than the owner of ``own`` keep in this worker, and return free memory to the system.

    A worker goes from step to step; else the memory of all steps adds up in it.
    """
    for kept in KEPT:
        if kept is not own:
            kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """From now on Arrow batches of this session hold about ``limit`` bytes at most; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) * 1024 ** "bkmgtp".index(unit or "b") > limit:
        spark.conf.set(key, str(limit))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id, of: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(of)) == remainder, F.lit(False))
