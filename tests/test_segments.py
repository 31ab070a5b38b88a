r"""Byte ranges of a file against the whole: cuts inside characters, ``\r\n`` and words."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import segments

TEXTS = [
    "", "a", " ", "word", "two words", "é", "日本語 text 😀 end", "a\r\nb\rc\nd\r\n", "\r", "\n", "\r\n", "\r\n\r\n", "x\r", "\ny", "a b c　d\u0085e",
    "   ", "tab\tsep\x1cby\x1fodd", "ends in space ", " begins", "😀😀😀", "é " * 40, "a\x00b", "line\nline\r\nline\r" * 5,
]
BROKEN = [b"\xff", b"abc\xc3", b"\xa9abc", b"\xe6\x97", b"a\xe6\x97b", b"\xf0\x9f\x98", b"ok \xed\xa0\x80", b"\xc0\x80", b"\x80\x80\x80\x80\x80", b"a\xc3\xc3\xa9", b"\xf8aaaa"]


def expected(raw):
    try:
        text = raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return (None, None, None)
    return (len(text), text.count("\n") + 1, len(text.split()))


def measured(spark, rows, bits=10):
    frame = spark.createDataFrame(rows, "doc int, segment bigint, content binary").repartition(4)
    found = segments.segment_metrics(frame, ["doc"], bits=bits).collect()
    return {r.doc: (r.chars, r.lines, r.tokens) for r in found}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 64])
def test_fixed_ranges(spark, size):
    raw = [t.encode() for t in TEXTS] + BROKEN
    files = spark.createDataFrame(list(enumerate(map(bytearray, raw))), "doc int, content binary")
    found = segments.segment_metrics(segments.cut_bytes(files, size), ["doc"]).collect()
    assert {r.doc: (r.chars, r.lines, r.tokens) for r in found} == {i: expected(b) for i, b in enumerate(raw)}


def test_any_cuts_in_any_grouping(spark):
    """Cuts anywhere, empty ranges among them; blocks of two, so that merged ranges are merged again."""
    random.seed(3)
    raw = ["".join(random.choices("ab \n\ré日😀　\x1f", k=random.randint(0, 40))).encode() for _ in range(120)]
    raw += [bytes(random.choices(b"a \xc3\xa9\xe6\x97\xa5\xf0", k=6)) for _ in range(120)]
    rows = []
    for doc, data in enumerate(raw):
        cuts = sorted(random.choices(range(len(data) + 1), k=random.randint(0, 9)))
        for number, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
            rows.append((doc, number, bytearray(data[low:high])))
    assert measured(spark, rows, bits=1) == measured(spark, rows) == {i: expected(b) for i, b in enumerate(raw)}


def test_a_file_of_many_ranges(spark):
    text = ("wörd \r\n日本 x" * 3000).encode()
    rows = [(0, i, bytearray(text[i * 13 : i * 13 + 13])) for i in range(-(-len(text) // 13))]
    assert len(rows) > 1024 * 3
    assert measured(spark, rows)[0] == expected(text)


def test_null_ranges(spark):
    assert measured(spark, [(0, 0, bytearray(b"a")), (0, 1, None), (1, 0, None), (2, 0, bytearray(b"b"))]) == {0: (None,) * 3, 1: (None,) * 3, 2: (1, 1, 1)}


def test_groups_stay_small(spark):
    """However many ranges a file has, a merged group has 2**bits of them."""
    frame = spark.range(5000).select(F.lit(1).alias("doc"), F.col("id").alias("segment"), segments.summarize(F.lit(b"ab c")).alias("summary"))
    once = segments.merge_neighbours(frame, ["doc"], bits=5)
    assert once.count() == -(-5000 // 32)
