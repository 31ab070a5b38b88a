import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="session")
def words():
    """Words of a text, lower-cased in A-Z unless told otherwise."""

    def run(text, lower=True):
        return WORD.findall((text or "").translate(LOWER) if lower else text or "")

    return run


@pytest.fixture(scope="session")
def in_fold():
    """Whether crc32 of an id as text leaves a remainder."""

    def run(doc_id, of, remainder):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == remainder

    return run


#: Null, empty and blank texts, repeated rows, a null id, odd characters, a very long word.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "The THE the the the the"), (6, "é É ﬁ 日本 😀 \x1c ▁ \xa0 x"),
    (7, "a b c d e f g h i j k"), (7, "a b c d e f g h i j k"), (8, "A B C D E F G H I J K"), (None, "no id here at all"),
    (None, None), (9, "x" * 70_000), (10, "word " * 3000), (11, "line one two three\n" * 4), (12, "#*$%&|<> <|im_end|>"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD_TEXTS, "doc_id bigint, text string").repartition(3)
    clashing = ("lang", "source", "n_chars", "n", "node", "rep", "label", "h0", "task", "bucket", "rank", "held", "score", "toxic")
    return docs.withColumns({name: F.lit(None).cast("string") for name in clashing})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
