r"""Text measures of files that come as byte ranges, merged in any grouping.

A file cut at fixed byte positions is cut inside characters, inside ``\r\n`` and inside words. A range's summary therefore keeps what its
edges leave open: the continuation bytes it begins with (``head``), the unfinished character it ends with (``tail``), whether its first and last
characters are part of a word, whether it begins with ``\n`` or ends with ``\r``. Two neighbouring summaries merge into one of the same kind: the
tail of the first and the head of the second are a character; a word that runs across counts once, and so does a line break. Merging is
associative, so ranges are summed up in blocks of ``2**BLOCK_BITS`` neighbours, blocks of blocks and so on; no group is larger, whatever the file.

A range without any character boundary (a piece of one character, or nothing) is ``bare``: it only lengthens its neighbour.
Files that are not valid UTF-8 measure NULL, as in a strict read; line breaks count as after a text-mode read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_count, token_count, universal_newlines

BLOCK_BITS = 10
_CONTINUATION = "[89AB][0-9A-F]"
_UNFINISHED = f"[CD][0-9A-F]|E[0-9A-F](?:{_CONTINUATION})?|F[0-7](?:{_CONTINUATION}){{0,2}}"
_WORD = r"(?U)[^\s\x1c-\x1f]"


def cut_bytes(files: DataFrame, size: int, content: str = "content", number: str = "segment") -> DataFrame:
    """A row for each range of ``size`` bytes of ``content`` (one for an empty file), numbered from 0."""
    last = F.greatest(F.ceil(F.octet_length(content) / size).cast("bigint") - 1, F.lit(0).cast("bigint"))
    ranges = files.withColumn(number, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return ranges.withColumn(content, F.substr(F.col(content), (F.col(number) * size + 1).cast("int"), F.lit(size)))


def _piece(text: Column) -> dict[str, Column]:
    """Measures of whole characters."""
    plain = universal_newlines(text)
    return {
        "some": F.length(text) > 0,
        "chars": F.length(plain).cast("bigint"),
        "breaks": line_count(plain) - 1,
        "tokens": token_count(text),
        "opens": F.rlike(F.left(text, F.lit(1)), F.lit(_WORD)),
        "closes": F.rlike(F.right(text, F.lit(1)), F.lit(_WORD)),
        "lf": F.startswith(text, F.lit("\n")),
        "cr": F.endswith(text, F.lit("\r")),
    }


_MEASURES = ("some", "chars", "breaks", "tokens", "opens", "closes", "lf", "cr")


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _joined(a, b) -> Column:
    """Two pieces in a row, as a struct; a piece without characters changes nothing."""
    split = (a["cr"] & b["lf"]).cast("bigint")
    both = {
        "some": a["some"] | b["some"],
        "chars": a["chars"] + b["chars"] - split,
        "breaks": a["breaks"] + b["breaks"] - split,
        "tokens": a["tokens"] + b["tokens"] - (a["closes"] & b["opens"]).cast("bigint"),
        "opens": F.when(a["some"], a["opens"]).otherwise(b["opens"]),
        "closes": F.when(b["some"], b["closes"]).otherwise(a["closes"]),
        "lf": F.when(a["some"], a["lf"]).otherwise(b["lf"]),
        "cr": F.when(b["some"], b["cr"]).otherwise(a["cr"]),
    }
    return _struct(both)


def summarize(content: Column) -> Column:
    """Summary of one range of bytes, as a struct."""
    size = F.octet_length(content)
    head = (F.length(F.regexp_extract(F.hex(F.substr(content, F.lit(1), F.lit(3))), f"^((?:{_CONTINUATION})+)", 1)) / 2).cast("int")
    last = F.hex(F.substr(content, F.greatest(size - 2, F.lit(1)), F.lit(3)))
    tail = (F.length(F.regexp_extract(last, f"^(?:..)*?({_UNFINISHED})$", 1)) / 2).cast("int")
    inside = F.substr(content, head + 1, size - head - tail).cast("string")
    return F.struct(
        F.substr(content, F.lit(1), head).alias("head"),
        F.substr(content, size - tail + 1, tail).alias("tail"),
        ((size == head) | (size == 0)).alias("bare"),
        F.is_valid_utf8(inside).alias("valid"),
        _struct(_piece(F.make_valid_utf8(inside))).alias("text"),
    )


def _needed(tail: Column) -> Column:
    """Bytes of the character that an unfinished one begins."""
    lead = F.hex(F.substr(tail, F.lit(1), F.lit(1)))
    return F.when(lead >= "F0", 4).when(lead >= "E0", 3).otherwise(2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value that ``body`` uses several times, so that the plan holds it once."""
    return F.element_at(F.transform(F.array(value), lambda named: body(named)), 1)


def merged(a: Column, b: Column) -> Column:
    """The summary of two neighbouring ranges."""

    def around(glue: Column, one: Column, character: Column) -> Column:
        """``glue``: the bytes between both; ``one``: whether they are one character; ``character``: its measures (none if there are no bytes)."""
        whole = F.octet_length(glue) > 0
        valid = a["valid"] & b["valid"]
        before = F.struct(
            F.concat(a["head"], b["head"]).alias("head"), b["tail"].alias("tail"), b["bare"].alias("bare"),
            (valid & (F.octet_length(a["head"]) + F.octet_length(b["head"]) <= 3)).alias("valid"), b["text"].alias("text"),
        )

        def behind(first: Column) -> Column:
            # the second has no boundary: the character goes on, or ends where the second ends
            open_still = whole & (F.octet_length(a["tail"]) > 0) & (F.octet_length(glue) < _needed(glue))
            longer = F.struct(
                a["head"].alias("head"), F.when(open_still, glue).otherwise(F.lit(b"")).alias("tail"), F.lit(False).alias("bare"),
                (valid & (~whole | open_still | one)).alias("valid"), F.when(open_still, a["text"]).otherwise(first).alias("text"),
            )
            after = F.struct(
                a["head"].alias("head"), b["tail"].alias("tail"), F.lit(False).alias("bare"), (valid & (~whole | one)).alias("valid"),
                _joined(first, b["text"]).alias("text"),
            )
            return F.when(a["bare"], before).when(b["bare"], longer).otherwise(after)

        return _let(_joined(a["text"], character), behind)

    def glued(glue: Column) -> Column:
        one = F.is_valid_utf8(glue.cast("string")) & (F.length(F.make_valid_utf8(glue.cast("string"))) == 1)
        measures = _let(F.make_valid_utf8(glue.cast("string")), lambda character: _struct(_piece(character)))
        return _let(F.struct(one.alias("one"), measures.alias("text")), lambda known: around(glue, known["one"], known["text"]))

    return _let(F.concat(a["tail"], b["head"]), glued)


def merge_neighbours(summaries: DataFrame, keys: list[str], number: str = "segment", bits: int = BLOCK_BITS) -> DataFrame:
    """Merge the ``summary`` rows of each block of ``2**bits`` consecutive numbers; the block's number is ``number`` shifted by ``bits``."""
    block = F.shiftright(number, bits).alias(number)
    runs = summaries.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("at"), "summary"))).alias("run"))
    rest = F.slice("run", F.lit(2), F.size("run"))
    total = F.aggregate(rest, F.col("run")[0]["summary"], lambda a, x: merged(a, x["summary"]))
    return runs.select(*keys, number, total.alias("summary"))


def segment_metrics(segments: DataFrame, keys: list[str], content: str = "content", number: str = "segment", bits: int = BLOCK_BITS) -> DataFrame:
    """``chars``, ``lines`` and ``tokens`` of every file, NULL where it is not valid UTF-8.

    ``segments`` has the file's ``keys``, the range's ``number`` (a ``bigint`` from 0, without gaps) and its bytes. Only summaries are shuffled.
    A file with a NULL range measures NULL.
    """
    level = segments.select(*keys, F.col(number).cast("bigint").alias(number), summarize(F.col(content)).alias("summary"))
    for shift in (bits, bits, 62 - 2 * bits):  # the last one merges what a million ranges made one of
        level = merge_neighbours(level, keys, number, shift)
    found = F.col("summary")
    valid = found["valid"] & (F.octet_length(found["head"]) == 0) & (F.octet_length(found["tail"]) == 0)
    text = found["text"]
    return level.select(
        *keys,
        F.when(valid, text["chars"]).alias("chars"),
        F.when(valid, text["breaks"] + 1).alias("lines"),
        F.when(valid, text["tokens"]).alias("tokens"),
    )
