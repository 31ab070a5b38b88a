"""Text, structure and references out of HTML markup with built-in expressions.

Markup is cut with a single alternation, so whichever construct opens first wins: a
``<script>`` inside a comment stays a comment and the other way round. All loops in
the patterns are possessive or single-character: no backtracking, no deep recursion.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import PIPE
from .text import strip

_ATTRIBUTES = r"""(?:[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+)?"""
# What may follow a "<": whole constructs that hold no text, and tags.
_DROPPED = (
    r"!--.*?(?:-->|\z)"
    rf"|(script|style){_ATTRIBUTES}>.*?(?:</\1[^>]*>|\z)"
    rf"|(template|rt|rp){_ATTRIBUTES}>(?:[^<]++|<(?!/?\2[\s/>]))*+</\2\s*>"
    r"|[!?][^>]*+>|/>|/[^a-zA-Z>][^>]*+>"
)
_TAG = rf"""(/?[a-zA-Z][^\s/>]*+){_ATTRIBUTES}>|(/?[a-zA-Z][^\s/>]*+)[^>]*+>"""
_MARKUP = f"(?is)<(?:{_DROPPED}|{_TAG})"
_NON_CONTENT = f"(?is)<(?:{_DROPPED})"

# Frequent character references, decoded by plain replacement.
COMMON_REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
}
_OTHER_REFERENCE = (
    "&(?!(?:amp|" + "|".join(r[1:-1] for r in COMMON_REFERENCES) + ");)"
    "(?:#[0-9]|#[xX][0-9a-fA-F]|[a-zA-Z])"
)

# Named references come from the standard library's HTML5 table: with a final ``;`` any
# name counts, without one only the legacy names do, and the longest of them wins.
_NAMED = html.entities.html5
_LEGACY = sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True)
_NAMED_JSON = json.dumps(_NAMED)
_BODY = (
    r"(?s)\A(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|" + "|".join(_LEGACY) + ")"
)
_LEGACY_BODY = r"(?s)\A(" + "|".join(_LEGACY) + ")"

# Numeric references 128 to 159 mean the Windows code page, by rule of the HTML standard.
_C1_CONTROLS = "".join(
    bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)
)


def _from_code_point(point: Column) -> Column:
    """One character; references to nothing usable give U+FFFD or '' as HTML5 asks."""
    c1_controls = F.substr(F.lit(_C1_CONTROLS), (point - 0x7F).cast("int"), F.lit(1))
    usable = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    replaced = point.isNull() | (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    dropped = (
        point.between(0x1, 0x8)
        | point.between(0xE, 0x1F)
        | (point == 0xB)
        | (point == 0x7F)
        | point.between(0xFDD0, 0xFDEF)
        | (F.pmod(point, F.lit(0x10000)) >= 0xFFFE)
    )
    return (
        F.when(replaced, F.lit("�"))
        .when(point == 0x0D, F.lit("\r"))
        .when(point.between(0x80, 0x9F), c1_controls)
        .when(dropped, F.lit(""))
        .otherwise(usable)
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _decode_after_ampersand(rest: Column, named: Column) -> Column:
    """Decode text that followed an ``&``; what is no reference gets its ``&`` back."""
    body = F.regexp_extract(rest, _BODY, 1)
    legacy = F.regexp_extract(rest, _LEGACY_BODY, 1)
    digits = F.regexp_extract(body, r"^#[xX]?([0-9a-fA-F]+)", 1)
    short = F.length(F.ltrim(digits, F.lit("0"))) <= 8
    hexadecimal = F.conv(digits, 16, 10).try_cast("bigint")
    point = F.when(short, F.when(body.rlike("^#[xX]"), hexadecimal).otherwise(digits.try_cast("bigint")))

    def tail(taken: Column) -> Column:
        return F.substr(rest, F.length(taken) + F.lit(1))

    return (
        F.when(body.startswith("#"), F.concat(_from_code_point(point), tail(body)))
        .when(F.element_at(named, body).isNotNull(), F.concat(F.element_at(named, body), tail(body)))
        .when(legacy != "", F.concat(F.element_at(named, legacy), tail(legacy)))
        .otherwise(F.concat(F.lit("&"), rest))
    )


def decode_references(text: Column) -> Column:
    """Character references to characters, each decoded once (``&amp;lt;`` gives ``&lt;``)."""
    common = text
    for reference, character in COMMON_REFERENCES.items():
        common = F.replace(common, F.lit(reference), F.lit(character))
    common = F.replace(common, F.lit("&amp;"), F.lit("&"))
    parts = F.split(text, "&")
    later = F.slice(parts, 2, F.size(parts))
    rare = _let(
        F.from_json(F.lit(_NAMED_JSON), "map<string,string>"),
        lambda named: F.concat(
            F.element_at(parts, 1),
            F.array_join(F.transform(later, lambda rest: _decode_after_ampersand(rest, named)), ""),
        ),
    )
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(text.rlike(_OTHER_REFERENCE), rare)
        .otherwise(common)
    )


def html_text(html: Column) -> Column:
    """Every text node stripped, blanks dropped, joined by newlines."""
    nodes = F.transform(F.split(html, _MARKUP), lambda node: strip(decode_references(node)))
    return F.array_join(F.filter(nodes, lambda node: node != ""), "\n")


# Tags that end a paragraph or heading left open.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|div|dl|dt|dd|fieldset|footer|form|h[1-6]|head|header|hr|html|li|main|"
    "nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)

# Marked markup: every tag is OPEN name CLOSE, without attributes; controls that HTML does
# not allow serve as marks and are removed from the input.
_OPEN, _CLOSE = "\x01", "\x02"


def _marked(html: Column) -> Column:
    clean = F.replace(F.replace(html, F.lit(_OPEN), F.lit("")), F.lit(_CLOSE), F.lit(""))
    return F.regexp_replace(clean, _MARKUP, f"{_OPEN}$3$4{_CLOSE}")


def _pieces(marked: Column, tags: str) -> Column:
    """Cut before the given tags (a ``|`` list, opening or closing): every piece starts
    with its tag and runs up to the next of the given tags."""
    return F.slice(F.split(marked, f"(?i){_OPEN}(?=/?(?:{tags}){_CLOSE})"), 2, 0x7FFFFFF)


def _opened(pieces: Column, tags: str) -> Column:
    """The pieces that open one of the tags."""
    return F.filter(pieces, lambda p: F.left(p, F.lit(12)).rlike(f"(?i)^(?:{tags}){_CLOSE}"))


def tag_pieces(html: Column, tags: str) -> Column:
    """Array of ``struct(tag, text)`` in document order, one for each of the given tags (a ``|`` list): its name in lower case, closing
    ones with ``/``, and the text up to the next of them without other tags; references are not decoded."""

    def piece(value: Column) -> Column:
        text = F.regexp_replace(F.concat(F.lit(_OPEN), value), f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", "")
        return F.struct(F.lower(F.substring_index(value, _CLOSE, 1)).alias("tag"), text.alias("text"))

    return F.transform(_pieces(_marked(html), tags), piece)


def _element(piece: Column) -> Column:
    """``struct(kind, text)`` of a piece: its tag name, and its text without inner tags."""
    text = F.regexp_replace(F.concat(F.lit(_OPEN), piece), f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", "")
    return F.struct(
        F.lower(F.substring_index(piece, _CLOSE, 1)).alias("kind"), strip(decode_references(text)).alias("text")
    )


def _table_elements(marked: Column) -> Column:
    """``struct(kind, text)`` per table (a marker without text) and per row with cells (its
    cells joined by pipes).

    Cells behind a nested table follow that table as a row of their own; ``operators.html_structure`` has them in their row."""
    # what follows a nested table is a row piece as well, so that its cells are not lost
    rows = _opened(_pieces(marked, "table|tr"), "table|tr|/table")

    def render(row: Column) -> Column:
        cells = _opened(_pieces(F.concat(F.lit(_OPEN), row), "t[dhr]"), "t[dh]")
        texts = F.transform(cells, lambda c: _element(c)["text"])
        is_table = F.lower(F.left(row, F.lit(6))) == f"table{_CLOSE}"
        return F.when(is_table, F.struct(F.lit("table").alias("kind"), F.lit("").alias("text"))).when(
            F.size(cells) > 0, F.struct(F.lit("row").alias("kind"), F.array_join(texts, PIPE).alias("text"))
        )

    return F.filter(F.transform(rows, render), lambda e: e.isNotNull())


def html_elements(html: Column) -> Column:
    """Array of ``struct(kind, text)``: title, then h1-h6 and p in document order,
    then list items, then one ``table`` entry per table followed by its pipe rows.

    Unclosed paragraphs and headings end at the next block tag; nested lists give
    one item per ``<li>``.
    """

    def of_blocks(blocks: Column) -> Column:
        return F.concat(F.slice(_opened(blocks, "title"), 1, 1), _opened(blocks, "h[1-6]|p"))

    def of_marked(marked: Column) -> Column:
        chosen = F.concat(_let(_pieces(marked, BLOCK_TAGS), of_blocks), _opened(_pieces(marked, "li|ul|ol"), "li"))
        elements = F.filter(F.transform(chosen, _element), lambda e: (e["kind"] != "title") | (e["text"] != ""))
        has_table = marked.rlike(f"(?i){_OPEN}table{_CLOSE}")
        none = F.array().cast("array<struct<kind:string,text:string>>")
        return F.concat(elements, F.when(has_table, _table_elements(marked)).otherwise(none))

    return _let(_marked(html), of_marked)


def html_outline(html: Column) -> Column:
    """The elements as one text: headed title, underlined headings, bullets, tables."""

    def line(e: Column) -> Column:
        return (
            F.when(e["kind"] == "title", F.concat(F.lit("Title: "), e["text"], F.lit("\n")))
            .when(e["kind"].rlike("^h[1-6]$"), F.concat(F.lit("\n"), e["text"], F.lit("\n" + "=" * 40 + "\n")))
            .when(e["kind"] == "li", F.concat(F.lit("• "), e["text"]))
            .when(e["kind"] == "table", F.lit("\nTable:"))
            .otherwise(e["text"])
        )

    return F.array_join(F.transform(html_elements(html), line), "\n")


def html_references(html: Column, tag: str = "img", attribute: str = "src") -> Column:
    """Values of an attribute, in document order, references decoded, empty ones dropped.

    Tags are taken out whole, then their attributes one by one, so neither a ``>`` nor an
    attribute name inside quotes misleads.
    """
    content = F.regexp_replace(html, _NON_CONTENT, "")
    whole_tag = rf"""(?is)<{tag}(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*>)"""
    one_attribute = r"""(?is)[^\s=>"'/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""

    def value(tag_text: Column) -> Column:
        attributes = F.regexp_extract_all(tag_text, F.lit(one_attribute), F.lit(0))
        named = F.filter(attributes, lambda a: a.rlike(rf"(?is)^{attribute}\s*="))
        raw = F.regexp_replace(F.get(named, 0), r"(?s)^[^=]*=\s*", "")
        return decode_references(F.regexp_replace(raw, r"""^["']|["']$""", ""))

    values = F.transform(F.regexp_extract_all(content, F.lit(whole_tag), F.lit(0)), value)
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def is_local_reference(reference: Column) -> Column:
    """Neither ``http(s)://`` nor ``data:``."""
    return ~reference.rlike("^(?:https?://|data:)")


def normalized_path(path: Column) -> Column:
    """``.`` and empty segments dropped, ``..`` taken back; NULL for a path that leaves its root."""
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), kept)
            .when((segment == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when(segment == "..", F.lit(None).cast("array<string>"))  # and null it stays: its size is unknown
            .otherwise(F.concat(kept, F.array(segment)))
        )

    def guarded(kept: Column, segment: Column) -> Column:
        return F.when(kept.isNull(), kept).otherwise(step(kept, segment))

    return F.array_join(F.aggregate(F.split(path, "/"), none, guarded), "/")


def local_target(reference: Column, folder: Column) -> Column:
    """The file that a local reference on a page of ``folder`` means: query and fragment cut off, ``%`` decoded, dot segments resolved.

    A rooted reference starts at the root. NULL where nothing is left or the path leaves the root.
    """
    plain = F.regexp_replace(reference, r"(?s)[?#].*\z", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    whole = F.when(decoded.startswith("/") | (folder == ""), decoded).otherwise(F.concat(folder, F.lit("/"), decoded))
    return F.when(decoded != "", normalized_path(whole))


def resolve_reference(reference: Column, folder: Column) -> Column:
    """A local reference below the page's directory; rooted ones stay as they are."""
    return F.when(reference.startswith("/"), reference).otherwise(
        F.concat(folder, F.lit("/"), reference)
    )
