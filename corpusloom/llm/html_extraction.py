"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a sequence of text runs and tags in page order. Every word of a run scores the log odds of standing in
the main content, given the element it stands in; every tag scores negative. One linear scan finds the contiguous
region with the greatest sum. Inside that region blocks that belong to boilerplate (menus, adverts, forms, comments and
the like, by element or by class, id and role) are left out. Class, id and role do not count on elements that hold the page as a whole.

The weights come from labelled pages: pages that mark their content with one ``article`` element say which words and
tags are inside and which are outside. They are counted over a sample of about ``sample`` different pages, those with the
smallest hashes, and added to fixed pseudo counts, so that pages are extracted even where none is labelled. ``article`` has a weight as
any element. Inside a marked article or ``main`` links, labels and buttons count as the text around them, and class, id and role name
boilerplate only on containers (``CONTAINERS``), and only if they say nothing else: ``ad-slot`` does, the heading ``related-work`` and the
section ``menu-planning`` do not.

Null and empty pages, and pages without words, have an empty text. Unclosed comments, scripts and elements run to the
end of the page. One row comes out per row that comes in; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different labelled pages that the weights are counted on, about.
SAMPLE = 2000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template iframe noembed noframes noscript object svg title textarea select xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("aside button footer form head label menu nav".split())
#: Of these, what may stand in running text, where it is marked as content.
CONTROLS = frozenset(["button", "label"])
#: Elements inside marked content that a class, id or role can make boilerplate, and words that say nothing beside a hint.
CONTAINERS = frozenset("aside details div dl form ol section table ul".split())
PLAIN = frozenset(
    "area bar block body box button buttons card container content form group inner item items link links list module outer panel post "
    "row section slot space thread unit user wrap wrapper zone".split()
)
#: Words of class, id and role attributes that name boilerplate.
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "consent contentinfo cookie cookies copyright disqus footer gdpr masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted promotion related reply replies respond "
    "search share sharing sidebar signup skyscraper social sponsor sponsored subscribe teaser toolbar tooltip widget".split()
)
#: Share of the page's words (those in boilerplate elements aside) from which an element is the page's frame.
FRAME = 0.9
#: Boilerplate unless it stands inside the marked content, where a header holds the title.
HEADERS = frozenset(["header", "banner", "masthead"])

#: Pseudo counts (words inside, words outside the content) by the element that holds a word.
PRIOR = {
    "p": (40, 4), "h1": (12, 2), "h2": (8, 2), "h3": (6, 2), "h4": (4, 2), "h5": (4, 2), "h6": (4, 2), "pre": (8, 1),
    "blockquote": (8, 1), "figcaption": (4, 1), "dd": (4, 1), "dt": (4, 1), "td": (6, 4), "th": (5, 4), "caption": (3, 1),
    "li": (8, 5), "article": (8, 1), "main": (8, 1), "section": (6, 2), "div": (8, 5), "body": (6, 4), "link": (4, 12),
    "other": (6, 5), "boilerplate": (1, 60),
}
#: Pseudo counts of tags, and the least and the greatest score of a tag: one tag never outweighs a few words.
TAG_PRIOR, TAG_LEAST, TAG_MOST = (2, 4), -1.0, -0.25
#: Bounds of a word's score. Unwanted words cost little: inside a region they are left out anyway, and a long advert must not
#: part a page's text.
WORD_LEAST, WORD_MOST = -0.5, 3.0

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attr>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)[^>]*+(?:>|$)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass(slots=True)
class Item:
    """A text run (``words`` > 0) or a tag, with its kind for the weights, and the block it belongs to."""

    kind: str
    words: int
    text: str
    block: int
    start: int
    boilerplate: bool
    inside: bool


@dataclass(slots=True)
class _Element:
    """An element, the number of the one it stands in, and the words in it outside of boilerplate elements."""

    name: str
    parent: int
    attributes: str
    holder: str
    link: bool
    named: bool
    words: int = 0
    marked: bool = False
    boilerplate: bool = False
    content: bool = False


def _hinted(attributes: str, content: bool) -> bool:
    for found in _HINT.findall(attributes):
        for word in _SPLIT.split("".join(found).lower()):
            if word in HINTS and not (content and word in HEADERS):
                return True
    return False


def _named_container(element: _Element) -> bool:
    """Whether a container inside marked content is named as boilerplate and nothing else."""
    if element.name not in CONTAINERS:
        return False
    for found in _HINT.findall(element.attributes):
        for name in "".join(found).lower().split():
            words = [word for word in _SPLIT.split(name) if word]
            hints = [word for word in words if word in HINTS and word not in HEADERS]
            if hints and all(word in HINTS or word in PLAIN for word in words):
                return True
    return False


def scan(page: str) -> list[Item]:
    """The page's text runs and tags in order."""
    items: list[Item] = []
    elements = [_Element("body", -1, "", "body", False, False)]
    owners: list[int] = []
    stack = [0]
    block, skip = 0, ""
    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            if skip:
                continue
            top = elements[stack[-1]]
            decoded = html.unescape(text)
            words = len(decoded.split())
            if not top.named:
                top.words += words
            items.append(Item("link" if top.link else top.holder, words, decoded, block, token.start(), False, False))
            owners.append(stack[-1])
            continue
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        closing = (token["close"] or token["close2"]) == "/"
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        attributes = token["attr"] or ""
        if name in BLOCK:
            block += 1
        shown = "/" + name if closing else name
        items.append(Item("<" + (shown if name in BLOCK or name in ("a", "br") else "other"), 0, "", block, token.start(), False, False))
        owners.append(stack[-1])
        if closing:
            for at in range(len(stack) - 1, 0, -1):
                held = elements[stack[at]].name
                if held == name:
                    del stack[at:]
                    break
                if name not in BLOCK and held in BLOCK:
                    break
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name not in ("svg", "math", "object"):
                skip = name
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK:
            for at in range(len(stack) - 1, 0, -1):
                held = elements[stack[at]].name
                if held == "p" or held == name == "li":
                    del stack[at:]
                    break
                if held in BLOCK:
                    break
            if name in ("article", "main"):
                while len(stack) > 1 and any(elements[x].name in ("nav", "header", "head") for x in stack):
                    stack.pop()
        above = elements[stack[-1]]
        holder = name if name in PRIOR else above.holder
        named = above.named or name in BOILERPLATE - CONTROLS or name == "header"
        elements.append(_Element(name, stack[-1], attributes, holder, above.link or name == "a", named))
        stack.append(len(elements) - 1)
    _judge(elements)
    for item, owner in zip(items, owners, strict=True):
        item.boilerplate, item.inside = elements[owner].boilerplate, elements[owner].content
        if item.boilerplate and item.kind[0] != "<":
            item.kind = "boilerplate"
        elif item.kind == "link" and item.inside:
            item.kind = elements[owner].holder
    return items


def _judge(elements: list[_Element]) -> None:
    """Which elements are boilerplate and which marked content.

    Hints do not count on the page's frame: ``html``, ``body``, ``main``, the only ``article`` and what these stand in, or, on a
    page without ``main`` and one ``article``, what holds nearly all words. They count nowhere if they would leave no words.
    """
    own = [x.words for x in elements]
    only = sum(x.name == "article" for x in elements) == 1
    framed = only or any(x.name == "main" for x in elements)
    for x in reversed(elements):
        x.marked = x.marked or x.name in ("html", "body", "main") or only and x.name == "article"
        if x.parent >= 0:
            elements[x.parent].words += x.words
            elements[x.parent].marked |= x.marked
    most = FRAME * elements[0].words
    for hints in (True, False):
        left = 0
        for x, words in zip(elements, own, strict=True):
            if x.parent < 0:
                left += words
                continue
            above = elements[x.parent]
            hinted = hints and not x.marked and (framed or not x.words or x.words < most)
            hinted = hinted and (_named_container(x) if above.content else _hinted(x.attributes, False))
            x.content = above.content or x.name == "main" or x.name == "article" and not hinted and not above.boilerplate
            always = x.name in BOILERPLATE and not (above.content and x.name in CONTROLS)
            x.boilerplate = above.boilerplate or always or hinted or x.name == "header" and not above.content
            left += 0 if x.boilerplate else words
        if left or not elements[0].words:
            return


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds by kind from words (or tags) inside and outside; tags never reach zero."""
    inside = 1 + sum(x for kind, (x, _) in counts.items() if kind[0] != "<")
    outside = 1 + sum(x for kind, (_, x) in counts.items() if kind[0] != "<")
    even = math.sqrt(outside / inside)  # half way between raw odds and odds of equally long classes
    found = {}
    for kind in {*PRIOR, *counts}:
        a, b = counts.get(kind, (0, 0))
        c, d = PRIOR.get(kind, TAG_PRIOR)
        scale = even if kind in counts else 1.0
        score = math.log((a * scale + c) / (b / scale + d))
        found[kind] = min(max(score, TAG_LEAST), TAG_MOST) if kind[0] == "<" else max(WORD_LEAST, min(WORD_MOST, score))
    found["boilerplate"] = WORD_LEAST
    return found


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous slice with the greatest sum; (0, 0) if no sum is positive.

    Of equal sums the first to end wins, and of its starts the last, so the shortest.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, found = total, (start, at + 1)
    return found


def main_text(page: str | None, weight: dict[str, float]) -> tuple[str, int, int]:
    """Text of the page, and the first and last position of its region in the page."""
    items = scan(page or "")
    scores = [weight.get(x.kind, TAG_MOST if x.kind[0] == "<" else 0.0) * (x.words or x.kind[0] == "<") for x in items]
    first, last = best_region(scores)
    if first == last:
        return "", 0, 0
    low, high = items[first].block, items[last - 1].block
    blocks: dict[int, list[str]] = {}
    for item in items:
        if low <= item.block <= high and not item.boilerplate:
            if item.words or item.text:
                blocks.setdefault(item.block, []).append(item.text)
            elif item.kind == "<br":
                blocks.setdefault(item.block, []).append(" ")
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    end = items[last].start if last < len(items) else len(page or "")
    return "\n\n".join(text for text in texts if text), items[first].start, end


def page_counts(page: str) -> dict[str, tuple[int, int]]:
    """Words and tags inside and outside the marked content, by kind; empty unless exactly one ``article`` opens."""
    items = scan(page)
    if sum(x.kind == "<article" for x in items) != 1:
        return {}
    inside: Counter = Counter()
    outside: Counter = Counter()
    for item in items:
        (inside if item.inside and not item.boilerplate else outside)[item.kind] += item.words or item.kind[0] == "<"
    return {kind: (inside[kind], outside[kind]) for kind in {*inside, *outside}}


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from the labelled pages among ``pages`` (``html``)."""
    marked = pages.where(F.lower("html").contains("<article")).select(F.xxhash64("html").alias("h"), "html")
    different = marked.agg(F.approx_count_distinct("h")).first()[0]
    least = -(2.0**63) + 2.0**64 * min(1.0, sample / max(1, different))
    chosen = marked.where(F.col("h").cast("double") <= least).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for kind, (a, b) in page_counts(page).items():
                    had = total.setdefault(kind, [0, 0])
                    had[0] += a
                    had[1] += b
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array(list(total), pa.string()), "a": pa.array([x[0] for x in total.values()], pa.int64()),
             "b": pa.array([x[1] for x in total.values()], pa.int64())}
        )

    rows = chosen.mapInArrow(count, "kind string, a bigint, b bigint").groupBy("kind").agg(F.sum("a"), F.sum("b"))
    return weights({kind: (a, b) for kind, a, b in rows.collect()})  # one row per kind of element: a fixed set


SCHEMA = "page_id bigint, url string, text string, n_chars bigint, region_start bigint, region_end bigint"


def extract_pages(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """Main text of every page (``page_id``, ``url``, ``html``), with weights fitted on ``pages`` unless given."""
    known = fit_weights(pages) if weight is None else weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, known) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([len(x[0]) for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "region_start", "region_end"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
