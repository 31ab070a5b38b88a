"""Glob patterns compiled on the driver into predicates Catalyst can see.

Two dialects occur: ``fnmatch`` over the whole path (``*`` crosses ``/``) for ignore
rules, and right-anchored component matching (``*`` stays inside a component) for
include / exclude lists. Patterns without inner wildcards become plain
``startswith`` / ``endswith`` / ``IN`` predicates, which Parquet scans can use;
the rest is folded into a few alternations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = set("*?[")
_ALTERNATIVES_PER_REGEX = 200


def _literal(ch: str) -> str:
    return ch if ch.isalnum() and ch.isascii() else f"\\x{{{ord(ch):x}}}"


def _quote(text: str) -> str:
    return "".join(_literal(ch) for ch in text)


def _class_regex(body: str) -> str:
    """Java character class for the inside of ``[...]``; reversed ranges hold nothing."""
    negated = body.startswith("!")
    members = body[1:] if negated else body
    ranges, at = [], 0
    while at < len(members):
        low = high = members[at]
        if at + 2 < len(members) and members[at + 1] == "-":
            high, at = members[at + 2], at + 2
        if low <= high:
            ranges.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
        at += 1
    if not ranges:
        return "(?s:.)" if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(ranges)}]"


def _translate(pattern: str, any_run: str, any_char: str, guard: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        ch = pattern[at]
        at += 1
        if ch == "*":
            if not out or out[-1] != any_run:
                out.append(any_run)
        elif ch == "?":
            out.append(any_char)
        elif ch == "[":
            first = at + (pattern[at : at + 1] == "!")
            close = pattern.find("]", first + 1) if first < len(pattern) else -1
            if close < 0:
                out.append(_literal("["))
            else:
                out.append(guard + _class_regex(pattern[at:close]))
                at = close + 1
        else:
            out.append(_literal(ch))
    return "".join(out)


def fnmatch_regex(pattern: str) -> str:
    """Whole-string regex of an ``fnmatch`` pattern (case-sensitive)."""
    return r"\A" + _translate(pattern, "(?s:.*)", "(?s:.)", "") + r"\z"


def path_glob_regex(pattern: str) -> str | None:
    """Right-anchored component regex; None for a pattern without components. A leading ``/`` anchors at the root.

    Paths are relative to the root, so a rooted pattern has to match the whole path (which may itself begin with ``/``).
    """
    rooted = pattern.startswith("/")
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    if not segments:
        return None
    parts = [
        "[^/]+" if s == "*" else _translate(s, "[^/]*", "[^/]", "(?!/)") for s in segments
    ]
    return (r"\A/?" if rooted else r"(?:\A|/)") + "/".join(parts) + r"\z"


def split_patterns(pattern_input: str | None) -> list[str]:
    """The non-blank entries of a ``;`` separated list."""
    return [p.strip() for p in (pattern_input or "").split(";") if p.strip()]


def _any_of(
    column: Column,
    patterns: Iterable[str],
    shortcut: Callable[[str], tuple[str, str] | None],
    to_regex: Callable[[str], str | None],
) -> Column:
    simple: dict[str, list[str]] = {"equals": [], "starts": [], "ends": []}
    regexes = []
    for pattern in dict.fromkeys(patterns):
        known = shortcut(pattern)
        if known:
            simple[known[0]].append(known[1])
        else:
            regex = to_regex(pattern)
            if regex is not None:
                regexes.append(regex)
    tests = [column.startswith(text) for text in simple["starts"]]
    tests += [column.endswith(text) for text in simple["ends"]]
    if simple["equals"]:
        tests.append(column.isin(simple["equals"]))
    for at in range(0, len(regexes), _ALTERNATIVES_PER_REGEX):
        tests.append(column.rlike("|".join(regexes[at : at + _ALTERNATIVES_PER_REGEX])))
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(False)


def fnmatch_shortcut(pattern: str) -> tuple[str, str] | None:
    if not WILD & set(pattern):
        return "equals", pattern
    if pattern[0] == "*" and not WILD & set(pattern[1:]):
        return "ends", pattern[1:]
    if pattern[-1] == "*" and not WILD & set(pattern[:-1]):
        return "starts", pattern[:-1]
    return None


def _path_glob_shortcut(pattern: str) -> tuple[str, str] | None:
    tail = pattern[1:]
    if pattern[:1] == "*" and tail and not (WILD | {"/"}) & set(tail):
        return "ends", tail
    return None


def fnmatch_any(path: Column, patterns: Iterable[str]) -> Column:
    """True where the whole path matches at least one ``fnmatch`` pattern."""
    return _any_of(path, patterns, fnmatch_shortcut, fnmatch_regex)


def path_glob_any(path: Column, pattern_input: str | None) -> Column:
    """True where the path matches an entry of a ``;`` separated glob list."""
    return _any_of(path, split_patterns(pattern_input), _path_glob_shortcut, path_glob_regex)
