"""Scalar text functions as Column expressions: no Python runs on a row."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that questions are asked with, left out of query terms.
STOP_WORDS = (
    "a an and are as at be by can change does for from how i if in is it me of on or show that the this to what when where which who with would"
).split()


def lexical_tokens(text: Column) -> Column:
    """Retrieval tokens, a bag in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def query_terms(text: Column) -> Column:
    """Question terms: a set with singulars added, without stop words and single letters."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]+"), 0)
    both = F.flatten(F.transform(raw, lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(t))))
    return F.filter(F.array_distinct(both), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def explorer_terms(text: Column) -> Column:
    """Explorer terms: a set of tokens of two letters or more."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]+"), 0)), lambda t: F.length(t) > 1)


def camel_words(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wide_count(text: Column) -> Column:
    """Code points beyond ASCII."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7f]+", "")))


def token_estimate(text: Column) -> Column:
    """A quarter of a token for each ASCII code point, half for any other, at least one."""
    wide = wide_count(text)
    return F.greatest(F.lit(1), F.ceil((F.length(text) - wide) * F.lit(0.25) + wide * F.lit(0.5))).cast("long")


def signal_key(line: Column) -> Column:
    """Diagnostics that differ in numbers, case or blanks only are one."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "#"), r"[ \t\r\n]+", " ")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and 32 hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the bytes of the text, as 8 hex digits."""
    raw = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(raw) / 2).cast("int")), lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    mixed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.when(c.isNull(), h).otherwise((h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.lower(F.lpad(F.hex(mixed), 8, "0"))


_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"


def _worded(items: list, *, back: bool = False) -> bool:
    """Is the first (``back``: the last) character of each match of a parsed sequence a word's? A match without characters has none."""
    if not items:
        return False
    (op, arg), rest = (items[-1], items[:-1]) if back else (items[0], items[1:])
    name, near = str(op), lambda own: _worded([*rest, *own] if back else [*own, *rest], back=back)
    if name == "LITERAL":
        return chr(arg) in _WORD
    if name == "IN":
        fits = {"LITERAL": lambda v: chr(v) in _WORD, "RANGE": lambda v: v[1] < 128 and all(chr(c) in _WORD for c in range(v[0], v[1] + 1)), "CATEGORY": lambda v: str(v) in ("CATEGORY_DIGIT", "CATEGORY_WORD")}
        return all(str(k) in fits and fits[str(k)](v) for k, v in arg)
    if name == "SUBPATTERN":
        return near(arg[3])
    if name == "ATOMIC_GROUP":
        return near(arg)
    if name == "BRANCH":
        return all(near(x) for x in arg[1])
    if name.endswith("_REPEAT"):
        return near(arg[2]) and (arg[0] > 0 or near([]))
    return name in ("AT", "ASSERT", "ASSERT_NOT") and near([])


def _edges(items: list, before: list, after: list):
    """Of each word edge in a parsed sequence, from left to right: does a word begin there, does one end?"""
    for k, (op, arg) in enumerate(items):
        name, left, right = str(op), [*before, *items[:k]], [*items[k + 1 :], *after]
        if name == "AT" and str(arg) == "AT_BOUNDARY":
            yield _worded(right), _worded(left, back=True)
        elif name == "SUBPATTERN":
            yield from _edges(list(arg[3]), left, right)
        elif name == "BRANCH":
            for x in arg[1]:
                yield from _edges(list(x), left, right)
        elif name == "ATOMIC_GROUP" or name.startswith("ASSERT") or name.endswith("_REPEAT"):
            yield from _edges(list(arg if name == "ATOMIC_GROUP" else arg[-1]), [], [])


@lru_cache(maxsize=None)
def ascii_edges(pattern: str) -> str:
    """The pattern with word edges of ASCII letters, digits and "_" only; the JVM's own ones see other letters too.

    Where a word must begin or end at an edge, one look to its other side does.
    """
    parts = pattern.split(r"\b")
    try:
        found = list(_edges(list(re._parser.parse(pattern)), [], []))
    except re.error:  # a pattern only the JVM knows
        found = []
    if len(found) != len(parts) - 1:  # branches that begin alike are parsed as one
        found = [(False, False)] * (len(parts) - 1)
    looks = ["(?<![A-Za-z0-9_])" if begins else "(?![A-Za-z0-9_])" if ends else _EDGE for begins, ends in found]
    return parts[0] + "".join(a + b for a, b in zip(looks, parts[1:], strict=True))


_FEW = 24  # words of a set at most


def _needed(items) -> tuple[list[str] | None, list[list[str]]]:
    """Of a parsed sequence: all strings it can be, if they are few, else None; and sets of words of which each match holds one."""
    runs, sets, whole = [""], [], True

    def flush() -> None:
        nonlocal runs, whole
        if all(runs):
            sets.append(runs)
        runs, whole = [""], False

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            own, inner = ([chr(arg).lower()] if arg < 128 else None), []
        elif name == "SUBPATTERN":
            own, inner = _needed(arg[3])
        elif name == "ATOMIC_GROUP":
            own, inner = _needed(arg)
        elif name == "BRANCH":
            parts = [_needed(x) for x in arg[1]]
            own = sorted({w for p, _ in parts for w in p}) if all(p for p, _ in parts) else None
            each = [p if p and all(p) else max(q, key=lambda ws: min(map(len, ws)), default=None) for p, q in parts]
            inner = [] if own or not all(each) else [sorted({w for ws in each for w in ws})]
        elif name == "AT" or name.startswith("ASSERT"):
            continue  # takes no room
        elif name.endswith("_REPEAT"):
            own, inner = None, []
            least, _, body = arg
            if least:
                own, inner = _needed(body)
                inner = [*inner, own] if own and all(own) else inner
                own = None
        elif name == "IN" and all(str(k) == "LITERAL" and v < 128 for k, v in arg) and len(arg) <= 4:
            own, inner = sorted({chr(v).lower() for _, v in arg}), []
        else:
            own, inner = None, []
        if own is None or len(own) * len(runs) > _FEW:
            flush()
            sets += [x for x in inner if len(x) <= _FEW]
            if own and all(own) and len(own) <= _FEW:
                sets.append(own)
        else:
            runs = [a + b for a in runs for b in own]
    exact = runs if whole else None
    if not whole and all(runs):
        sets.append(runs)
    return exact, sets


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case words; a text in which the pattern matches holds a word of each of them, whatever its letters' case."""
    try:
        exact, sets = _needed(re._parser.parse(pattern))  # read as Python's own matcher reads it
    except re.error:  # a pattern only the JVM knows
        return ()
    sets = [*sets, exact] if exact and all(exact) else sets
    # A word that holds another of its set adds nothing.
    least = {tuple(w for w in dict.fromkeys(ws) if not any(v != w and v in w for v in ws)) for ws in sets}
    return tuple(sorted(least, key=lambda ws: (-min(map(len, ws)), len(ws), ws)))


def may_match(low: Column, *patterns: str) -> Column:
    """Can one of the patterns match the text that ``low`` is in lower case? A search for plain words, some 50 times cheaper than a match."""
    every = lambda p: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [low.contains(w) for w in ws]) for ws in needles(p)], F.lit(True))
    return reduce(lambda a, b: a | b, [every(p) for p in patterns])
