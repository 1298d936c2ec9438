"""Wildcard patterns: ``*`` is any run of characters, ``?`` exactly one, ``\\`` escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(pattern: str) -> list[tuple[str, bool]]:
    """(character, is a wildcard); an escaped character is literal, a lone last backslash is dropped."""
    out, escaped = [], False
    for c in pattern:
        if escaped:
            out.append((c, False))
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            out.append((c, c in "*?"))
    return out


def clean(pattern: str) -> str:
    """The same pattern with runs of ``*`` collapsed and needless escapes removed."""
    out: list[str] = []
    for c, wild in tokens(pattern):
        if wild:
            if c == "*" and out and out[-1] == "*":
                continue
            out.append(c)
        else:
            out.append("\\" + c if c in "*?\\" else c)
    return "".join(out)


def has_wildcard(pattern: str) -> bool:
    return any(wild for _, wild in tokens(pattern))


def unescape(pattern: str) -> str:
    return "".join(c for c, _ in tokens(pattern))


def to_like(pattern: str) -> str:
    """A LIKE pattern with backslash as its escape; Catalyst turns simple ones into
    starts-with, ends-with and contains."""
    out = []
    for c, wild in tokens(clean(pattern)):
        if wild:
            out.append("%" if c == "*" else "_")
        else:
            out.append("\\" + c if c in "%_\\" else c)
    return "".join(out)


def matches(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whole-value match."""
    if ignore_case:
        column, pattern = F.lower(column), pattern.lower()
    if not has_wildcard(pattern):
        return column == F.lit(unescape(pattern))
    return column.like(to_like(pattern))


def contains(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Match anywhere in the value, as text search does."""
    return matches(column, clean("*" + pattern + "*"), ignore_case)


def naive_match(value: str, pattern: str) -> bool:
    """Reference matcher for tests and for values in the driver."""
    parts = [(".*" if c == "*" else ".") if wild else re.escape(c) for c, wild in tokens(pattern)]
    return re.fullmatch("".join(parts), value, re.DOTALL) is not None


class UnsupportedRegex(ValueError):
    """The expression has no equal among wildcard patterns."""


def from_regex(expression: str) -> str:
    """Wildcard pattern that is equal to a regular expression of the supported subset: literal
    characters, escapes of specials, ``.``, ``.*``, ``.+``, single-character sets, anchors."""
    start, end = expression.startswith("^"), False
    body = expression[1:] if start else expression
    out: list[str] = []
    i = 0

    def literal(c: str) -> str:
        return "\\" + c if c in "*?\\" else c

    while i < len(body):
        c, following = body[i], body[i + 1 : i + 2]
        if c == "$" and i == len(body) - 1:
            end = True
            i += 1
        elif c == ".":
            if following == "*":
                out.append("*")
                i += 2
            elif following == "+":
                out.append("?*")
                i += 2
            else:
                out.append("?")
                i += 1
        elif c == "\\":
            if not following or following.isalnum():
                raise UnsupportedRegex(f"escape at {i} in {expression!r}")
            out.append(literal(following))
            i += 2
        elif c == "[":
            close = body.find("]", i + 2)
            inner = body[i + 1 : close] if close > 0 else ""
            if inner.startswith("\\"):
                inner = inner[1:]
            if len(inner) != 1 or inner == "^":
                raise UnsupportedRegex(f"character set at {i} in {expression!r}")
            out.append(literal(inner))
            i = close + 1
        elif c in "*+?{}()|^$]":
            raise UnsupportedRegex(f"{c!r} at {i} in {expression!r}")
        else:
            out.append(literal(c))
            i += 1
        if body[i : i + 1] in {"*", "+", "?", "{"} and body[i : i + 1]:
            raise UnsupportedRegex(f"quantifier at {i} in {expression!r}")
    return clean(("" if start else "*") + "".join(out) + ("" if end else "*"))
