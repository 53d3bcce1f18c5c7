"""Pattern and number helpers shared by all operators.

Patterns are written with ASCII word boundaries in mind. Java's ``\\b`` follows Unicode, so
:func:`rx` spells it out with look-arounds. Case is folded for ASCII letters only: no other letter
folds to one of them, and the patterns hold no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: White space as the source data has it: ASCII, no-break and typographic spaces.
SPACE = r"[\s   -     　﻿]"


def rx(pattern: str, flags: str = "") -> str:
    """A Java pattern for one written with ASCII ``\\b``; ``flags`` from ``i``, ``m``, ``s``."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(BOUNDARY if pattern[i + 1] == "b" else pattern[i : i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    # a plain $ also matches before a final line feed in Java, which ^..$ rules must not
    body = "".join(out)
    if "m" not in flags and body.endswith("$") and not body.endswith(r"\$"):
        body = body[:-1] + r"\z"
    return (f"(?{flags})" if flags else "") + body


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return F.coalesce(text.rlike(rx(pattern, flags)), F.lit(False))


def first(text: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """The first match's group, null if there is none or the group is empty."""
    found = F.regexp_extract(text, rx(pattern, flags), group)
    return F.when(found != "", found)


def every(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """The group of all matches, in order."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


def swap(text: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), to)


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    # goes to the end and back to the last other character, so that each end is tested and nothing between
    return F.regexp_extract(text, rf"(?s)\A{SPACE}*+((?:.*[^{SPACE[1:-1]}])?)", 1)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def js_round(x: Column, digits: int = 0) -> Column:
    """Half goes up, towards positive infinity."""
    if not digits:
        return F.floor(x + 0.5)
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def number(text: Column) -> Column:
    """The number that a text starts with, null if it starts with none."""
    return F.expr("try_cast(null as double)") if text is None else F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def filled_lines(text: Column) -> Column:
    """Trimmed lines, blank ones left out."""
    return F.filter(F.transform(lines(text), trim), lambda x: x != "")


def find(array: Column, test) -> Column:
    """The first element for which ``test`` holds, else null."""
    return F.get(F.filter(array, test), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    What a lambda captures is computed for every element, so anything but a column is bound first.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_by(array: Column, key) -> Column:
    """The first element of each key, in order."""
    return let(array, lambda a: let(F.transform(a, key), lambda ks: F.filter(a, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1)))


def share(found: list[Column]) -> Column:
    """Rounded percentage of the conditions that hold; null does not hold."""
    hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in found), F.lit(0))
    return js_round(hits * 100 / len(found)).cast("int")
