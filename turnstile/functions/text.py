"""Scalar text helpers expressed as built-in Spark Columns.

Every helper returns a ``Column`` that stays inside whole-stage codegen.  The
regular expressions are written in the common subset of Java regex (Spark) and
RE2 (DuckDB, used by the oracle SQL), so the same pattern string serves both.
"""

from __future__ import annotations

import string
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace exactly as Python's ``str.isspace`` / ``str.strip()`` define it.
# Spark's ``trim`` only removes U+0020 and Java's ``\s`` misses U+001C-U+001F,
# so the class is spelled out.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_CHARS_BODY = WS_CLASS[1:-1]
STRIP_PATTERN = rf"\A{WS_CLASS}+|{WS_CLASS}+\z"


# Every code point for which ``str.isspace()`` holds (derived from the running
# interpreter, 29 characters); the same set as ``WS_CLASS``.
PY_WHITESPACE = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


def ustrip(col: Column | str) -> Column:
    """Python ``str.strip()`` on a string column (null stays null).

    ``TRIM(BOTH <set> FROM s)`` removes any character of the set from both
    ends, which is exactly ``strip()`` for Python's whitespace set, and runs
    several times faster than an anchored regex.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(PY_WHITESPACE))


def ws_collapse(col: Column) -> Column:
    """Python ``re.sub(r'\\s+', ' ', s)`` (Unicode whitespace runs to one space)."""
    return F.regexp_replace(col, f"{WS_CLASS}+", " ")


def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in codepoints:
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _class_body(ranges: list[tuple[int, int]]) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append(rf"\x{{{lo:X}}}" if lo == hi else rf"\x{{{lo:X}}}-\x{{{hi:X}}}")
    return "".join(parts)


@lru_cache(maxsize=1)
def python_digit_class_body() -> str:
    """Character-class body for every code point where ``str.isdigit()`` is true.

    Built from the running interpreter's Unicode tables (a rule, not a copied
    list), so it matches Python's notion of digits, including superscripts and
    circled numbers that ``\\p{Nd}`` misses.
    """
    cps = [cp for cp in range(sys.maxunicode + 1) if chr(cp).isdigit()]
    return _class_body(_ranges(cps))


# The Japanese script ranges counted by the share metric
# (Hiragana, Katakana, CJK unified ideographs), inclusive code point bounds.
JAPANESE_RANGES = [(0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF)]


@lru_cache(maxsize=1)
def ascii_punct_class_body() -> str:
    return _class_body(_ranges(sorted(ord(c) for c in string.punctuation)))


@lru_cache(maxsize=1)
def japanese_or_acceptable_class() -> str:
    """Class matching a Japanese character, ASCII punctuation or a Python digit."""
    return "[" + _class_body(JAPANESE_RANGES) + ascii_punct_class_body() + python_digit_class_body() + "]"


@lru_cache(maxsize=1)
def japanese_or_acceptable_chars() -> str:
    """Every code point counted by the share metric, as one string (for ``translate``)."""
    cps = set()
    for lo, hi in JAPANESE_RANGES:
        cps.update(range(lo, hi + 1))
    cps.update(ord(c) for c in string.punctuation)
    cps.update(cp for cp in range(sys.maxunicode + 1) if chr(cp).isdigit())
    return "".join(chr(cp) for cp in sorted(cps))


def count_in_set(col: Column, chars: str) -> Column:
    """Number of code points of ``col`` that belong to ``chars``.

    ``translate`` deletes them with one hash lookup per character, which is
    several times faster than a regex class with many ranges.
    """
    return F.length(col) - F.length(F.translate(col, chars, ""))


def sql_str(s: str) -> str:
    """Quote a Python string as an ANSI SQL literal (for generated oracle SQL)."""
    return "'" + s.replace("'", "''") + "'"
