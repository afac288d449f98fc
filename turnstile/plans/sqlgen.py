"""SQL fragments for the DuckDB oracle, generated from the same constants as the
Spark operators so both sides always agree on patterns and literal maps."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions.text import STRIP_PATTERN, WS_CLASS, sql_str

NL = "chr(10)"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str(STRIP_PATTERN)}, '', 'g')"


def ws_collapse(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str(WS_CLASS + '+')}, ' ', 'g')"


def case_map(expr: str, mapping: Mapping[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in sorted(mapping.items()))
    return f"(CASE {expr} {whens} ELSE {default} END)"


def regex_count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {sql_str(pattern)}))"


def class_count(expr: str, char_class: str) -> str:
    """Number of characters of ``expr`` inside ``char_class`` (``[...]``)."""
    negated = "[^" + char_class[1:]
    return f"length(regexp_replace({expr}, {sql_str(negated)}, '', 'g'))"
