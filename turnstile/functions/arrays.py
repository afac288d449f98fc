"""Array helpers that stay null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(arr: Column | str, index: int | Column) -> Column:
    """1-based element (negative counts from the end); null when out of range."""
    a = F.col(arr) if isinstance(arr, str) else arr
    i = F.lit(index) if isinstance(index, int) else index
    return F.try_element_at(a, i)
