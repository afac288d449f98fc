"""Leaderboard tables (LB1-5): ordering by class, tuned-vs-base deltas, license
imputation, label clean-up and style classes, all as Column rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model size classes in display order.
CLASS_ORDER = ("8B", "13B", "30B", "70B")

# License rules for rows without a license, tested in order
# (substrings of the lower-cased model name).
LICENSE_RULES = [
    (("llama-3.1",), "Llama 3.1"),
    (("llama-3.3",), "Llama 3.3"),
    (("mistral", "qwen"), "Apache 2.0"),
    (("deepseek", "phi"), "MIT"),
    (("gpt",), "Proprietary"),
]

# Label rename applied after the org prefix is removed.
LABEL_RENAMES = {"meti-geniac-405b-dpo.jury": "meti-geniac-405b-dpo"}

# Style classes (colour, marker size) by substring, in order; the
# highlighted model family (a caller parameter) is tested first.
HIGHLIGHT_STYLE = ("deeppink", 60)
STYLE_RULES = [
    ("meti-geniac-405b", "red", 60),
    ("405b-instruct", "skyblue", 60),
    ("gpt", "black", 40),
]
DEFAULT_STYLE = ("lightgrey", 30)


def class_rank(cls: Column, order: Sequence[str] = CLASS_ORDER) -> Column:
    m = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    return m[cls]


def order_by_class(df: DataFrame, highlight: str, class_col: str = "class", score_col: str = "ja_avg",
                   name_col: str = "model") -> DataFrame:
    """LB1: sort by class order then score; flag models whose lower-cased name
    contains the ``highlight`` family substring."""
    return (df.withColumn("class_rank", class_rank(F.col(class_col)))
            .withColumn("highlight", F.lower(F.col(name_col)).contains(highlight))
            .orderBy("class_rank", score_col, name_col))


def tuned_vs_base(pairs: DataFrame) -> DataFrame:
    """LB2: improvement of each tuned model over its base."""
    return pairs.withColumn("delta", F.col("tuned_ja") - F.col("base_ja"))


def impute_license(license_col: Column, name_col: Column) -> Column:
    """LB3: keep a present license, else the first matching name rule."""
    name = F.lower(name_col)
    rule = None
    for needles, lic in LICENSE_RULES:
        cond = None
        for n in needles:
            c = name.contains(n)
            cond = c if cond is None else cond | c
        rule = F.when(cond, F.lit(lic)) if rule is None else rule.when(cond, F.lit(lic))
    return F.when(F.length(license_col) > 0, license_col).otherwise(rule)


def clean_label(name_col: Column) -> Column:
    """LB4: drop the org prefix before the first ``/``, then the special rename."""
    stripped = F.when(name_col.contains("/"), F.regexp_extract(name_col, r"^[^/]*/(.*)$", 1)).otherwise(name_col)
    m = F.create_map(*[F.lit(x) for kv in LABEL_RENAMES.items() for x in kv])
    return F.coalesce(m[stripped], stripped)


def style_class(name_col: Column, highlight: str) -> Column:
    """LB5: ``struct<color, size>`` from ordered substring rules (highlighted family first)."""
    name = F.lower(name_col)
    color = size = None
    for needle, c, s in [(highlight.lower(), *HIGHLIGHT_STYLE), *STYLE_RULES]:
        cond = name.contains(needle)
        color = F.when(cond, F.lit(c)) if color is None else color.when(cond, F.lit(c))
        size = F.when(cond, F.lit(s)) if size is None else size.when(cond, F.lit(s))
    return F.struct(color.otherwise(F.lit(DEFAULT_STYLE[0])).alias("color"),
                    size.otherwise(F.lit(DEFAULT_STYLE[1])).alias("size"))
