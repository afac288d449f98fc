"""Corpus metrics (AGG1-4): Japanese-character share and chars-per-token tables.

All metrics are additive (character and token counts), so they aggregate
partially on the map side and the final division happens once per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_in_set, japanese_or_acceptable_chars
from ..functions.tokenize import COUNTERS


def japanese_counts(text: Column) -> tuple[Column, Column]:
    """(code points, counted code points) of one text for the share metric."""
    return F.length(text), count_in_set(text, japanese_or_acceptable_chars())


def japanese_share(df: DataFrame, text_col: str, group_cols: Sequence[str]) -> DataFrame:
    """AGG1: share of Japanese / punctuation / digit characters per group.

    Equivalent to concatenating every text of the group and measuring once;
    the percentage is formed as ``100 - non_japanese%`` like the original
    (an empty group gives 100).
    """
    n, k = japanese_counts(F.col(text_col))
    agg = df.groupBy(*group_cols).agg(F.sum(n).alias("total_chars"), F.sum(k).alias("counted_chars"))
    non = F.when(F.col("total_chars") > 0,
                 (F.col("total_chars") - F.col("counted_chars")) / F.col("total_chars") * F.lit(100.0)).otherwise(F.lit(0.0))
    return agg.withColumn("japanese_pct", F.lit(100.0) - non)


def answer_texts(answers: DataFrame) -> DataFrame:
    """Flatten ``choices[].turns[]`` of answer rows to one text per row (for AGG1)."""
    return (answers.select("*", F.explode("choices").alias("_c"))
            .select("*", F.explode("_c.turns").alias("turn_text")).drop("_c"))


def chars_per_token(df: DataFrame, text_col: str, counter: str = "regex-word",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG2/AGG3: ``n_chars / n_tokens`` (0.0 when there are no tokens)."""
    count, _ = COUNTERS[counter]
    agg = df.groupBy(*group_cols).agg(F.sum(F.length(text_col)).alias("n_chars"),
                                      F.sum(count(F.col(text_col))).alias("n_tokens"))
    return agg.withColumn("chars_per_token", F.coalesce(
        F.col("n_chars") / F.nullif(F.col("n_tokens"), F.lit(0)), F.lit(0.0)))


def tokenizer_table(df: DataFrame, text_col: str, counters: Sequence[str] = tuple(COUNTERS)) -> DataFrame:
    """AGG4: one row per tokenizer (name, vocab size, chars, tokens, ratio), best first.

    All tokenizers are measured in the same single scan (one aggregate with a
    column per tokenizer), then unpivoted.
    """
    aggs = [F.sum(F.length(text_col)).alias("n_chars")]
    for name in counters:
        count, _ = COUNTERS[name]
        aggs.append(F.sum(count(F.col(text_col))).alias(f"t_{len(aggs)}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("tokenizer"), F.lit(COUNTERS[name][1]).alias("vocab_size"),
                     F.col(f"t_{i + 1}").alias("n_tokens")) for i, name in enumerate(counters)]
    long = wide.select("n_chars", F.explode(F.array(*rows)).alias("r")).select("n_chars", "r.*")
    return (long.withColumn("chars_per_token", F.coalesce(F.col("n_chars") / F.nullif(F.col("n_tokens"), F.lit(0)),
                                                          F.lit(0.0)))
            .orderBy(F.desc("chars_per_token"), "tokenizer"))


def skip_cached(candidates: DataFrame, cache: DataFrame, key: str = "tokenizer") -> DataFrame:
    """AGG4 cache: measure only tokenizers without a cached result."""
    return candidates.join(cache.select(key), key, "left_anti")
