"""Dataset QA: trainability scan, summaries, status codes, stage counts.

FLT4-5, FLT8, AGG5-8.  The scan needs only the *last* role and the number of
turns of each example, so on flat turn tables it aggregates with ``max_by``
and ``count`` (map-side partial aggregation, safe under any key skew); on
nested tables it is a pure projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import at
from .index import with_row_index
from .turns import MESSAGE_COLUMN_CANDIDATES, infer_message_column

DEFAULT_ROLES_TO_TRAIN = ("assistant",)


def last_turn_not_trainable(size: Column, last_role: Column, roles_to_train: Sequence[str]) -> Column:
    """FLT4: empty -> False; otherwise ``last_role NOT IN roles`` with null counted as not trainable."""
    return F.when(size > 0, ~F.coalesce(last_role.isin(*roles_to_train), F.lit(False))).otherwise(F.lit(False))


def message_info(df: DataFrame, candidates: Sequence[str] = MESSAGE_COLUMN_CANDIDATES) -> Column:
    """FLT5: ``struct<is_chat, n_turns, last_role>`` from the first list-valued candidate column.

    A candidate that is null in a row falls through to the next candidate; a
    turn struct without ``role`` yields a null last role.
    """
    present = infer_message_column(df, candidates)
    infos = []
    for c in present:
        st = df.schema[c].dataType.elementType
        has_role = isinstance(st, T.StructType) and "role" in st.fieldNames()
        last_role = at(F.col(c), -1)["role"] if has_role else F.lit(None).cast("string")
        last_role = F.when(F.size(c) > 0, last_role)
        infos.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(True).alias("is_chat"),
                                                           F.size(c).alias("n_turns"),
                                                           last_role.alias("last_role"))))
    none = F.struct(F.lit(False).alias("is_chat"), F.lit(0).alias("n_turns"),
                    F.lit(None).cast("string").alias("last_role"))
    return F.coalesce(*infos, none) if infos else none


def scan_flags(df: DataFrame, roles_to_train: Sequence[str] = DEFAULT_ROLES_TO_TRAIN) -> DataFrame:
    """Add ``is_chat, n_turns, last_role, not_trainable`` to a nested dataset."""
    info = message_info(df)
    out = df.withColumn("_info", info)
    return (out.withColumn("is_chat", F.col("_info.is_chat"))
            .withColumn("num_turns", F.col("_info.n_turns").cast("long"))
            .withColumn("last_role", F.col("_info.last_role"))
            .withColumn("not_trainable", F.col("is_chat") & last_turn_not_trainable(
                F.col("num_turns"), F.col("last_role"), roles_to_train))
            .drop("_info"))


def _flagged_union(datasets: Mapping[str, DataFrame], order_cols: Mapping[str, Sequence[str]],
                   roles_to_train: Sequence[str]) -> DataFrame:
    flagged = []
    for name, df in datasets.items():
        # an example table that was scanned flat (see ``flat_scan``) already has its flags
        f = df if {"num_turns", "last_role", "not_trainable"} <= set(df.columns) else scan_flags(df, roles_to_train)
        order = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols[name])])
        flagged.append(f.select(F.lit(name).alias("dataset"), order.alias("_order"),
                                "num_turns", "last_role", "not_trainable"))
    allrows = flagged[0]
    for f in flagged[1:]:
        allrows = allrows.unionByName(f)
    return allrows


def python_round(x: Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` on doubles (half-even on the exact binary value).

    Spark's ``bround`` rounds the shortest decimal form of the double, which
    differs on values such as 0.0025.  Used on summary tables (one row per
    dataset), where an Arrow UDF costs nothing.
    """
    @F.pandas_udf(T.DoubleType())
    def _round(v: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else round(float(a), digits) for a in v], dtype="float64")

    return _round(x)


def scan_summary(datasets: Mapping[str, DataFrame], order_cols: Mapping[str, Sequence[str]],
                 roles_to_train: Sequence[str] = DEFAULT_ROLES_TO_TRAIN) -> DataFrame:
    """AGG5: dataset, total_rows, bad_rows, percent_bad (``round(100*bad/total, 3)``
    half-even, 0.0 when empty), sorted by percent_bad descending (MIX18)."""
    allrows = _flagged_union(datasets, order_cols, roles_to_train)
    return (allrows.groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("not_trainable").alias("bad_rows"))
            .withColumn("percent_bad", F.when(F.col("total_rows") > 0,
                                              python_round(F.lit(100.0) * F.col("bad_rows") / F.col("total_rows"), 3))
                        .otherwise(F.lit(0.0)))
            .orderBy(F.desc("percent_bad"), "dataset"))


def scan_problems(datasets: Mapping[str, DataFrame], order_cols: Mapping[str, Sequence[str]],
                  roles_to_train: Sequence[str] = DEFAULT_ROLES_TO_TRAIN) -> DataFrame:
    """AGG6: dataset, row_id (0-based position in ``order_cols`` order), last_role,
    num_turns of every flagged row; positions come from the distributed row index."""
    allrows = _flagged_union(datasets, order_cols, roles_to_train)
    indexed = with_row_index(allrows, ["_order"], ["dataset"], name="row_id")
    return indexed.where("not_trainable").select("dataset", "row_id", "last_role", "num_turns")


def scan_datasets(datasets: Mapping[str, DataFrame], order_cols: Mapping[str, Sequence[str]],
                  roles_to_train: Sequence[str] = DEFAULT_ROLES_TO_TRAIN) -> tuple[DataFrame, DataFrame]:
    """AGG5 + AGG6: ``(summary, problems)`` over named datasets."""
    return (scan_summary(datasets, order_cols, roles_to_train),
            scan_problems(datasets, order_cols, roles_to_train))


def flat_scan(flat: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
              roles_to_train: Sequence[str] = DEFAULT_ROLES_TO_TRAIN) -> DataFrame:
    """FLT4 on a flat turn table: one row per example from partial aggregates only."""
    return (flat.groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("num_turns"), F.max_by(F.col(role_col), F.col(order_col)).alias("last_role"))
            .withColumn("not_trainable", last_turn_not_trainable(F.col("num_turns"), F.col("last_role"), roles_to_train)))


# --------------------------------------------------------------------------- FLT8 status codes

def document_status(conversations: Column, text: Column, n_tokens: Column,
                    tokenizer_error: Column | None = None) -> Column:
    """FLT8: tokenizer_setup_error: ... (whole batch) / empty_conversations /
    empty_formatted_text / tokenization_error: ... / empty_tokens / success.

    ``tokenizer_error`` carries the full status text produced by the encoder.
    """
    status = None
    if tokenizer_error is not None:
        status = F.when(tokenizer_error.startswith("tokenizer_setup_error"), tokenizer_error)
    empty_conv = conversations.isNull() | (F.size(conversations) == 0)
    status = (F.when(empty_conv, F.lit("empty_conversations")) if status is None
              else status.when(empty_conv, F.lit("empty_conversations")))
    status = status.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("empty_formatted_text"))
    if tokenizer_error is not None:
        status = status.when(tokenizer_error.isNotNull(), tokenizer_error)
    return status.when(F.coalesce(n_tokens, F.lit(0)) == 0, F.lit("empty_tokens")).otherwise(F.lit("success"))


# --------------------------------------------------------------------------- AGG7 / AGG8

def source_counts(df: DataFrame, source_col: str = "source", epochs: int = 3, batch: int = 512) -> DataFrame:
    """AGG7: rows per source plus a total row (``source`` null) and estimated steps."""
    return (df.rollup(source_col).agg(F.count(F.lit(1)).alias("n_samples"))
            .withColumn("est_steps", F.floor(F.col("n_samples") * epochs / batch).cast("long")))


def observed(df: DataFrame, name: str, **metrics: Column):
    """AGG8: attach named row-count metrics collected by the job itself (no extra pass).

    Returns ``(df, observation)``; ``observation.get`` is filled after an action.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    exprs = [m.alias(k) for k, m in metrics.items()] or [F.count(F.lit(1)).alias("rows")]
    return df.observe(obs, *exprs), obs
