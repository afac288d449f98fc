"""Driver tables and the conversation layouts derived from them.

The driver ships ``conversations`` flat (``conv_id, turn, role, text``).  The
reference works on nested conversations, so the first step of most plans is a
``groupBy(conv_id)`` that nests the turns in ``turn`` order.  A conversation is
a bounded record (a handful of turns); the nesting is a partial
``collect_list`` per key.  Operators that only need *one* value per
conversation (the last role, a count) use ``max_by``/``count`` on the flat
table instead, which aggregate map-side and are safe for any key skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nest_turns(flat: DataFrame, id_col: str = "conv_id", order_col: str = "turn",
               role_col: str = "role", content_col: str = "text",
               out: str = "conversations", role_field: str = "role",
               content_field: str = "content") -> DataFrame:
    """Flat turn rows -> one row per conversation with an ordered turn array."""
    packed = F.struct(F.col(order_col).alias("o"), F.col(role_col).alias("r"), F.col(content_col).alias("c"))
    return (flat.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(packed)).alias("_t"))
            .select(id_col, F.transform("_t", lambda t: F.struct(t["r"].alias(role_field),
                                                                  t["c"].alias(content_field))).alias(out)))


def conversations_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_messages`` layout: ``conv_id, conversations ARRAY<STRUCT<role,content>>``."""
    return nest_turns(load_table(spark, sf_dir, "conversations"))


# The ShareGPT role names used when the driver table is written
# in the {from, value} layout.
SHAREGPT_ROLE_NAMES = {"user": "human", "assistant": "gpt", "system": "system"}


def conversations_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_sharegpt`` layout: turns ``{from, value}`` with human/gpt role names.

    Derived from the same nested DataFrame as ``conversations_nested`` (a
    ``transform`` over the turns), so plans using both layouts share one
    exchange.
    """
    m = F.create_map(*[F.lit(x) for kv in SHAREGPT_ROLE_NAMES.items() for x in kv])
    nested = conversations_nested(spark, sf_dir)
    return nested.select("conv_id", F.transform("conversations", lambda t: F.struct(
        F.coalesce(m[t["role"]], t["role"]).alias("from"), t["content"].alias("value"))).alias("conversations"))
