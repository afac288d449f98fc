"""Preference (DPO) data: layouts, prompt splits and single-text rendering (PRF1-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at
from . import render
from .index import with_row_index


def full_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """PRF1/PRF7: pass-through full chosen/rejected conversations under the fixed names."""
    return df.select(*keep, F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def append_pairs(df: DataFrame, conv: str = "conversations", chosen: str = "chosen",
                 rejected: str = "rejected", layout: str = "append") -> DataFrame:
    """PRF2/PRF3: ``conversations + [chosen]`` / ``+ [rejected]``; ``layout='message'``
    keeps only the final message on each side (the instruction-source variant)."""
    if layout == "append":
        c = F.concat(F.col(conv), F.array(F.col(chosen)))
        r = F.concat(F.col(conv), F.array(F.col(rejected)))
    elif layout == "message":
        c, r = F.array(F.col(chosen)), F.array(F.col(rejected))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return df.withColumn("chosen", c).withColumn("rejected", r)


def prompt_split(chosen: Column, rejected: Column, template=render.chatml) -> Column:
    """PRF5: ``struct<prompt, chosen, rejected>``: rendered all-but-last of chosen and the
    last message text of each side."""
    prompt_turns = F.slice(chosen, 1, F.greatest(F.size(chosen) - 1, F.lit(0)))
    return F.struct(template(prompt_turns).alias("prompt"),
                    at(chosen, -1)["content"].alias("chosen"),
                    at(rejected, -1)["content"].alias("rejected"))


def single_text(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """PRF6: ``prompt + '\\n### CHOSEN:\\n' + c + '\\n### REJECTED:\\n' + r`` (one JSON row per pair)."""
    return F.concat(prompt, F.lit("\n### CHOSEN:\n"), chosen, F.lit("\n### REJECTED:\n"), rejected)


def pairs_from_conversations(nested: DataFrame, id_col: str = "conv_id", conv: str = "conversations") -> DataFrame:
    """Derived ``pref_append`` rows: conversations ending on an assistant turn; prompt =
    all but the last turn, chosen = the last turn, rejected = the first assistant
    turn of the next such conversation in ``id_col`` order.

    The "next" conversation comes from the distributed row index and an
    equi-join on ``position + 1`` (no global window, no cross join).
    """
    q = nested.where(at(F.col(conv), -1)["role"] == "assistant")
    first_assistant = at(F.filter(F.col(conv), lambda t: t["role"] == "assistant"), 1)
    # only the key and the one turn the neighbour needs are indexed (narrow)
    keys = with_row_index(q.select(id_col, first_assistant.alias("_fa")), [id_col], name="_k")
    link = (keys.alias("a").join(keys.select((F.col("_k") - 1).alias("_k"), F.col("_fa").alias("rejected")), "_k")
            .select(id_col, "rejected"))
    return (q.join(link, id_col)
            .select(id_col,
                    F.slice(F.col(conv), 1, F.size(F.col(conv)) - 1).alias("conversations"),
                    at(F.col(conv), -1).alias("chosen"),
                    "rejected"))
