"""Mixing sources to target weights by capped water-filling.

The word budget is shared by weight; a source whose share exceeds
``max_epochs`` times its size is clamped there and the excess goes to the
others by weight, until none is above.  Sorting the sources by (cap / weight)
makes the clamped ones a prefix of that order, so the fixed point of the
clamp-and-reshare rounds is one running sum over the table of sources.

A source then repeats every document ``floor(target / size)`` times; the rest
of its target is drawn without replacement in the order of a seeded hash:
documents below a cut are taken once more.  The cut is found by histograms of
the hash, refined around the boundary (radix selection): each round is one
aggregation of a narrow table, no document is sorted or moved, and the taken
words miss the target by at most half of one document.

Null text has no words.  Null is a source of its own, after all others.
Sources without words get no words and are left out of the mix.  Rows that
share an id share one draw (they are taken together).  An empty table gives
an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_BITS, _STEP = 60, 12


def word_count(text: str | Column = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text,
                                     F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(key: str, seed: int) -> Column:
    """Uniform 60-bit number from the seed and an id: the first 15 hex digits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, weights: Sequence[float], source_col: str = "source") -> DataFrame:
    """``weight`` by code-point order of the source (null last), repeating ``weights``."""
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(values, (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """Add ``target`` to one row per source (``source_size``, ``weight``)."""
    cap = F.when(F.col("weight") > 0, F.col("source_size") * F.lit(float(max_epochs))).otherwise(F.lit(0.0))
    everything = Window.partitionBy()
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(everything).cast("double")
    t = sources.withColumn("_cap", cap).withColumn("_total", total)
    by_ratio = Window.orderBy(F.expr("_cap / nullif(weight, 0)").asc_nulls_first(), "_cap", "weight")
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("_clamped", F.col("_cap") * left <= F.col("weight") * (F.col("_total") - before))
    spent = F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("_cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_clamped"), F.col("weight"))).over(everything)
    level = (F.col("_total") - spent) / open_weight
    return (t.withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("weight") * level))
            .drop("_cap", "_total"))


def _plan(sizes: DataFrame, targets: DataFrame, max_epochs: float) -> DataFrame:
    """Per source: whole repetitions, and the draw below which documents get one more."""
    share = F.col("target") / F.expr("nullif(source_size, 0)")
    whole = F.when(F.col("_clamped"), F.floor(F.lit(float(max_epochs)))).otherwise(F.floor(share))
    plan = (targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
            .withColumn("_want", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumn("_prefix", F.lit(0).cast("long")).withColumn("_open", F.col("_want") > 0)
            .withColumn("cut", F.lit(0).cast("long")))
    plan = materialize(plan, "mix-plan")
    for level in range(_BITS // _STEP):
        high, low = _BITS - _STEP * level, _BITS - _STEP * (level + 1)
        cells = (sizes.join(plan.where("_open").select(F.col("source").alias("_s"), "_prefix"),
                            sizes["source"].eqNullSafe(F.col("_s")))
                 .where(F.shiftright("draw", high) == F.col("_prefix"))
                 .groupBy("_s", F.shiftright("draw", low).alias("_cell"))
                 .agg(F.sum("size").alias("_size"), F.count_distinct("draw").alias("_draws")))
        order = Window.partitionBy("_s").orderBy("_cell")
        cells = cells.withColumn("_upto", F.sum("_size").over(order))
        found = (cells.join(plan.select(F.col("source").alias("_p"), "_want"), F.col("_s").eqNullSafe(F.col("_p")))
                 .where(F.col("_upto") >= F.col("_want")).groupBy("_s")
                 .agg(F.min(F.struct("_cell", "_upto", "_size", "_draws")).alias("_at")))
        left = F.col("_want") - (F.col("_at._upto") - F.col("_at._size"))
        done = (F.col("_at._draws") <= 1) | F.lit(low == 0)
        more = (done & (2 * left >= F.col("_at._size"))).cast("long")
        edge = F.col("_at._cell") + F.when(done, more).otherwise(F.lit(0).cast("long"))
        refined = F.col("_open") & F.col("_at").isNotNull()
        # a source whose words never reach the rest takes all its documents once more
        nothing = F.col("_open") & F.col("_at").isNull()
        plan = materialize(
            plan.join(found, plan["source"].eqNullSafe(found["_s"]), "left")
            .withColumn("cut", F.when(refined, edge * F.lit(1 << low)).when(nothing, F.lit(1 << _BITS))
                        .otherwise(F.col("cut")))
            .withColumn("_want", F.when(refined, left).otherwise(F.col("_want")))
            .withColumn("_prefix", F.when(refined, F.col("_at._cell")).otherwise(F.col("_prefix")))
            .withColumn("_open", refined & ~done)
            .select("source", "source_size", "target", "whole", "_want", "_prefix", "_open", "cut"), "mix-plan")
        if plan.where("_open").isEmpty():
            break
    return plan.select("source", "source_size", "target", "whole", "cut")


def mix_plan(docs: DataFrame, weights: Sequence[float], max_epochs: float = 3, budget: float | None = None,
             seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): ``doc_id, source, size, draw`` of every document, and one row per source."""
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size"), draw(id_col, seed).alias("draw")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(cycled_weights(sources, weights), max_epochs, budget)
    return sizes, _plan(sizes, targets, max_epochs)


def _times() -> Column:
    return F.col("whole") + (F.col("draw") < F.col("cut")).cast("long")


def mix_report(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    p = plan.withColumnRenamed("source", "_source")
    return (sizes.join(p, sizes["source"].eqNullSafe(p["_source"]), "left")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken")))


def mix_documents(docs: DataFrame, plan: DataFrame, seed: int = 17, id_col: str = "doc_id",
                  source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    p = plan.select(F.col("source").alias("_mix_source"), "whole", "cut")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(own, F.col(source_col).alias("_own_source"), draw(id_col, seed).alias("draw"))
    joined = keyed.join(p, F.col("_own_source").eqNullSafe(F.col("_mix_source")))
    return (joined.withColumn("_times", _times()).where("_times > 0")
            .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
            .select("_row.*"))
