"""Mixing: slices, unions, deterministic shuffles, splits, shards, dedup, caps.

MIX1-19.  Positions inside a source come from ``index.with_row_index`` (range
partitioned, never a single-task window), computed on the key columns only;
the kept rows are then selected from the full table with a broadcast join on
a per-source cutoff whose size (one row per source) is checked first.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .index import with_row_index


class SliceSyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class SliceSpec:
    split: str
    start: float | int | None = None   # percent (float) or absolute row (int); None = from start
    stop: float | int | None = None
    percent: bool = True


_SLICE = re.compile(r"^(?P<split>\w+)(?:\[(?P<a>-?\d+%?)?:(?P<b>-?\d+%?)?\])?$")


def parse_split(split: str) -> SliceSpec:
    """``train``, ``train[:25%]``, ``train[10%:20%]``, ``train[:100]``.  A bracket
    without a colon (``train[10%]``) is rejected (MIX2)."""
    m = _SLICE.match(split.strip())
    if not m:
        raise SliceSyntaxError(f"unsupported split specification: {split!r}")
    a, b = m.group("a"), m.group("b")
    if a is None and b is None:
        return SliceSpec(m.group("split"))
    kinds = {x.endswith("%") for x in (a, b) if x is not None}
    if len(kinds) > 1:
        raise SliceSyntaxError(f"mixed percent and absolute bounds: {split!r}")
    pct = kinds.pop()
    conv = (lambda x: int(x[:-1])) if pct else int
    return SliceSpec(m.group("split"), conv(a) if a else None, conv(b) if b else None, pct)


def _bound_col(value: Column, percent: Column, n: Column, default: Column) -> Column:
    pct_rows = F.bround(value * n / F.lit(100.0), 0)        # closest row, half to even
    v = F.when(value.isNull(), default).when(percent, pct_rows).otherwise(value).cast("long")
    v = F.when(v < 0, n + v).otherwise(v)
    return F.greatest(F.lit(0).cast("long"), F.least(v, n))


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where null is a group like any other."""
    renamed = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_j_{k}" for k in keys])


def slice_rows(df: DataFrame, spec: SliceSpec | str | None, order_cols: Sequence[str],
               group_cols: Sequence[str] = (), per_group: Mapping[object, SliceSpec | str] | None = None) -> DataFrame:
    """MIX1: rows ``[start, stop)`` of each group in ``order_cols`` order.

    ``spec`` applies to every group; ``per_group`` (one group column) maps a
    group value to its own spec and drops groups it does not name.
    ``order_cols`` must be unique inside a group.  Only the keys are indexed;
    the full rows are then kept with a size-checked broadcast join on each
    group's first/last kept key.
    """
    spark = df.sparkSession
    if per_group is None:
        spec = parse_split(spec) if isinstance(spec, str) else spec
        if spec is None or (spec.start is None and spec.stop is None):
            return df
    constant_group = not group_cols
    if constant_group:                       # one group: join on a constant key, never a cross join
        df = df.withColumn("_g", F.lit(0))
        group_cols = ["_g"]
    if per_group is not None:
        if len(group_cols) != 1:
            raise ValueError("per_group slicing needs exactly one group column")
        gtype = df.schema[group_cols[0]].dataType
        rows = []
        for g, sp in per_group.items():
            sp = parse_split(sp) if isinstance(sp, str) else sp
            rows.append((g, None if sp.start is None else float(sp.start),
                         None if sp.stop is None else float(sp.stop), bool(sp.percent)))
        specs = spark.createDataFrame(rows, T.StructType([
            T.StructField(group_cols[0], gtype), T.StructField("_a", T.DoubleType()),
            T.StructField("_b", T.DoubleType()), T.StructField("_pct", T.BooleanType())]))
        df = _join_groups(df, specs.select(group_cols[0]), group_cols, "left_semi")
    else:
        specs = None
    keys = [*group_cols, *order_cols]
    idx = with_row_index(df.select(*keys), order_cols, group_cols, name="_i")
    counts = idx.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    if specs is not None:
        counts = _join_groups(counts, specs, group_cols)
    else:
        counts = (counts.withColumn("_a", F.lit(None if spec.start is None else float(spec.start)).cast("double"))
                  .withColumn("_b", F.lit(None if spec.stop is None else float(spec.stop)).cast("double"))
                  .withColumn("_pct", F.lit(bool(spec.percent))))
    n = F.col("_n")
    bounds = counts.select(*group_cols, _bound_col(F.col("_a"), F.col("_pct"), n, F.lit(0)).alias("_lo"),
                           _bound_col(F.col("_b"), F.col("_pct"), n, n).alias("_hi"))
    kept = (_join_groups(idx, bounds, group_cols)
            .where((F.col("_i") >= F.col("_lo")) & (F.col("_i") < F.col("_hi"))))
    order = F.struct(*[F.col(c) for c in order_cols])
    cut = kept.groupBy(*group_cols).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    out = (_join_groups(df.withColumn("_ord", order), cut, group_cols)
           .where((F.col("_ord") >= F.col("_first")) & (F.col("_ord") <= F.col("_last")))
           .drop("_ord", "_first", "_last"))
    return out.drop("_g") if constant_group else out


def concat_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """MIX3: UNION ALL by column name (no dedup)."""
    if not dfs:
        raise ValueError("no sources to concatenate")
    return reduce(lambda a, b: a.unionByName(b), dfs)


def shuffle_key(key_cols: Sequence[str], seed: int = 42, epoch: Column | None = None) -> Column:
    """Seeded 60-bit key of a row: the first 15 hex digits of the MD5 of ``seed:[epoch:]key:...`` (null is empty)."""
    parts = [F.lit(str(seed))] + ([epoch.cast("string")] if epoch is not None else [])
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def deterministic_shuffle(df: DataFrame, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """MIX5/MIX6: a seeded permutation independent of partitioning (keyed hash, key tiebreak).

    The sort is a distributed range-partitioned sort, not a single task.
    """
    return df.orderBy(shuffle_key(key_cols, seed), *key_cols)


def holdout_flag(key_cols: Sequence[str], fraction: float, seed: int = 42) -> Column:
    """MIX12: stable hash-threshold hold-out flag (not ``randomSplit``)."""
    scale = 1_000_000
    return F.pmod(shuffle_key(key_cols, seed), F.lit(scale)) < F.lit(int(round(fraction * scale)))


def split_boundaries(n: int, weights: Sequence[float]) -> list[int]:
    """MIX13: where contiguous parts begin and end: cumulative sizes, each part's
    share of ``n`` rounded half to even; the last boundary is ``n``, and what
    rounding left over or took too much moves all the others with it."""
    sizes = [round(n * (w / sum(weights))) for w in weights]
    surplus = sum(sizes) - n
    return [0, *(end - surplus for end in accumulate(sizes))]


def _boundary_keys(df: DataFrame, order_cols: Sequence[str], starts: Sequence[int]) -> list:
    """Order keys at the given positions (at most ``len(starts)`` rows reach the driver)."""
    wanted = sorted(set(int(s) for s in starts))
    idx = with_row_index(df.select(*order_cols), order_cols, name="_i")
    rows = idx.where(F.col("_i").isin(wanted)).select("_i", *order_cols).collect()
    return [tuple(r[c] for c in order_cols) for r in sorted(rows, key=lambda r: r["_i"])]


def _range_label(order_cols: Sequence[str], bounds: list) -> Column:
    """0-based number of the last boundary key that is <= the row's key."""
    if not bounds:
        return F.lit(-1)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)])
    arr = F.array(*[F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(b)]) for b in bounds])
    return F.size(F.filter(arr, lambda b: b <= key)) - 1


def contiguous_split(df: DataFrame, weights: Sequence[float], order_cols: Sequence[str],
                     names: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """MIX13: add ``split`` by position thresholds.

    One count and one key-only row index locate the (at most three) boundary
    keys; every row is then labelled by comparing its own key, so the wide
    rows are never copied or joined.
    """
    n = df.count()
    b = split_boundaries(n, weights)
    nonempty = [(k, b[k]) for k in range(len(names)) if b[k] < b[k + 1]]
    bounds = _boundary_keys(df, order_cols, [s for _, s in nonempty])
    label = _range_label(order_cols, bounds)
    expr = F.lit(None).cast("string")
    for j, (k, _) in enumerate(nonempty):
        expr = F.when(label == j, F.lit(names[k])).otherwise(expr)
    return df.withColumn("split", expr)


def shard_contiguous(df: DataFrame, world_size: int, order_cols: Sequence[str], name: str = "shard") -> DataFrame:
    """MIX16: contiguous shard per data-parallel rank; the first ``n % world`` shards get one extra row.

    Shards are key ranges: only the ``world_size`` boundary keys are located
    (key-only row index), then each row is labelled by its key.
    """
    n = df.count()
    div, mod = divmod(n, world_size)
    starts = [i * div + min(i, mod) for i in range(world_size)]
    shard_of_start = {}
    for i, s in enumerate(starts):
        if s < n and (i == world_size - 1 or starts[i + 1] > s):
            shard_of_start[s] = i
    ordered = sorted(shard_of_start)
    bounds = _boundary_keys(df, order_cols, ordered)
    label = _range_label(order_cols, bounds)
    shard = F.lit(None).cast("int")
    for j, s in enumerate(ordered):
        shard = F.when(label == j, F.lit(shard_of_start[s])).otherwise(shard)
    return df.withColumn(name, shard.cast("int"))


def repeat_epochs(df: DataFrame, epochs: int, key_cols: Sequence[str], seed: int = 42,
                  shuffle: bool = True) -> DataFrame:
    """MIX14: ``epochs`` copies with an epoch column (explode, not a cross join);
    each epoch gets its own permutation when ``shuffle``."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if shuffle:
        out = out.orderBy("epoch", shuffle_key(key_cols, seed, F.col("epoch")), *key_cols)
    return out


def last_wins(df: DataFrame, key_col: str, seq_col: str) -> DataFrame:
    """MIX17: keep the last row (highest ``seq_col``) per integer key, sorted by key.

    ``max_by`` aggregates map-side, so a hot key is combined before the shuffle.
    A key that is not an integer fails the job.
    """
    key = F.col(key_col)
    checked = F.when(key.cast("string").rlike(r"^-?\d+$"), key.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("the key of an answer must be a whole number, not "),
                               key.cast("string"))).cast("long"))
    others = [c for c in df.columns if c != key_col]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.withColumn(key_col, checked)
            .groupBy(key_col).agg(F.max_by(packed, F.col(seq_col)).alias("_last"))
            .select(key_col, *[F.col("_last")[c].alias(c) for c in others])
            .orderBy(key_col))


def first_n(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """MIX10/MIX11: the first ``n`` rows in key order (``order_cols`` unique).

    The top-k runs over the key columns only (per-partition top-k, then one
    merge of ``n`` keys); the wide rows are filtered in place by the cutoff key,
    so no task ever holds ``n`` whole rows.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)])
    last = (df.select(key.alias("_k")).orderBy("_k").limit(n)
            .agg(F.max("_k").alias("_cut")).first()["_cut"])
    if last is None:
        return df.limit(0)
    cut = F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(last)])
    return df.where(key <= cut)


def cap_per_group(df: DataFrame, n: int, group_cols: Sequence[str], order_cols: Sequence[str],
                  include: Sequence[str] | str = "all") -> DataFrame:
    """MIX19: choose groups by list or ``'all'``; keep at most ``n`` rows each (``-1`` = all)."""
    out = df
    if include != "all":
        out = out.where(F.col(group_cols[0]).isin(list(include)))
    if n < 0:
        return out
    return slice_rows(out, SliceSpec("train", None, int(n), percent=False), order_cols, group_cols)
