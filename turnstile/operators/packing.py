"""Whole-sample packing (TOK5) planned on the table of lengths.

Samples of one length are interchangeable, so the packing is planned on (length, count): at most ``capacity`` rows, which
one partial aggregation gives.  The plan is a list of *bin patterns* (lengths with the number of samples of each) and how
many bins follow a pattern; rows then get their bin from their place among the rows of their length.  One packing over the
whole table therefore needs two scans of (id, length), one range exchange of these pairs, and no group whose size grows
with the table: equal lengths are numbered by range partitions, and the bin of a row is a binary search in the broadcast
plan.

A pattern is filled with the longest samples that still fit, as first-fit decreasing would fill that bin, and is repeated
until one of its lengths runs out: the plan is the first-fit decreasing packing of all samples (never above 11/9 of the
least number of bins plus one), without a step for each sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import with_row_index


@dataclass
class PackPlan:
    """Runs of equal-length rows, sorted by (length, first place): ``uses`` rows of the run go to each bin from ``bin`` on."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    uses: np.ndarray
    bins: int

    def bins_of(self, length: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bin of the rows at these places (from 0) among the rows of their length."""
        shift = np.int64(1) << np.int64(40)
        run = np.searchsorted(self.length * shift + self.first, length * shift + place, "right") - 1
        return self.bin[run] + (place - self.first[run]) // self.uses[run]


def plan_bins(lengths: dict[int, int], capacity: int, max_samples: int | None = None) -> PackPlan:
    """Patterns for ``lengths`` (length -> number of samples; 0 < length <= capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] = n
    below = list(range(capacity + 1))               # below[x]: longest length <= x that is left, found by path halving

    def longest(x: int) -> int:
        while below[x] != x:
            below[x] = below[below[x]]
            x = below[x]
        return x

    def gone(length: int) -> None:
        below[length] = length - 1

    for length in range(1, capacity + 1):
        if not left[length]:
            gone(length)
    taken = np.zeros(capacity + 1, np.int64)
    runs, bins = [], 0
    while (top := longest(capacity)) > 0:
        pattern, room, places = [], capacity, max_samples or capacity
        while top > 0 and places:
            uses = min(int(left[top]), room // top, places)
            pattern.append((top, uses))
            room, places = room - uses * top, places - uses
            top = longest(min(room, top - 1))
        times = min(int(left[length]) // uses for length, uses in pattern)
        for length, uses in pattern:
            runs.append((length, int(taken[length]), bins, uses))
            taken[length] += uses * times
            left[length] -= uses * times
            if not left[length]:
                gone(length)
        bins += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return PackPlan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], bins)


def least_bins(lengths: dict[int, int], capacity: int) -> int:
    """A lower bound of the number of bins: by total length, and by the samples too long to share a bin."""
    if not lengths:
        return 0
    size = np.array(sorted(lengths), np.int64)
    count = np.array([lengths[x] for x in size.tolist()], np.int64)
    best = -(-int((size * count).sum()) // capacity)
    for small in size[size <= capacity // 2].tolist():
        alone = int(count[size > capacity - small].sum())
        half = (size > capacity / 2) & (size <= capacity - small)
        rest = (size >= small) & (size <= capacity / 2)
        over = int((size * count)[rest].sum()) - int(((capacity - size) * count)[half].sum())
        best = max(best, alone + int(count[half].sum()) + max(0, -(-over // capacity)))
    return max(best, int(count[size > capacity / 2].sum()))


def sample_pack(df: DataFrame, id_col: str, len_col: str, capacity: int, shard: Column | None = None,
                over_long: str = "flag", max_samples: int | None = None) -> DataFrame:
    """TOK5: ``id, n, bin, over_long``: whole samples in bins of ``capacity`` tokens, numbered from 0.

    Every sample lands in one bin and no bin exceeds ``capacity`` tokens (or ``max_samples`` samples).  Samples longer
    than ``capacity`` have no bin and are flagged, or count as ``capacity`` tokens with ``over_long="truncate"``.  A
    sample without tokens or without a length has no bin either.  Bins of one table mix all samples; ``shard`` (a few
    values, for example ranks) keeps shards apart and is returned as ``group``.
    """
    length = F.col(len_col).cast("long")
    if over_long == "truncate":
        length = F.least(length, F.lit(capacity))
    rows = df.select(F.col(id_col).cast("long").alias("id"), length.alias("n"), (F.lit(0) if shard is None else shard).alias("group"))
    fits = F.col("n").between(1, capacity)
    counts = rows.where(fits).groupBy("group", "n").agg(F.count(F.lit(1)).alias("c")).collect()   # at most ``capacity`` rows a shard
    plans, bins = {}, 0
    for group in sorted({r["group"] for r in counts}, key=lambda g: (g is not None, g)):
        plans[group] = plan_bins({r["n"]: r["c"] for r in counts if r["group"] == group}, capacity, max_samples)
        plans[group].bin += bins
        bins += plans[group].bins
    shared = rows.sparkSession.sparkContext.broadcast(plans)

    @F.pandas_udf("long")
    def bin_of(group: pd.Series, n: pd.Series, place: pd.Series) -> pd.Series:
        out = np.zeros(len(n), np.int64)
        for name, plan in shared.value.items():
            mine = (group.isna() if name is None else group == name).to_numpy()
            if mine.any():
                out[mine] = plan.bins_of(n.to_numpy()[mine], place.to_numpy()[mine])
        return pd.Series(out)

    placed = (with_row_index(rows.where(fits), ["id"], ["group", "n"], name="_place")
              .withColumn("bin", bin_of("group", "n", "_place")))
    rest = rows.where(~F.coalesce(fits, F.lit(False))).withColumn("bin", F.lit(None).cast("long"))
    names = ["id", "n", *(["group"] if shard is not None else []), "bin"]
    return (placed.select(*names).unionByName(rest.select(*names))
            .withColumn("over_long", F.coalesce(F.col("n") > capacity, F.lit(False))))


def packed_sequences(store: DataFrame, packed: DataFrame, id_col: str = "doc_idx", ids_col: str = "token_ids") -> DataFrame:
    """The sequences themselves: ``bin, input_ids, position_ids, sample_ids, lengths``.

    Samples follow each other in id order; positions start again at every sample, ``lengths`` are the sample edges an
    attention mask needs.  A bin holds at most ``capacity`` tokens, so its row is bounded.
    """
    edges = packed.where(F.col("bin").isNotNull()).select(F.col("id").alias("_id"), "bin", "n")
    one = F.struct(F.col("_id").alias("id"), F.slice(ids_col, F.lit(1), F.col("n").cast("int")).alias("ids"))
    bins = (store.join(edges, F.col(id_col) == F.col("_id")).groupBy("bin").agg(F.array_sort(F.collect_list(one)).alias("s")))
    positions = F.transform("s", lambda s: F.sequence(F.lit(0), F.size(s["ids"]) - 1))
    return bins.select("bin", F.flatten("s.ids").alias("input_ids"), F.flatten(positions).alias("position_ids"),
                       F.col("s.id").alias("sample_ids"), F.transform("s", lambda s: F.size(s["ids"])).alias("lengths"))
