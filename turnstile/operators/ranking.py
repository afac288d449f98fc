"""Ranking of models from pairwise verdicts (JDG17): Bradley-Terry strengths with intervals.

A verdict compares two models.  ``pair_counts`` sums wins and ties for each unordered pair with partial aggregates, so rows
never meet by model; in the same pass every row also counts with a Poisson(1) weight in each of ``replicates`` resamples
(a bootstrap that needs no second look at the rows and no random state: weights come from a hash of the row's key).

Strengths follow from the pair table, whose size is that of the set of pairs and not of the verdicts: rounds of
minorise-maximise, ``p_i = W_i / sum_j n_ij / (p_i + p_j)``, for the counts and all resamples at once.  A tie is half a win
for each side, and every compared pair gets ``prior`` of a win each way, so that a model that never won has a strength too.
Models without any chain of comparisons between them can't be ranked against each other: strengths hold inside a
*component* (mean log strength 0), and the component is reported.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR, REPLICATES, ROUNDS, TOLERANCE = 0.1, 50, 10_000, 1e-10
# Most pairs of models that are brought together: 24 bytes a pair and resample.
MAX_PAIRS = 1 << 20


def poisson_weight(key: Column, replicate: int) -> Column:
    """Poisson(1) number from a hash: how many of the law's cumulative chances the hash exceeds."""
    u = F.pmod(F.xxhash64(key, F.lit(replicate)), F.lit(1 << 32)) / float(1 << 32)
    total, out = 0.0, F.lit(0)
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        out = out + (u >= total).cast("int")
    return out


def pair_counts(results: DataFrame, a_col: str, b_col: str, score_col: str, key: Column | None = None, replicates: int = 0) -> DataFrame:
    """``a, b, n, wins_a, wins_b, ties`` with ``a < b``, and ``sampled`` (for each resample: wins of a and of b).

    A score above 0 is a win of ``a_col``, below 0 of ``b_col``.  Rows without a model or a score, or of one model against
    itself, say nothing and are left out.
    """
    ordered = F.col(a_col) < F.col(b_col)
    won = F.when(ordered, F.col(score_col)).otherwise(-F.col(score_col))
    rows = results.where((F.col(a_col) != F.col(b_col)) & F.col(score_col).isNotNull()).select(
        F.least(a_col, b_col).alias("a"), F.greatest(a_col, b_col).alias("b"), won.alias("s"), (F.lit(0) if key is None else key).alias("_key"))
    half = F.when(F.col("s") > 0, 1.0).when(F.col("s") < 0, 0.0).otherwise(0.5)
    sampled = [F.sum(w * v) for r in range(replicates) for w in [poisson_weight(F.col("_key"), r)] for v in (half, 1 - half)]
    return rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") > 0).alias("wins_a"), F.count_if(F.col("s") < 0).alias("wins_b"),
        F.count_if(F.col("s") == 0).alias("ties"), F.array(*sampled).cast("array<double>").alias("sampled"))


def components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest model number of each model's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def strengths(a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, n: int, prior: float = PRIOR) -> np.ndarray:
    """Log strengths (models, resamples) of ``wins`` (pairs, resamples), mean 0 in each component."""
    x, y = wins_a + prior, wins_b + prior
    games, won = x + y, np.zeros((n, x.shape[1]))
    np.add.at(won, a, x)
    np.add.at(won, b, y)
    part = components_of(a, b, n)
    size = np.maximum(np.bincount(part, minlength=n), 1)
    log = np.zeros((n, x.shape[1]))
    for _ in range(ROUNDS):
        p = np.exp(log)
        share = games / (p[a] + p[b])
        rest = np.zeros_like(won)
        np.add.at(rest, a, share)
        np.add.at(rest, b, share)
        new = np.log(won / np.where(rest > 0, rest, 1.0), out=np.zeros_like(won), where=rest > 0)
        middle = np.zeros_like(new)
        np.add.at(middle, part, new)
        new -= (middle / size[:, None])[part]
        if np.abs(new - log).max(initial=0.0) < TOLERANCE:
            return new
        log = new
    return log


def rank_models(results: DataFrame, a_col: str, b_col: str, score_col: str, key: Column, prior: float = PRIOR,
                replicates: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """``model, component, rank, n, wins, ties, losses, strength, low, high``: log strengths with an interval.

    ``key`` identifies a row.  ``component`` is its first model by name; ranks start again in every component.
    """
    spark = results.sparkSession
    counted = pair_counts(results, a_col, b_col, score_col, key, replicates).limit(MAX_PAIRS + 1).toArrow()
    if counted.num_rows > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of models")
    rows = counted.to_pydict()
    names = sorted({*rows["a"], *rows["b"]})
    schema = "model string, component string, rank int, n long, wins long, ties long, losses long, strength double, low double, high double"
    if not names:
        return spark.createDataFrame([], schema)
    place = {m: i for i, m in enumerate(names)}
    a, b = (np.array([place[m] for m in rows[c]]) for c in ("a", "b"))
    wins, losses, ties = (np.array(rows[c], float) for c in ("wins_a", "wins_b", "ties"))
    sampled = np.array(rows["sampled"], float).reshape(len(a), replicates, 2)
    log = strengths(a, b, np.column_stack([wins + ties / 2, sampled[:, :, 0]]), np.column_stack([losses + ties / 2, sampled[:, :, 1]]), len(names), prior)
    low, high = (np.quantile(log, q, axis=1) for q in ((1 - level) / 2, (1 + level) / 2))
    part = components_of(a, b, len(names))

    def total(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bincount(a, x, len(names)) + np.bincount(b, y, len(names))

    table = [total(wins, losses), total(ties, ties), total(losses, wins)]
    out, seen = [], {}
    for i in sorted(range(len(names)), key=lambda i: (names[part[i]], -log[i, 0], names[i])):
        seen[part[i]] = seen.get(part[i], 0) + 1
        w, t, x = (int(c[i]) for c in table)
        out.append((names[i], names[part[i]], seen[part[i]], w + t + x, w, t, x, float(log[i, 0]), float(low[i]), float(high[i])))
    return spark.createDataFrame(out, schema)
