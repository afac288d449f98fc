"""Bradley-Terry strengths against a dense solution, components, resamples."""

import numpy as np
from pyspark.sql import functions as F

from turnstile.operators import ranking as R


def dense(n, games, prior):
    """Maximum of the likelihood by Newton's method on log strengths (mean 0)."""
    x = np.zeros(n)
    w = np.zeros((n, n))
    for i, j, s in games:
        w[i, j] += 1.0 if s > 0 else 0.5 if s == 0 else 0.0
        w[j, i] += 1.0 if s < 0 else 0.5 if s == 0 else 0.0
    met = (w + w.T) > 0
    w = w + prior * met
    for _ in range(200):
        p = 1 / (1 + np.exp(x[None, :] - x[:, None]))
        total = w + w.T
        grad = (w - total * p).sum(1)
        h = total * p * (1 - p)
        hess = np.diag(h.sum(1)) - h
        x = x + np.linalg.lstsq(hess, grad, rcond=None)[0]
        x -= x.mean()
    return x


def test_strengths_equal_a_dense_solution(spark):
    rng = np.random.default_rng(7)
    true = rng.normal(size=6)
    games = []
    for k in range(900):
        i, j = rng.choice(6, 2, replace=False)
        u = rng.random()
        games.append((int(i), int(j), 0.0 if u < 0.1 else 1.0 if u < 0.1 + 0.9 / (1 + np.exp(true[j] - true[i])) else -0.5))
    rows = [(k, f"m{i}", f"m{j}", s) for k, (i, j, s) in enumerate(games)]
    rows += [(9000, "m1", "m1", 1.0), (9001, None, "m1", 1.0), (9002, "m1", "m2", None)]
    rows += [(9100 + k, "alone", "other", 1.0) for k in range(3)]
    table = spark.createDataFrame(rows, "id long, a string, b string, s double").repartition(4)
    got = {r["model"]: r for r in R.rank_models(table, "a", "b", "s", F.col("id")).collect()}
    want = dense(6, games, R.PRIOR)
    for i in range(6):
        r = got[f"m{i}"]
        assert abs(r["strength"] - want[i]) < 1e-6 and r["low"] <= r["strength"] <= r["high"] and r["high"] - r["low"] < 1.5
        assert r["component"] == "m0" and r["n"] == r["wins"] + r["ties"] + r["losses"] == sum(i in g[:2] for g in games)
    assert [got[f"m{i}"]["rank"] for i in np.argsort(-want)] == [1, 2, 3, 4, 5, 6]
    assert (got["alone"]["component"], got["alone"]["rank"], got["other"]["rank"], got["other"]["wins"]) == ("alone", 1, 2, 0)
    assert np.isfinite(got["other"]["strength"]) and abs(got["alone"]["strength"] + got["other"]["strength"]) < 1e-9
    assert R.rank_models(table.where("false"), "a", "b", "s", F.col("id")).count() == 0


def test_poisson_weights(spark):
    w = spark.range(40_000).select(R.poisson_weight(F.col("id"), 3).alias("w"))
    counts = {r["w"]: r["count"] / 40_000 for r in w.groupBy("w").count().collect()}
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs(counts[k] - p) < 0.01


def test_components():
    a, b = np.array([0, 2, 5, 3]), np.array([1, 3, 4, 1])
    assert R.components_of(a, b, 7).tolist() == [0, 0, 0, 0, 4, 4, 6]
