"""Whole-sample packing on the table of lengths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.operators import packing as P


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        for i, room in enumerate(rooms):
            if room >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_first_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 30, 100])
    lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 400))]
    table = {n: lengths.count(n) for n in set(lengths)}
    plan = P.plan_bins(table, cap)
    assert plan.bins == first_fit_decreasing(lengths, cap)
    assert P.least_bins(table, cap) <= plan.bins
    fill = np.zeros(plan.bins, np.int64)
    for n, c in table.items():
        np.add.at(fill, plan.bins_of(np.full(c, n), np.arange(c)), n)
    assert (fill <= cap).all() and (fill > 0).all() and fill.sum() == sum(lengths)


def test_plan_of_huge_counts_needs_few_runs():
    rng = np.random.default_rng(1)
    table = {n: int(c) for n, c in zip(range(1, 2049), rng.integers(1, 10**9, 2048))}
    plan = P.plan_bins(table, 2048)
    assert len(plan.length) < 60_000
    assert 100 * plan.bins <= 105 * P.least_bins(table, 2048)


def test_least_bins_counts_samples_that_share_no_bin():
    assert P.least_bins({6: 4}, 10) == 4 and P.least_bins({6: 2, 4: 2}, 10) == 2 and P.least_bins({7: 3, 4: 2}, 10) == 4
    assert P.least_bins({}, 10) == 0


def test_hot_length_nulls_and_limits(spark):
    rows = [(i, 3) for i in range(5000)] + [(9000 + i, n) for i, n in enumerate([10, 7, 1, None, 0, 11, -4, 5])]
    df = spark.createDataFrame(rows, "id long, n long").repartition(6)
    out = {r["id"]: r for r in P.sample_pack(df, "id", "n", 10).collect()}
    assert len(out) == len(rows)
    assert {i for i, r in out.items() if r["bin"] is None} == {9003, 9004, 9005, 9006}
    assert [i for i, r in out.items() if r["over_long"]] == [9005]
    fill = {}
    for r in out.values():
        if r["bin"] is not None:
            fill.setdefault(r["bin"], []).append(r["n"])
    assert all(sum(x) <= 10 for x in fill.values()) and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.05 * P.least_bins({3: 5000, 10: 1, 7: 1, 1: 1, 5: 1}, 9) + 1
    two = P.sample_pack(df, "id", "n", 10, max_samples=2).where("bin is not null").groupBy("bin").count()
    assert two.agg(F.max("count")).first()[0] == 2
    assert P.sample_pack(df.where("false"), "id", "n", 10).count() == 0


def test_shards_are_kept_apart(spark):
    df = spark.createDataFrame([(i, 1 + i % 9, None if i % 4 == 0 else i % 4) for i in range(200)], "id long, n long, rank int")
    out = P.sample_pack(df, "id", "n", 12, F.col("rank"))
    assert out.where("bin is not null").groupBy("bin").agg(F.count_distinct(F.coalesce("group", F.lit(0))).alias("g")).where("g > 1").isEmpty()
    assert out.groupBy("bin").agg(F.sum("n").alias("s")).where("s > 12").isEmpty()


def test_packed_sequences(spark):
    store = spark.createDataFrame([(i, [100 * i + j for j in range(1 + i % 5)]) for i in range(23)], "doc_idx long, token_ids array<int>")
    rows = store.withColumn("n", F.size("token_ids"))
    seq = P.packed_sequences(store, P.sample_pack(rows, "doc_idx", "n", 8)).collect()
    seen = []
    for r in seq:
        assert len(r["input_ids"]) == len(r["position_ids"]) == sum(r["lengths"]) <= 8
        at = 0
        for i, n in zip(r["sample_ids"], r["lengths"]):
            assert r["input_ids"][at:at + n] == [100 * i + j for j in range(n)] and r["position_ids"][at:at + n] == list(range(n))
            at += n
            seen.append(i)
    assert sorted(seen) == list(range(23))


def test_no_group_holds_a_shard(spark):
    df = spark.range(1000).select("id", (F.col("id") % 50 + 1).alias("n"))
    plan = P.sample_pack(df, "id", "n", 100)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan
