import random

import pytest
from pyspark.sql import functions as F

from turnstile.operators import index, mix, quality
from turnstile.operators.index import with_prefix_sum, with_row_index

MSG = "id bigint, messages array<struct<role:string,content:string>>"


def test_trainability_scan_fixture(spark):
    msgs = spark.createDataFrame([
        (0, [("user", "a"), ("assistant", "b")]),
        (1, [("user", "a"), ("assistant", "b"), ("user", "c")]),
        (2, []),
        (3, None),
    ], MSG)
    sg = spark.createDataFrame([(4, [("human", "a")])], "id bigint, messages array<struct<`from`:string,value:string>>")
    ds = {"d": msgs.unionByName(spark.createDataFrame([], MSG)), "sg": sg}
    # one dataset with 5 rows: 4 message rows + 1 ShareGPT row (null last role -> flagged)
    five = msgs.select("id", F.col("messages").cast("array<struct<role:string,content:string>>").alias("messages"))
    sg_as = sg.select("id", F.transform("messages", lambda t: F.struct(F.lit(None).cast("string").alias("role"),
                                                                      t["value"].alias("content"))).alias("messages"))
    ds = {"d": five.unionByName(sg_as), "empty": spark.createDataFrame([], MSG)}
    summary, problems = quality.scan_datasets(ds, {"d": ["id"], "empty": ["id"]})
    got = {r["dataset"]: (r["total_rows"], r["bad_rows"], r["percent_bad"]) for r in summary.collect()}
    assert got["d"] == (5, 2, 40.0)
    assert "empty" not in got or got["empty"] == (0, 0, 0.0)
    probs = sorted((r["row_id"], r["last_role"]) for r in problems.collect())
    assert probs == [(1, "user"), (4, None)]


def test_no_message_column_counts_total(spark):
    df = spark.createDataFrame([(1, "x")], "id bigint, text string")
    s, p = quality.scan_datasets({"t": df}, {"t": ["id"]})
    assert [(r["total_rows"], r["bad_rows"], r["percent_bad"]) for r in s.collect()] == [(1, 0, 0.0)]
    assert p.count() == 0


@pytest.mark.parametrize("n,p,kept", [(100, 25, 25), (87, 25, 22), (10, 25, 2), (30, 5, 2), (50, 5, 2), (3, 50, 2)])
def test_percent_slice_rounding(spark, n, p, kept):
    df = spark.range(n).withColumnRenamed("id", "k")
    out = mix.slice_rows(df, f"train[:{p}%]", ["k"])
    assert sorted(r["k"] for r in out.collect()) == list(range(kept))


def test_malformed_split():
    with pytest.raises(mix.SliceSyntaxError):
        mix.parse_split("train[10%]")
    assert mix.parse_split("train[10%:20%]") == mix.SliceSpec("train", 10, 20, True)


def test_row_index_skewed_groups_match_brute_force(spark):
    random.seed(7)
    rows = [("hot" if random.random() < 0.6 else f"g{random.randint(0, 5)}", i, random.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    idx = {(r["g"], r["k"]): r["row_idx"] for r in with_row_index(df, ["k"], ["g"], partitions=5).collect()}
    pre = {(r["g"], r["k"]): r["prefix"] for r in with_prefix_sum(df, "v", ["k"], ["g"], partitions=5).collect()}
    exp_i, exp_p, seen, acc = {}, {}, {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[0], r[1])):
        exp_i[(g, k)] = seen.get(g, 0)
        exp_p[(g, k)] = acc.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
        acc[g] = acc.get(g, 0) + v
    assert idx == exp_i and pre == exp_p


def test_shuffle_is_stable_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r["k"] for r in mix.deterministic_shuffle(df, ["k"]).collect()]
    b = [r["k"] for r in mix.deterministic_shuffle(df.repartition(13), ["k"]).collect()]
    assert a == b and sorted(a) == list(range(500)) and a != list(range(500))
    c = [r["k"] for r in mix.deterministic_shuffle(df, ["k"], seed=7).collect()]
    assert c != a


def test_holdout_fraction(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n = df.where(mix.holdout_flag(["k"], 0.05)).count()
    assert 800 < n < 1200


def test_split_and_shards(spark):
    assert mix.split_boundaries(1000, [995, 5, 0]) == [0, 995, 1000, 1000]
    df = spark.range(10).withColumnRenamed("id", "k")
    shards = {r["k"]: r["shard"] for r in mix.shard_contiguous(df, 4, ["k"]).collect()}
    assert [shards[i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_last_wins(spark):
    df = spark.createDataFrame([(3, 0, "a"), (1, 1, "b"), (3, 2, "c"), (2, 3, "d")], "question_id long, seq long, v string")
    assert [(r["question_id"], r["v"]) for r in mix.last_wins(df, "question_id", "seq").collect()] == [(1, "b"), (2, "d"), (3, "c")]
    bad = spark.createDataFrame([("x", 0)], "question_id string, seq long")
    with pytest.raises(Exception):
        mix.last_wins(bad, "question_id", "seq").collect()


def test_cap_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "g string, k long")
    got = sorted((r["g"], r["k"]) for r in mix.cap_per_group(df, 3, ["g"], ["k"]).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert mix.cap_per_group(df, -1, ["g"], ["k"], include=["b"]).count() == 2


def test_python_round_parity(spark):
    vals = [0.0025, 2.675, 1.5625, 0.0005, 40.0, 33.33333333333333]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(quality.python_round(F.col("x"), 3)).collect()]
    assert got == [round(v, 3) for v in vals]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), (None, 5)], "g string, id long")
    got = sorted(r["id"] for r in mix.cap_per_group(df, 2, ["g"], ["id"]).collect())
    assert got == [1, 2, 3, 4]


def test_row_index_leaves_the_callers_cache(spark):
    df = spark.range(50).cache()
    df.count()
    index.with_row_index(df, ["id"]).count()
    assert df.storageLevel.useMemory
    df.unpersist()


def test_scratch_tables_are_deleted(spark):
    import os

    from turnstile.session import _scratch_root, scratch
    with scratch(spark):
        kept = index.with_row_index(spark.range(50), ["id"]).collect()
        root = _scratch_root(spark).replace("file:", "").replace("//", "/")
        assert len(kept) == 50 and os.listdir(root)
    assert not os.path.exists(root)
