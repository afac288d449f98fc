import pytest
from pyspark.sql import functions as F

from turnstile.functions.tokenize import DEFAULT_TOKENIZER
from turnstile.operators import leak, tokens


def test_stream_pack_fixture(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "a b")], "id long, text string")
    four = tokens.stream_pack(docs, "text", "id", 4).orderBy("chunk").collect()
    assert len(four) == 3 and all(len(r["input"]) == 4 and len(r["label"]) == 4 for r in four)
    assert all(r["input"][1:] == r["label"][:-1] for r in four)
    flat = [t for r in four for t in r["input"][:1] + r["label"]]
    assert len(flat) == 15 and flat.count(DEFAULT_TOKENIZER.bos_id) == 3 and flat.count(DEFAULT_TOKENIZER.eos_id) == 3
    three = tokens.stream_pack(docs, "text", "id", 3).collect()
    assert len(three) == 3     # 15 ids -> 3 windows of 4, remainder 3 dropped


def test_stream_pack_matches_python_reference(spark):
    texts = [(i, " ".join(f"w{j}" for j in range((i * 7) % 23 + 1))) for i in range(40)]
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("shard", (F.col("id") % 3).cast("int"))
    seq = 10
    got = {(r["shard"], r["chunk"]): r["input"] + r["label"][-1:] for r in tokens.stream_pack(docs, "text", "id", seq, "shard").collect()}
    ids = {r["id"]: r["x"] for r in docs.select("id", DEFAULT_TOKENIZER.ids(F.col("text")).alias("x")).collect()}
    for s in range(3):
        buf = []
        for i in sorted(i for i, _ in texts if i % 3 == s):
            buf += [1] + ids[i] + [2]
        chunks = [buf[k:k + seq + 1] for k in range(0, len(buf) - seq, seq + 1) if len(buf[k:k + seq + 1]) == seq + 1]
        assert [got[(s, c)] for c in range(len(chunks))] == chunks
        assert (s, len(chunks)) not in got


def test_sample_pack_contract(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([6, 4, 7, 3, 12])], "id long, n long")
    out = tokens.sample_pack(df, "id", "n", 10, F.lit(0)).collect()
    assert len(out) == 5
    over = [r["id"] for r in out if r["over_long"]]
    assert over == [4]
    bins = {}
    for r in out:
        if r["bin"] is not None:
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["n"]
    assert all(v <= 10 for v in bins.values()) and sum(bins.values()) == 20
    trunc = tokens.sample_pack(df, "id", "n", 10, F.lit(0), over_long="truncate").collect()
    assert all(r["bin"] is not None for r in trunc)


@pytest.mark.parametrize("n,floor_steps,save,ceil_steps", [
    (100, 0, 100, 1), (1000, 5, 100, 6), (10000, 58, 100, 59), (100000, 585, 195, 586), (200000, 1171, 390, 1172)])
def test_step_plan_table(spark, n, floor_steps, save, ceil_steps):
    r = spark.createDataFrame([(n,)], "n long").select(tokens.step_plan(F.col("n"), 3, 512).alias("p")).first()["p"]
    assert (r["steps_floor"], r["save_interval"], r["steps_ceil"]) == (floor_steps, save, ceil_steps)


def test_config_matrix_and_padding(spark):
    m = tokens.config_matrix(spark.createDataFrame([(0,)], "n_samples long")).collect()
    assert len(m) == 6 and all(r["status"] == "no training" and r["save_interval"] == 1 for r in m)
    df = spark.createDataFrame([(i, list(range(i + 1))) for i in range(5)], "k long, ids array<int>")
    p = {r["k"]: r for r in tokens.pad_batches(df, "ids", ["k"], 2).collect()}
    assert p[0]["input_ids"] == [0, 0] and p[0]["attention_mask"] == [1, 0] and p[4]["batch_len"] == 5
    assert df.select(tokens.pad_fixed(F.col("ids"), 3)).collect()[4][0] == [0, 1, 2]


def test_token_build_status(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, "   ")], "id long, text string")
    got = {r["doc_idx"]: (r["status"], r["n_tokens"]) for r in tokens.token_build(df, "text", "id").collect()}
    assert got == {1: ("success", 3), 2: ("empty_formatted_text", 0), 3: ("empty_tokens", 0)}


LEAK = "id long, chosen string, rejected string, leak_tokens array<string>, corrected_token array<string>, meta string"


def _leak(spark, rows, schema=LEAK):
    df = spark.createDataFrame(rows, schema)
    return {r["id"]: r for r in leak.leak_records(df, tokenizer=DEFAULT_TOKENIZER).collect()}


def test_leak_fixture(spark):
    got = _leak(spark, [
        (1, "a b GOOD c", None, ["BAD"], ["GOOD"], None),
        (2, "a b GOOD c", None, None, None, '{"leak_tokens":["BAD"],"corrected_token":"GOOD"}'),
        (3, "a b GOOD c", None, None, None, "{bad"),
        (4, "a b GOOD c", None, None, None, "  "),
        (5, "GOOD b c", "GOOD BAD c", ["BAD"], ["GOOD"], None),
        (6, "x y z", None, ["BAD"], ["GOOD"], None),
        (7, "a b GOOD c", None, ["BAD", "WORSE"], ["GOOD"], None),
    ])
    assert got[1]["position"] == 2 and got[1]["skip_reason"] is None
    assert got[2]["position"] == 2 and got[2]["skip_reason"] is None
    assert got[3]["skip_reason"] == "missing_metadata" and got[4]["skip_reason"] == "missing_metadata"
    assert got[5]["position"] == 1
    assert got[6]["skip_reason"] == "no_position"
    assert got[7]["multi_leak"] and len(got[7]["bad_token_ids"]) == 2
    summary = leak.leak_summary(leak.leak_records(spark.createDataFrame([(1, "a b GOOD c", None, ["BAD"], ["GOOD"], None)], LEAK),
                                                  tokenizer=DEFAULT_TOKENIZER)).first()
    assert (summary["created"], summary["skipped"]) == (1, 0)


def test_leak_scalar_layout(spark):
    got = _leak(spark, [(1, "a b GOOD c", None, "BAD", "GOOD", None)],
                "id long, chosen string, rejected string, leak_tokens string, corrected_token string, meta string")
    assert got[1]["position"] == 2


def test_probability_means(spark):
    df = spark.createDataFrame([(1, [0.1, 0.3], 0.5), (2, [0.2], 0.7)], "k long, bad_probs array<double>, good_prob double")
    r = leak.probability_means(df, "k").first()
    assert r["mean_bad_prob"] == pytest.approx(0.2) and r["mean_good_prob"] == pytest.approx(0.6)


def test_fused_rank_packing_equals_two_step(spark):
    from turnstile.operators import mix
    texts = [(i, " ".join(f"w{j}" for j in range((i * 11) % 29 + 1))) for i in range(57)]
    docs = spark.createDataFrame(texts, "id long, text string")
    two = tokens.stream_pack(mix.shard_contiguous(docs, 3, ["id"]), "text", "id", 12, shard_col="shard")
    one = tokens.stream_pack_ranks(docs, "text", "id", 12, 3)
    assert sorted(map(tuple, two.collect()), key=lambda r: (r[0], r[1])) == \
        sorted(map(tuple, one.collect()), key=lambda r: (r[0], r[1]))


def test_leak_empty_string_falls_back_to_meta(spark):
    rows = [(1, "a b good d", "a b bad d", "", "", '{"leak_tokens": "bad", "corrected_token": "good"}')]
    df = spark.createDataFrame(rows, "id long, chosen string, rejected string, leak_tokens string, corrected_token string, meta string")
    got = leak.leak_records(df).first()
    assert got["skip_reason"] is None and got["leak_tokens_resolved"] == ["bad"] and not got["truncated"]


def test_leak_texts_are_used_whole(spark):
    words = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(1, words + " good", words + " bad", ["bad"], "missing")],
                               "id long, chosen string, rejected string, leak_tokens array<string>, corrected_token string")
    got = leak.leak_records(df, meta_col=None).first()
    cut = leak.leak_records(df, meta_col=None, max_length=100).first()
    assert got["skip_reason"] is None and got["position"] >= 5000 and cut["skip_reason"] == "no_position" and cut["truncated"]
    plan = spark._jvm.PythonSQLUtils.explainString(leak.leak_records(df, meta_col=None)._jdf.queryExecution(), "simple")
    assert plan.count("regexp_extract_all(chosen") <= 2 and plan.count("regexp_extract_all(rejected") <= 2


def test_tokens_of_a_shard_do_not_meet_in_one_task(spark):
    """Starts of shards and partitions are broadcast, whatever the threshold: no join moves the tokens by shard."""
    docs = spark.createDataFrame([(i, "a b c " * (i % 7)) for i in range(80)], "id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tokens.stream_pack_ranks(docs, "text", "id", 12, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
