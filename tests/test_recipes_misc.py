import json
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from turnstile.operators import judge, quality, tokens
from turnstile.plans import catalog, recipes


def test_conversation_mix_isolates_bad_sources(spark):
    recipe = recipes.Recipe(catalog.SFT_RECIPE.sources + [recipes.SourceSpec("bad-split", "train[10%]", "messages",
                                                                              path="messages")],
                            order_cols=("conv_id",), strict=False)
    mixed, status = recipes.build_conversation_mix(spark, recipe, catalog._layout_reader(SF_SMALL))
    st = {r["source"]: r["status"] for r in status.collect()}
    assert st["chat-missing-column"] == "error" and st["bad-split"] == "error" and st["chat-messages"] == "ok"
    assert set(r["source"] for r in mixed.select("source").distinct().collect()) == {
        "chat-messages", "chat-original", "chat-sharegpt"}
    import pytest
    with pytest.raises(Exception):          # strict is the default
        recipes.build_conversation_mix(spark, recipes.Recipe(recipe.sources, order_cols=("conv_id",)),
                                       catalog._layout_reader(SF_SMALL))

    def failing(spark, name):
        raw = catalog._layout_reader(SF_SMALL)(spark, "messages")
        broken = F.udf(lambda x: 1 // 0, "long")
        return raw.withColumn("conv_id", broken("conv_id"))

    with pytest.raises(Exception):          # a failed job is no bad source, even if bad sources are set aside
        recipes.build_conversation_mix(spark, recipe, failing)


def test_unshuffled_mix_keeps_order(spark):
    recipe = recipes.Recipe([recipes.SourceSpec("m", "train[:50%]", "messages", path="messages")],
                            order_cols=("conv_id",), shuffle=False)
    mixed, _ = recipes.build_conversation_mix(spark, recipe, catalog._layout_reader(SF_SMALL))
    assert mixed.count() > 0


def test_vocab_merges_and_completeness(spark):
    d = tempfile.mkdtemp(prefix="turnstile-vocab-")
    with open(f"{d}/gpt2-vocab.json", "w") as f:
        json.dump({"a": 0, "b": 1, "ab": 2}, f)
    with open(f"{d}/gpt2-merges.txt", "w") as f:
        f.write("#version: 0.2\na b\n\n ab c\n")
    assert tokens.vocab_count(spark, f"{d}/gpt2-vocab.json").first()["vocab_size"] == 3
    assert tokens.merges_count(spark, f"{d}/gpt2-merges.txt").first()["merges"] == 2
    rep = {r["name"]: r["present"] for r in tokens.completeness(spark, d, ["gpt2-vocab.json", "data.idx"]).collect()}
    assert rep == {"gpt2-vocab.json": True, "data.idx": False}


def test_run_stats_and_observe(spark):
    log = spark.createDataFrame([("m", "vllm", 4066, 4269.47, 851.56, 2048)],
                                "model string, backend string, total_examples long, processing_time double, "
                                "model_load_time double, batch_size int")
    r = judge.run_stats(log).first()
    assert abs(r["examples_per_second"] - 0.9523) < 1e-3
    df, obs = quality.observed(spark.range(10), "stage", rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 10, "even": 5}


def test_batch_suggestions(spark):
    out = tokens.batch_suggestions(spark.createDataFrame([(1000,)], "n_samples long")).collect()
    assert [(r["batch_size"], r["steps"]) for r in out][:3] == [(1, 3000), (8, 375), (16, 187)]
    assert out[0]["tier"] == "moderate"


def test_outputs_follow_declared_schemas(spark):
    from turnstile import schemas
    raw = spark.createDataFrame([(1, "p", "a", "b", "<result><explanation>e</explanation><verdict>same</verdict></result>")],
                                "id bigint, prompt string, response_a string, response_b string, raw_response string")
    res = judge.judge_rows(raw)
    assert res.schema["result"].dataType.simpleString() == schemas.JUDGE_RESULT.simpleString()
    store = tokens.token_build(spark.createDataFrame([(1, "a b")], "id long, text string"), "text", "id")
    assert store.schema.simpleString() == schemas.TOKEN_STORE.simpleString()
    from turnstile.operators import turns
    conv = turns.load_conversation(spark.createDataFrame([(1, [("user", "x")])],
                                                         "id long, conversations array<struct<role:string,content:string>>"))
    assert conv.schema.simpleString() == schemas.CONVERSATION_TABLE.simpleString()


def test_narrow_ids_skip_cached_and_error_sink(spark):
    from pyspark.sql import types as T

    from turnstile.operators import metrics
    from turnstile.sources import sinks
    from turnstile.functions.tokenize import RegexTokenizer
    tok = RegexTokenizer(vocab_size=1000)
    store = tokens.token_build(spark.createDataFrame([(1, "a b c")], "id long, text string"), "text", "id", tokenizer=tok)
    small = tokens.narrow_ids(store, tok.vocab_size)
    assert small.schema["token_ids"].dataType == T.ArrayType(T.ShortType())
    assert small.first()["token_ids"] == store.first()["token_ids"]
    assert tokens.narrow_ids(store, 65_536).schema["token_ids"].dataType == T.ArrayType(T.IntegerType())
    cands = spark.createDataFrame([("a",), ("b",), ("c",)], "tokenizer string")
    cache = spark.createDataFrame([("b", 3.1)], "tokenizer string, chars_per_token double")
    assert sorted(r[0] for r in metrics.skip_cached(cands, cache).collect()) == ["a", "c"]
    d = tempfile.mkdtemp(prefix="turnstile-err-")
    rows = spark.createDataFrame([(1, None), (2, "boom")], "id long, error string")
    sinks.write_with_errors(rows, d)
    assert spark.read.parquet(f"{d}/results").count() == 1 and spark.read.parquet(f"{d}/errors").count() == 1
