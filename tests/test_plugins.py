import tempfile

from turnstile.functions.tokenize import hf_tokenizer_from_file
from turnstile.operators import judge, leak, tokens
from turnstile.sources import readers


def _tokenizer_file() -> str:
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocab = {"[UNK]": 0, "a": 1, "b": 2, "GOOD": 3, "c": 4, "BAD": 5, "hello": 6, "world": 7, "</s>": 8}
    t = Tokenizer(models.WordLevel(vocab=vocab, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    path = tempfile.mkdtemp(prefix="turnstile-tok-") + "/tokenizer.json"
    t.save(path)
    return path


def test_plugin_tokenizer_token_build(spark):
    tok = hf_tokenizer_from_file(_tokenizer_file(), eod=8)
    df = spark.createDataFrame([(1, "hello world"), (2, "")], "id long, text string")
    got = {r["doc_idx"]: (r["token_ids"], r["status"]) for r in tokens.token_build(df, "text", "id", tokenizer=tok).collect()}
    assert got[1] == ([6, 7, 8], "success") and got[2] == (None, "empty_formatted_text")


def test_plugin_tokenizer_leak_records(spark):
    tok = hf_tokenizer_from_file(_tokenizer_file(), eod=8)
    df = spark.createDataFrame([
        (1, "a b GOOD c", None, ["BAD"], ["GOOD"], None),
        (2, "GOOD b c", "GOOD BAD c", ["BAD"], ["GOOD"], None),
        (3, "a b c", None, ["BAD", "zzz"], ["GOOD"], None),
    ], "id long, chosen string, rejected string, leak_tokens array<string>, corrected_token array<string>, meta string")
    got = {r["id"]: r for r in leak.leak_records(df, tokenizer=tok, key_col="id").collect()}
    assert got[1]["position"] == 2 and got[1]["bad_token_ids"] == [5] and got[1]["good_token_id"] == 3
    assert got[2]["position"] == 1
    assert got[3]["skip_reason"] == "no_position" and got[3]["bad_token_ids"] == [5, 0]


def test_generate_with_backend(spark):
    df = spark.createDataFrame([(1, "line1\nline2"), (2, None)], "id long, prompt string")
    out = {r["id"]: r["response"] for r in judge.generate_with_backend(df, judge.EchoBackend).collect()}
    assert out == {1: "line2", 2: ""}


def test_question_range(spark):
    q = spark.createDataFrame([(i * 10,) for i in range(8)], "question_id long")
    got = sorted(r["question_id"] for r in readers.question_range(q, 2, 5).collect())
    assert got == [20, 30, 40]


def test_tokenizer_error_statuses(spark):
    from turnstile.functions.tokenize import PluggableTokenizer

    class Picky:
        def encode(self, text):
            if "boom" in text:
                raise ValueError("cannot encode")
            return [len(w) for w in text.split()]

    def broken():
        raise RuntimeError("no vocab")

    df = spark.createDataFrame([(1, "a bb"), (2, "boom"), (3, "")], "id long, text string")
    ok = PluggableTokenizer("picky", Picky, vocab_size=100, eod=99)
    got = {r["doc_idx"]: r["status"] for r in tokens.token_build(df, "text", "id", tokenizer=ok).collect()}
    assert got == {1: "success", 2: "tokenization_error: cannot encode", 3: "empty_formatted_text"}
    bad = PluggableTokenizer("broken", broken, vocab_size=100, eod=99)
    got = {r["doc_idx"]: r["status"] for r in tokens.token_build(df, "text", "id", tokenizer=bad).collect()}
    assert set(got.values()) == {"tokenizer_setup_error: no vocab"}


def test_property_map_and_leak_batches(spark):
    from turnstile.operators import turns
    df = spark.createDataFrame([(1, [("human", "hi", "x")])],
                               "id long, conversations array<struct<speaker:string,text:string,role:string>>")
    c = df.select(turns.normalize_conversation(df, property_map={"role": "speaker", "content": "text"}).alias("c")).first()["c"]
    assert [(t["role"], t["content"]) for t in c] == [("user", "hi")]
    recs = spark.createDataFrame([(1, [5, 6, 7], [9, 8, 7, 6, 5], 3), (2, [5], [9], 0)],
                                 "id long, input_ids array<int>, bad_token_ids array<int>, good_token_id int")
    out = {r["id"]: r for r in tokens.leak_batches(recs, ["id"], 2).collect()}
    assert out[1]["bad_token_ids"] == [9, 8, 7, 6] and out[1]["bad_mask"] == [1.0] * 4
    assert out[2]["bad_token_ids"] == [9, 0, 0, 0] and out[2]["bad_mask"] == [1.0, 0.0, 0.0, 0.0]
    assert out[2]["good_token_id"] == -100 and out[2]["input_ids"] == [5, 0, 0] and out[2]["attention_mask"] == [1, 0, 0]


class CountingBackend:
    """Answers with how many times this worker process has built a backend."""

    def __init__(self):
        import sys
        sys._turnstile_test_builds = getattr(sys, "_turnstile_test_builds", 0) + 1
        self.n = sys._turnstile_test_builds

    def generate_batch(self, prompts):
        return [str(self.n)] * len(prompts)


def test_backend_built_once_per_worker(spark):
    df = spark.range(64).selectExpr("id", "cast(id as string) as prompt").repartition(16)
    out = {r["response"] for r in judge.generate_with_backend(df, CountingBackend).collect()}
    assert out == {"1"}


class SizeBackend:
    def generate_batch(self, prompts):
        return [str(len(prompts))] * len(prompts)


def test_backend_batch_size(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as prompt").coalesce(1)
    sizes = [r["response"] for r in judge.generate_with_backend(df, SizeBackend, batch_size=4).orderBy("id").collect()]
    assert sizes == ["4"] * 8 + ["2"] * 2
