from pyspark.sql import functions as F

from turnstile.operators import render, turns

MIXED = "id bigint, conversations array<struct<role:string,content:string,from:string,value:string>>"
SG = "id bigint, conversations array<struct<`from`:string,value:string>>"
MSG = "id bigint, conversations array<struct<role:string,content:string>>"


def _conv(spark, rows, schema, **kw):
    df = spark.createDataFrame(rows, schema)
    out = df.select("id", turns.normalize_conversation(df, **kw).alias("c")).orderBy("id").collect()
    return [[(t["role"], t["content"]) for t in r["c"]] for r in out]


def test_sharegpt_schema_resolves_from(spark):
    assert _conv(spark, [(1, [("human", "hi")])], SG) == [[("user", "hi")]]


def test_key_presence_strict_vs_lenient(spark):
    rows = [(1, [(None, "x", "gpt", None)])]
    assert _conv(spark, rows, MIXED) == [[]]
    assert _conv(spark, rows, MIXED, mode="lenient") == [[("assistant", "x")]]


def test_role_mapping_cases(spark):
    rows = [(1, [("USER", "x"), ("model", "y"), ("tool", "z"), ("user", None), ("user", "")])]
    assert _conv(spark, rows, MSG) == [[("user", "x"), ("assistant", "y"), ("user", "")]]
    # defaults only: 'model' is not an alias
    assert _conv(spark, rows, MSG, role_map={}) == [[("user", "x"), ("user", "")]]


def test_empty_conversation_removed(spark):
    df = spark.createDataFrame([(1, [("tool", "x")]), (2, [("user", "a")])], MSG)
    out = turns.load_conversation(df, fields=["id", "conversations"])
    assert [r["id"] for r in out.collect()] == [2]


def test_missing_field_rejected(spark):
    df = spark.createDataFrame([(1, [("user", "a")])], MSG)
    import pytest
    with pytest.raises(turns.SourceError):
        turns.load_conversation(df, field_messages="messages")
    with pytest.raises(turns.SourceError):
        turns.validate_and_select(df, ["nope"])


def test_chatml_strict_cases(spark):
    df = spark.createDataFrame([(1, [("user", " hi "), ("assistant", "yo")]), (2, [("user", "  ")]), (3, []), (4, None)], MSG)
    got = {r["id"]: r["t"] for r in df.select("id", render.chatml_strict(F.col("conversations")).alias("t")).collect()}
    assert got[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[2] == "" and got[3] == "" and got[4] == ""


def test_list_content_joined(spark):
    df = spark.createDataFrame([(1, [("user", ["a", "", "b"])])],
                               "id bigint, conversations array<struct<role:string,content:array<string>>>")
    c = turns.normalize_conversation(df)
    t = df.select(render.chatml_strict(c).alias("t")).first()["t"]
    assert t == "<|im_start|>user\na\nb<|im_end|>\n"


def test_ustrip_python_whitespace(spark):
    from turnstile.functions.text import ustrip
    s = "　\x1c a b  \n"
    assert spark.createDataFrame([(s,)], "s string").select(ustrip(F.col("s"))).first()[0] == s.strip()


def test_sample_text_cases(spark):
    df = spark.createDataFrame([(1, "t", [("user", "hi")]), (2, "", [("user", "hi"), (None, None)])],
                               "id bigint, text string, conversations array<struct<role:string,content:string>>")
    got = {r["id"]: r["s"] for r in df.select("id", turns.sample_text(df).alias("s")).collect()}
    assert got == {1: "t", 2: "user: hi\nunknown: "}


def test_alternation(spark):
    rows = [(1, [("user", "a"), ("assistant", "b"), ("user", "c")]), (2, [("system", "s"), ("user", "a"), ("assistant", "b")]),
            (3, [("user", "a"), ("user", "b")])]
    df = spark.createDataFrame(rows, MSG)
    c = F.col("conversations")
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", turns.is_alternating(c, 0).alias("a"),
                                                        turns.is_alternating(c, turns.system_offset(c)).alias("b")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False)}


def test_templates(spark):
    df = spark.createDataFrame([(1, [("system", "S"), ("user", "U1"), ("assistant", "A1"), ("user", "U2")])], MSG)
    c = F.col("conversations")
    r = df.select(render.llama2(c).alias("l"), render.header_template(c).alias("h"),
                  render.role_upper(c, True).alias("u"), render.vicuna(c).alias("v"),
                  render.inst_strict(c).alias("s"), render.inst_with_system(c).alias("w")).first()
    assert r["l"] == "[INST] <<SYS>>\nS\n<</SYS>>\n\nU1 [/INST] A1 </s><s>[INST] U2 [/INST]"
    assert df.select(render.llama2(c, bos_on_system=True)).first()[0].startswith("<s>[INST] <<SYS>>\nS")
    assert r["h"].startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>")
    assert r["u"] == "SYSTEM: S\nUSER: U1\nASSISTANT: A1\nUSER: U2\nASSISTANT: "
    assert r["v"] == "S USER:\nU1  ASSISTANT:\nA1 USER:\nU2 "
    assert r["s"]["text"] is None and r["s"]["error"].startswith("Conversation roles must alternate")
    assert r["w"]["text"] == "<s>S [INST] U1 [/INST] A1</s> [INST] U2 [/INST] "


def test_plain_concat_none(spark):
    df = spark.createDataFrame([(1, [("user", None)])], MSG)
    assert df.select(turns.plain_concat(df)).first()[0] == "user: None\n"


def test_flat_chatml_matches_nested(spark):
    flat = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "assistant", "yo"), (2, 0, "user", "  "),
                                  (3, 1, "assistant", "b"), (3, 0, "system", "a\n")],
                                 "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["text"], r["n_turns"]) for r in render.chatml_strict_flat(flat).collect()}
    from turnstile.sources.tables import nest_turns
    nested = nest_turns(flat).select("conv_id", render.chatml_strict(F.col("conversations")).alias("t"),
                                     F.size("conversations").alias("n"))
    assert got == {r["conv_id"]: (r["t"], r["n"]) for r in nested.collect()}
    assert got[2] == ("", 1) and got[3][0].startswith("<|im_start|>system\na<|im_end|>")


def test_flat_templates_match_nested(spark):
    from turnstile.sources.tables import nest_turns
    flat = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "tool", "x"), (1, 3, "assistant", "A"),
                                  (2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    nested = nest_turns(flat)
    c = F.col("conversations")
    cases = [(render.role_upper_piece, render.role_upper(c), ""),
             (render.instruction_ja_piece, render.instruction_ja(c, True), render.instruction_ja_prompt()),
             (render.vicuna_piece(True), render.vicuna(c, parity_misspelling=True), "")]
    for piece, nested_col, suffix in cases:
        a = {r["conv_id"]: r["text"] for r in render.render_flat(flat, piece, suffix=suffix).collect()}
        b = {r["conv_id"]: r["t"] for r in nested.select("conv_id", nested_col.alias("t")).collect()}
        assert a == b
