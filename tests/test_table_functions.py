"""Sample processors as table functions: schema from the arguments, rows as the Columns give them."""

import pytest

from turnstile.operators import turns
from turnstile.sources import table_functions as F

SAMPLES = "id long, text string, conversations array<struct<role:string,content:string,`from`:string,value:string>>, tag string"
ROWS = [(1, "t", None, "a"), (2, "", [("user", "hi", None, None), (None, "", "gpt", "yes"), (None, None, None, None)], None),
        (3, None, None, "c"), (4, None, [], "d"), (None, None, [("", None, "", "v\nw")], "e")]


def test_rows_equal_sample_text(spark):
    F.register_processors(spark)
    df = spark.createDataFrame(ROWS, SAMPLES).repartition(3)
    df.createOrReplaceTempView("samples_for_functions")
    got = spark.sql("SELECT * FROM process_samples(TABLE(samples_for_functions), 'conversation_text')")
    assert got.columns == ["id", "tag", "sample_text"]
    want = df.select("id", "tag", turns.sample_text(df, on_missing="null").alias("sample_text"))
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    counts = spark.sql("SELECT id, n_turns, n_chars FROM process_samples(TABLE(samples_for_functions), processor => 'turn_counts') WHERE id = 2")
    assert [tuple(r) for r in counts.collect()] == [(2, 3, 5)]


def test_unknown_names_and_own_processors(spark):
    F.register_processors(spark)
    spark.createDataFrame(ROWS, SAMPLES).createOrReplaceTempView("samples_for_functions")
    with pytest.raises(Exception, match="conversation_text, turn_counts"):
        spark.sql("SELECT * FROM process_samples(TABLE(samples_for_functions), 'nothing')").collect()
    F.register_processors(spark, {**F.PROCESSORS, "shout": F.Processor(F.TEXT, lambda s: ((s["text"] or "").upper(),))}, "own_samples")
    rows = spark.sql("SELECT sample_text FROM own_samples(TABLE(SELECT id, text FROM samples_for_functions), 'shout') WHERE id = 1").collect()
    assert rows[0][0] == "T"
