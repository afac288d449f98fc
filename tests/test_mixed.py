"""Values of several kinds in one column, against Python's own json, str and bool."""

import json

import pytest
from pyspark.sql import functions as F

from turnstile.operators import mixed as M

VALUES = ['"a"', '""', '" x "', "5", "0", "-3", "2.0", "0.0", "1.50", "1e10", "1e-7", "2.5e-4", "123456.789e20", "1e22", "1e300", "true", "false", "null",
          "[]", "{}", '["a", "", "b"]', '[1, "x", null, 0, false, true, 2.0]', "100000000000000000000", "0.1", '"é\\n\\"q"', "[[1]]"]


def python_content(value):
    if isinstance(value, list):
        return "\n".join(json.dumps(x, separators=(",", ":")) if isinstance(x, (list, dict)) else str(x) for x in value if x)
    return str(value) if value else ""


def test_values_as_python_writes_them(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "s string").withColumn("v", M.parsed("s"))
    got = {r["s"]: r for r in df.select("s", M.content_text(F.col("v")).alias("c"), M.truthy(F.col("v")).alias("t"),
                                        M.scalar_text(F.col("v")).alias("x")).collect()}
    for s in VALUES:
        value = json.loads(s)
        assert got[s]["t"] == bool(value), s
        assert got[s]["c"] == python_content(value), s
        if not isinstance(value, (list, dict)):
            assert got[s]["x"] == str(value), s


def test_kinds_and_bad_json(spark):
    rows = [("1", '"t"'), ("2", "[1]"), ("3", None), ("4", "bad{"), ("5", "null"), ("6", "1.5"), ("7", "true"), ("8", '{"a":1}')]
    df = spark.createDataFrame(rows, "k string, s string").withColumn("v", M.parsed("s"))
    kinds = dict(df.select("k", M.kind_of(F.col("v"))).collect())
    assert kinds == {"1": "string", "2": "list", "3": None, "4": None, "5": "null", "6": "number", "7": "boolean", "8": "object"}
    table = {r["kind"]: r["rows"] for r in M.content_kinds(df, F.col("v")).collect()}
    assert table == {"string": 1, "list": 1, "none": 2, "null": 1, "number": 1, "boolean": 1, "object": 1}
    assert [r[0] for r in df.select(M.content_text(F.col("v"))).collect()][2:5] == ["", "", ""]


MESSAGES = ('[{"role": "Human", "content": "q"}, {"from": "gpt", "value": ["a", "", 3]}, {"role": null, "from": "user", "content": "lost"}, '
            '{"role": "user", "content": null}, {"role": "tool", "content": "x"}, 7, {"content": 5}, {"role": "system", "value": false}]')


@pytest.mark.parametrize("name", ["normalize", "concat"])
def test_messages(spark, name):
    v = spark.createDataFrame([(MESSAGES,)], "s string").select(M.parsed("s").alias("v"))
    if name == "normalize":
        turns = v.select(M.normalize_messages(F.try_variant_get("v", "$", "array<variant>"))).first()[0]
        assert [tuple(t) for t in turns] == [("user", "q"), ("assistant", "a\n3"), ("system", "")]
    else:
        lines = v.select(M.conversation_text(F.col("v"))).first()[0].split("\n")
        assert lines == ["Human: q", 'gpt: ["a","",3]', "None: lost", "user: None", "tool: x", "unknown: ", "unknown: 5", "system: False", ""]
    plain = spark.createDataFrame([("5",), ('"t"',), (None,)], "s string").select(M.conversation_text(M.parsed("s"))).collect()
    assert [r[0] for r in plain] == ["5", "t", None]
