import json
import os
import tempfile

import duckdb
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as entry
from turnstile.sources.tables import TABLES
from tools.oracle_check import compare


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "text", "n_turns"]
    assert df.count() > 0


def test_every_query_has_callable_and_oracle_keys_subset():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle_small(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    ok, msg = compare([tuple(r) for r in df.collect()], df.columns,
                      res.fetchall(), [d[0] for d in res.description])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert entry.queries()[name](spark, SF_SMALL).count() >= 0


def test_judge_stream_resumes(spark):
    from turnstile.streaming.judge_stream import start_judge_stream
    d = tempfile.mkdtemp(prefix="turnstile-stream-")
    os.makedirs(f"{d}/in")
    ok = "<result><explanation>e</explanation><verdict>A is better</verdict></result>"

    def drop(name, ids):
        with open(f"{d}/in/{name}.json", "w") as f:
            for i in ids:
                f.write(json.dumps({"id": i, "model": "m", "prompt": "p", "response_a": "a", "response_b": "b",
                                    "raw_response": ok}) + "\n")

    drop("a", [1, 2])
    q = start_judge_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt")
    q.awaitTermination(120)
    drop("b", [3])
    q = start_judge_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{d}/out")
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]
    assert {r["score"] for r in out.select("result.score").collect()} == {1.0}


def test_streaming_verdict_counts(spark):
    from turnstile.streaming.judge_stream import start_verdict_counts
    d = tempfile.mkdtemp(prefix="turnstile-stream-counts-")
    os.makedirs(f"{d}/in")
    rows = [(1, "m1", "A is better"), (2, "m1", "same"), (3, "m2", "B is much better")]
    with open(f"{d}/in/part.json", "w") as f:
        for i, m, v in rows:
            raw = f"<result><explanation>e</explanation><verdict>{v}</verdict></result>"
            f.write(json.dumps({"id": i, "model": m, "prompt": "p", "response_a": "a", "response_b": "b",
                                "raw_response": raw}) + "\n")
    q = start_verdict_counts(spark, f"{d}/in", f"{d}/ckpt", query_name="vc_test")
    q.awaitTermination(120)
    got = {r["model"]: (r["n"], r["wins"], r["ties"], r["losses"]) for r in spark.sql("SELECT * FROM vc_test").collect()}
    assert got == {"m1": (2, 1, 1, 0), "m2": (1, 0, 0, 1)}
