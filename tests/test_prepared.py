"""Prepared copies: only changed files are built again, unfinished writes are never read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from turnstile.sources import prepared as P


def put(folder, k, rows):
    with open(f"{folder}/f{k}.jsonl", "w", encoding="utf-8") as f:
        f.write("".join(json.dumps({"id": i, "t": t}) + "\n" for i, t in rows))


def read(spark, paths):
    return spark.read.schema("id long, t string").json(list(paths))


def build(rows):
    return rows.select("id", F.upper("t").alias("t"), "source_file")


def texts(spark, target, debug=False):
    return {r["id"]: r["t"] for r in P.read_prepared(spark, target, debug).collect()}


@pytest.fixture
def folders(tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    os.mkdir(source)
    for k in range(10):
        put(source, k, [(10 * k + i, f"a{k}é") for i in range(3)])
    return source, target


def test_one_changed_file_of_ten(spark, folders):
    source, target = folders
    run = lambda **kw: P.prepare(spark, source, target, kw.pop("build", build), read, pattern="*.jsonl", **kw)
    first = run()
    assert len(first.rebuilt) == 10 and texts(spark, target)[71] == "A7É"
    assert run().version == first.version                      # nothing to do
    put(source, 7, [(70, "new"), (71, "new")])
    second = run()
    assert second.rebuilt == ["f7.jsonl"] and texts(spark, target)[71] == "NEW" and 72 not in texts(spark, target)
    moved = {f.name: f.folder for f in first.files}
    assert all(f.folder == moved[f.name] for f in second.files if f.name != "f7.jsonl")
    os.utime(f"{source}/f2.jsonl", (1, 1))                     # another time, the same rows
    third = run()
    assert third.rebuilt == [] and third.version != second.version and len(texts(spark, target)) == 29
    os.remove(f"{source}/f0.jsonl")
    put(source, 99, [(990, "x")])
    assert run().rebuilt == ["f99.jsonl"] and len(texts(spark, target)) == 27
    assert len(run(refresh=True).rebuilt) == 10


def test_a_write_that_died_is_not_read(spark, folders):
    source, target = folders
    P.prepare(spark, source, target, build, read, pattern="*.jsonl")
    before = texts(spark, target)
    put(source, 4, [(40, "changed")])

    def dies(rows):
        return rows.select("id", F.when(F.col("id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("t")).alias("t"), "source_file")

    with pytest.raises(Exception, match="lost"):
        P.prepare(spark, source, target, dies, read, pattern="*.jsonl")
    assert texts(spark, target) == before
    # as if the driver was lost between the write of the data and the pointer
    spark.createDataFrame([(40, "half")], "id long, t string").write.parquet(f"{target}/data/lost/_part=x")
    assert texts(spark, target) == before
    assert P.prepare(spark, source, target, build, read, pattern="*.jsonl").rebuilt == ["f4.jsonl"]
    assert texts(spark, target)[40] == "CHANGED"
    assert "data/lost" in P.remove_unused(spark, target)
    assert texts(spark, target)[40] == "CHANGED" and P.remove_unused(spark, target) == []


def test_debug_copy_and_empty_results(spark, folders):
    source, target = folders
    P.prepare(spark, source, target, build, read, pattern="*.jsonl")
    few = P.prepare(spark, source, target, build, read, pattern="*.jsonl", debug_rows=4)
    assert sorted(texts(spark, target, debug=True)) == [0, 1, 2, 10] and len(texts(spark, target)) == 30
    assert P.prepare(spark, source, target, build, read, pattern="*.jsonl", debug_rows=4).version == few.version
    assert len(P.prepare(spark, source, target, build, read, pattern="*.jsonl", debug_rows=5).version) != 0
    assert len(texts(spark, target, debug=True)) == 5
    P.prepare(spark, source, f"{target}-none", lambda rows: build(rows).where("false"), read, pattern="*.jsonl")
    assert P.read_prepared(spark, f"{target}-none").count() == 0
    with pytest.raises(FileNotFoundError):
        P.read_prepared(spark, f"{target}-missing")
    with pytest.raises(FileNotFoundError):
        P.prepare(spark, f"{source}-missing", f"{target}-m", build, read)
