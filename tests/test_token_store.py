"""Dense document index: order, sentinel, lookups that read only what they need."""

import pytest
from pyspark.sql import functions as F

from turnstile.sources import token_store as S


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(1000 - 7 * i if i != 5 else None, None if i % 6 == 2 else [i * 100 + j for j in range(i % 13)]) for i in range(120)]
    path = f"{tmp_path_factory.mktemp('store')}/s"
    df = spark.createDataFrame(rows, "key int, token_ids array<int>").repartition(5)
    totals = S.write_token_store(df, path, ["key"], part_tokens=40, keep=["key"]).first()
    good = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0]))
    assert tuple(totals) == (len(good), len(rows) - len(good), sum(len(r[1]) for r in good))
    return path, [r[1] for r in good]


def test_index_and_sentinel(spark, store):
    path, docs = store
    offsets = [0]
    for d in docs:
        offsets.append(offsets[-1] + len(d))
    assert [tuple(r) for r in S.document_index(spark, path).orderBy("doc").collect()] == list(enumerate(offsets))
    assert [r["n_tokens"] for r in S.first_lengths(spark, path).orderBy("doc").collect()] == [len(d) for d in docs[:10]]
    stats = S.index_stats(spark, path).first()
    assert (stats["documents"], stats["tokens"], stats["bytes"]) == (len(docs), offsets[-1], 4 * offsets[-1])
    assert S.is_finished(spark, path) and not S.is_finished(spark, path + "x")


def test_lookups(spark, store):
    path, docs = store
    stream = [x for d in docs for x in d]
    for lo, hi in ((0, 3), (17, 18), (50, 90), (len(docs) - 1, len(docs) + 5), (500, 600)):
        got = S.get_documents(spark, path, lo, hi).orderBy("doc").collect()
        assert [(r["doc"], r["token_ids"]) for r in got] == [(i, docs[i]) for i in range(lo, min(hi, len(docs)))]
    for lo, hi in ((0, 1), (39, 41), (3, 200), (len(stream) - 2, len(stream) + 9), (5, 5), (10**6, 10**6 + 1)):
        got = S.get_tokens(spark, path, lo, hi).orderBy("first").collect()
        assert [x for r in got for x in r["token_ids"]] == stream[lo:hi]


def test_a_lookup_reads_only_its_parts(spark, store):
    path, docs = store
    parts = spark.read.parquet(f"{path}/data").select("part").distinct().count()
    found = S.get_documents(spark, path, 40, 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(doc,40)" in plan and "LessThan(doc,42)" in plan
    read = found.select(F.input_file_name()).distinct().count()
    assert read <= 2 < parts


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, [])], "key int, token_ids array<int>")
    assert tuple(S.write_token_store(df, f"{tmp_path}/s", ["key"]).first()) == (0, 2, 0)
    assert [tuple(r) for r in S.document_index(spark, f"{tmp_path}/s").collect()] == [(0, 0)]
    assert S.first_lengths(spark, f"{tmp_path}/s").count() == 0


def test_small_parts_share_files_and_ids_are_computed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FOLDER_TOKENS", 400)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def ids(key):
        calls.add(1)
        return list(range(key, key + 10))

    path = f"{tmp_path}/s"
    rows = spark.range(200).repartition(3).withColumn("token_ids", ids("id"))
    S.write_token_store(rows, path, ["id"], part_tokens=20, row_group_bytes=1 << 20)
    assert calls.value == 200
    data = spark.read.parquet(f"{path}/data")
    assert data.select("part").distinct().count() == 100
    assert data.select(F.input_file_name()).distinct().count() <= 10
    assert [r["part"] for r in S.get_tokens(spark, path, 395, 405).select("doc").distinct().orderBy("doc")
            .join(data.select("doc", "part"), "doc").orderBy("doc").collect()] == [19, 20]
    got = S.get_documents(spark, path, 37, 43).orderBy("doc").collect()
    assert [(r["doc"], r["offset"], r["token_ids"]) for r in got] == [(i, 10 * i, list(range(i, i + 10))) for i in range(37, 43)]
