"""The pipeline against brute force on a small table, and on odd rows."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_operators import DOCS, ODD, brute_components, brute_hits
from turnstile.session import materialize


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, SF_SMALL), "test-stage")
        kept[name] = (before.collect(), after.collect())
        if name != "sharding":
            assert after.columns == docs.columns
        before = after
    came, left = kept["language"]
    assert sorted(came) == sorted(left)                     # nothing unreadable in this table
    came, left = kept["near_duplicates"]
    group = brute_components([(r.doc_id, r.text) for r in came])
    assert sorted(r.doc_id for r in left) == sorted({c for _, c in group.values()})
    came, left = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in came], items)
    assert sorted(r.doc_id for r in left) == sorted(d for d, x in hits.items() if not x[1])
    came, left = kept["mixing"]
    times = collections.Counter(r.doc_id for r in left)
    words = {r.doc_id: len(r.text.split()) for r in came}
    assert set(times) <= set(words) and max(times.values()) <= 3
    total = sum(words.values())
    assert abs(sum(words[d] * n for d, n in times.items()) - total) < 0.2 * total
    came, left = kept["sharding"]
    assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in came)


def test_odd_rows(spark, tmp_path):
    table = spark.createDataFrame(ODD + ODD[3:5], DOCS).withColumn("extra", F.lit("kept"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*table.columns, "shard", "slot"]
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in ODD}
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
