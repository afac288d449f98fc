"""The resumable feed gives the windows of the batch operator, whatever stops it."""

import os

import pytest

from turnstile.operators import mix, tokens
from turnstile.streaming import pack_stream as P


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, " ".join(f"w{i}x{j}" for j in range(i * 7 % 23)) if i % 11 else None) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def windows(frame):
    return {(r["shard"], r["chunk"]): (r["input"], r["label"], r["doc_ids"]) for r in frame.collect()}


def test_restarts_give_the_windows_of_the_batch_operator(spark, docs, tmp_path):
    table = P.pack_table(docs, "text", "doc_id", 2)
    want = windows(tokens.stream_pack_ranks(docs, "text", "doc_id", 16, 2))
    for name, rows, batches in (("a", 7, 5), ("b", 1000, 1)):
        got = P.pack_batches(table, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", rows, 16, batches)
        assert windows(got) == want and got.count() == len(want)
    again = P.pack_batches(table, f"{tmp_path}/a", f"{tmp_path}/a-state", 7, 16, 1)        # past the end: nothing more
    assert windows(again) == want and again.count() == len(want)


def test_batch_that_died_before_its_commit_appears_once(spark, docs, tmp_path):
    table = P.pack_table(docs, "text", "doc_id", 1)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    some = P.pack_batches(table, out, state, 20, 16, 2).count()
    os.remove(f"{state}/commits/1")             # as if the driver was lost after the windows were written
    if os.path.exists(f"{state}/commits/.1.crc"):
        os.remove(f"{state}/commits/.1.crc")
    whole = P.pack_batches(table, out, state, 20, 16, 1)        # runs the second batch again, then the third
    want = windows(tokens.stream_pack(docs, "text", "doc_id", 16))
    assert windows(whole) == want and whole.count() == len(want) > some


def test_epochs_run_on_into_each_other(spark, docs, tmp_path):
    table = P.pack_table(docs, "text", "doc_id", 1)
    got = P.pack_batches(table, f"{tmp_path}/out", f"{tmp_path}/state", 50, 16, 4, epochs=3)
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    ids = {r["doc"]: r["ids"] for r in table.collect()}
    stream = [x for _ in range(3) for r in rows for x in ids[r["doc_id"]]]
    found = {r["chunk"]: r for r in got.collect()}
    assert len(found) == len(stream) // 17 == got.count()
    for c, r in found.items():
        assert r["input"] + r["label"][-1:] == stream[17 * c:17 * c + 17]
    assert max(r["epoch"] for r in found.values()) == 2
    endless = P.pack_batches(table, f"{tmp_path}/on", f"{tmp_path}/on-state", 60, 16, 4, epochs=None)
    assert endless.count() == 4 * sum(map(len, ids.values())) // 17


def test_shards_agree_with_the_batch_operator(spark, docs):
    table = P.pack_table(docs, "text", "doc_id", 7).select("doc", "rank")
    want = mix.shard_contiguous(docs, 7, ["doc_id"]).select("doc_id", "shard")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_are_small_groups_and_only_open_ones_keep_state(spark, docs, tmp_path):
    """A task holds a block and not all samples of a rank; many blocks, cut documents and restarts give the same windows."""
    table = P.pack_table(docs, "text", "doc_id", 2)
    want = windows(tokens.stream_pack_ranks(docs, "text", "doc_id", 4, 2))
    for name, rows, batches in (("a", 7, 5), ("b", 1000, 1)):
        got = P.pack_batches(table, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", rows, 4, batches, block_tokens=10)
        assert windows(got) == want and got.count() == len(want)
    left = spark.read.format("statestore").option("stateVarName", "position").load(f"{tmp_path}/a-state").collect()
    assert 0 < len(left) <= 2           # the last block of each rank
    assert all(len(r["value"]["tokens"]) < 5 for r in left)


def test_equal_ids_and_long_counters(spark, tmp_path):
    rows = [(i // 2, f"w{i} x y") for i in range(2100)]
    table = P.pack_table(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 1)
    got = P.pack_batches(table, f"{tmp_path}/out", f"{tmp_path}/state", 1500, 9, 2, epochs=None).collect()
    ids = [r["ids"] for r in sorted(table.collect(), key=lambda r: r["i"])]
    stream = [x for d in (ids + ids)[:3000] for x in d]
    assert sorted((r["chunk"], r["input"] + r["label"][-1:]) for r in got) == [(c, stream[10 * c:10 * c + 10]) for c in range(len(stream) // 10)]
