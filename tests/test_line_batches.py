"""Runs of lines by number: only the ranges they touch are opened, and every run is what a plain loop would read."""

import os
import random

import pytest
from pyspark.sql import types as T

from turnstile.sources import line_batches as L

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def lines_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.randint(0, 9)
        out.append("" if kind == 0 else "{broken" if kind == 1 else f'{{"id": {i}, "t": "{"é x" * rng.randint(0, 40)}"}}')
    return out


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("range_bytes", [1, 7, 100, 1 << 20])
def test_ranges_agree_with_a_plain_loop(tmp_path, end, range_bytes):
    """Every line starts in one range, whatever the cut."""
    texts = ["", "ab", "", "é" * 9, "x", "", ""] + (["last"] if not end else [])
    path = f"{tmp_path}/f.jsonl"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(texts) + end)
    size = os.path.getsize(path)
    seen = []
    for lo in range(0, size, range_bytes):
        hi = min(lo + range_bytes, size)
        mine = list(L._lines_of(path, lo, hi))
        assert len(mine) == L._line_starts(path, lo, hi, size)
        seen += mine
    assert [x.decode() for x in seen] == texts


def test_any_run_of_lines(spark, tmp_path):
    whole = []
    for k in range(3):
        part = lines_of(60, k) if k != 1 else []
        whole += part
        with open(f"{tmp_path}/part-{k}.jsonl", "w", encoding="utf-8", newline="") as f:
            f.write("".join(x + ("\r\n" if k else "\n") for x in part))
    with open(f"{tmp_path}/_SUCCESS", "w") as f:
        f.write("not a line\n")
    index = L.index_lines(spark, str(tmp_path), range_bytes=300)
    assert index.lines == 120
    for start, n in ((0, 120), (0, 1), (59, 2), (37, 40), (119, 5), (120, 5), (0, 0)):
        frame = L.read_lines(spark, index, start, n)
        got = sorted(map(tuple, frame.collect()))
        assert got == [(i, whole[i], i == 119) for i in range(start, min(start + n, 120))]
        asked = index.touching(start, start + n)
        assert frame.rdd.getNumPartitions() == max(1, len(asked)) and len(asked) <= 2 + n
    good, bad, is_end = L.load_jsonl_batch(spark, index, 30, 60, SCHEMA)
    assert sorted(r["line"] for r in bad.collect()) == [i for i in range(30, 90) if whole[i] == "{broken"]
    assert sorted((r["line"], r["id"] % 60) for r in good.collect()) == [(i, i % 60) for i in range(30, 90) if whole[i] and whole[i][1] != "b"]
    assert not is_end and L.load_jsonl_batch(spark, index, 60, 60, SCHEMA)[2]


def test_empty_and_missing(spark, tmp_path):
    open(f"{tmp_path}/a.jsonl", "w").close()
    index = L.index_lines(spark, f"{tmp_path}/a.jsonl")
    assert index.lines == 0 and index.is_end(0, 1) and L.read_lines(spark, index, 0, 10).count() == 0
    with pytest.raises(FileNotFoundError):
        L.index_lines(spark, f"{tmp_path}/none")


def test_stream_goes_on_behind_the_committed_line(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    os.mkdir(source)

    def append(name, text):
        with open(f"{source}/{name}", "a", encoding="utf-8", newline="") as f:
            f.write(text)

    def run(index=None):
        rows = L.stream_lines(spark, source, index, start=1, range_bytes=16)
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["line"], r["value"]) for r in spark.read.schema(L.LINES).parquet(out).collect())

    append("a.jsonl", "zero\none\ntwo\nopen")
    index = L.index_lines(spark, source, 16)
    assert run(index) == [(1, "one"), (2, "two")]
    append("a.jsonl", " end\nfour\n")
    append("b.jsonl", "five\n")
    assert run(index) == [(1, "one"), (2, "two"), (3, "open end"), (4, "four"), (5, "five")]
    assert len(run()) == 5
