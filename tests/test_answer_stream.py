"""Answers that arrive again, change, or meet a batch that died."""

import json
import os

from turnstile.streaming import answer_stream as A


def put(folder, name, rows):
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        for i, verdict in rows:
            f.write(json.dumps({"id": i, "model": "m", "prompt": "p", "response_a": "a", "response_b": "b",
                                "raw_response": f"<result><explanation>e</explanation><verdict>{verdict}</verdict></result>"}) + "\n")


def test_answers_again(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    os.mkdir(source)

    def run():
        A.start_answers(spark, source, out, state).awaitTermination()
        rows = A.latest_results(spark, out).collect()
        assert len(rows) == len({r["id"] for r in rows})
        return {r["id"]: (r["verdict"], r["revision"]) for r in rows}

    put(source, "a", [(1, "A is better"), (2, "B is better")])
    first = run()
    assert first == {1: ("A is better", 1), 2: ("B is better", 1)}
    written = spark.read.parquet(out).count()
    put(source, "b", [(1, "A is better"), (2, "B is better")])          # sent again under another name
    assert run() == first and spark.read.parquet(out).count() == written
    put(source, "c", [(2, "same"), (3, "same")])
    assert run() == {1: ("A is better", 1), 2: ("same", 2), 3: ("same", 1)}
    last = max(int(x) for x in os.listdir(f"{state}/commits") if x.isdigit())
    count = spark.read.parquet(out).count()
    os.remove(f"{state}/commits/{last}")                                 # the last batch runs again
    if os.path.exists(f"{state}/commits/.{last}.crc"):
        os.remove(f"{state}/commits/.{last}.crc")
    assert run() == {1: ("A is better", 1), 2: ("same", 2), 3: ("same", 1)} and spark.read.parquet(out).count() == count
