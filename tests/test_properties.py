"""Property tests (hypothesis) for the operators whose contract is a law rather
than a fixed table: permutations, slice sizes, packing conservation/capacity."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from turnstile.functions.tokenize import DEFAULT_TOKENIZER
from turnstile.operators import mix, tokens
from turnstile.operators.index import with_row_index

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(keys=st.lists(st.integers(0, 10_000), min_size=1, max_size=60, unique=True), parts=st.integers(1, 7),
       seed=st.integers(0, 1000))
def test_shuffle_permutation_independent_of_partitioning(spark, keys, parts, seed):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    a = [r["k"] for r in mix.deterministic_shuffle(df, ["k"], seed).collect()]
    b = [r["k"] for r in mix.deterministic_shuffle(df.repartition(parts), ["k"], seed).collect()]
    assert a == b and sorted(a) == sorted(keys)


@SETTINGS
@given(n=st.integers(0, 120), pct=st.integers(0, 100))
def test_percent_slice_size(spark, n, pct):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = sorted(r["k"] for r in mix.slice_rows(df, f"train[:{pct}%]", ["k"]).collect())
    assert got == list(range(round(pct * n / 100.0)))


@SETTINGS
@given(groups=st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=80))
def test_row_index_is_dense_per_group(spark, groups):
    df = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "g string, k long")
    rows = with_row_index(df, ["k"], ["g"], partitions=3).collect()
    for g in set(groups):
        idx = sorted(r["row_idx"] for r in rows if r["g"] == g)
        assert idx == list(range(groups.count(g)))


@SETTINGS
@given(lengths=st.lists(st.integers(1, 12), min_size=1, max_size=25), seq=st.integers(2, 9))
def test_stream_pack_conserves_tokens(spark, lengths, seq):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "id long, text string")
    out = tokens.stream_pack(docs, "text", "id", seq).collect()
    total = sum(n + 2 for n in lengths)
    assert len(out) == total // (seq + 1)
    assert all(len(r["input"]) == seq and r["input"][1:] == r["label"][:-1] for r in out)
    bos = sum(r["input"].count(DEFAULT_TOKENIZER.bos_id) for r in out)
    assert bos <= len(lengths)


@SETTINGS
@given(lengths=st.lists(st.integers(1, 30), min_size=1, max_size=60), cap=st.integers(5, 40))
def test_sample_pack_capacity(spark, lengths, cap):
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")
    out = tokens.sample_pack(df, "id", "n", cap, F.lit(0)).collect()
    assert sorted(r["id"] for r in out) == list(range(len(lengths)))
    sums = {}
    for r in out:
        if r["bin"] is not None:
            sums[r["bin"]] = sums.get(r["bin"], 0) + r["n"]
    assert all(v <= cap for v in sums.values())
    fits = sum(n for n in lengths if n <= cap)
    assert len(sums) >= math.ceil(fits / cap)
    assert [r["id"] for r in out if r["bin"] is None] == [i for i, n in enumerate(lengths) if n > cap]


@SETTINGS
@given(n=st.integers(1, 50), world=st.integers(1, 6))
def test_shards_are_contiguous_and_balanced(spark, n, world):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r["k"]: r["shard"] for r in mix.shard_contiguous(df, world, ["k"]).collect()}
    seq = [got[i] for i in range(n)]
    assert seq == sorted(seq)
    sizes = [seq.count(s) for s in range(world)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@SETTINGS
@given(sizes=st.lists(st.integers(0, 30), min_size=1, max_size=4),
       pcts=st.lists(st.integers(0, 100), min_size=4, max_size=4))
def test_per_group_slices(spark, sizes, pcts):
    rows = [(f"s{g}", k) for g, n in enumerate(sizes) for k in range(n)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "source string, k long")
    specs = {f"s{g}": f"train[:{pcts[g]}%]" for g in range(len(sizes))}
    got = sorted((r["source"], r["k"]) for r in mix.slice_rows(df, None, ["k"], ["source"], per_group=specs).collect())
    want = sorted((f"s{g}", k) for g, n in enumerate(sizes) for k in range(round(pcts[g] * n / 100.0)))
    assert got == want


@SETTINGS
@given(lengths=st.lists(st.integers(1, 15), min_size=1, max_size=30), seq=st.integers(2, 8), world=st.integers(1, 4))
def test_rank_packing_matches_python(spark, lengths, seq, world):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "id long, text string")
    got = {(r["shard"], r["chunk"]): r["input"] + r["label"][-1:]
           for r in tokens.stream_pack_ranks(docs, "text", "id", seq, world).collect()}
    wid = DEFAULT_TOKENIZER
    n = len(lengths)
    div, mod = divmod(n, world)
    bounds, start = [], 0
    for s in range(world):
        size = div + (1 if s < mod else 0)
        bounds.append((start, start + size))
        start += size
    want = {}
    for s, (lo, hi) in enumerate(bounds):
        buf = []
        for i in range(lo, hi):
            buf += [wid.bos_id] + ["w"] * lengths[i] + [wid.eos_id]
        for c in range(len(buf) // (seq + 1)):
            want[(s, c)] = buf[c * (seq + 1):(c + 1) * (seq + 1)]
    assert set(got) == set(want)
    for k, v in got.items():
        assert [x for x in v if x in (wid.bos_id, wid.eos_id)] == [x for x in want[k] if x in (wid.bos_id, wid.eos_id)]
        assert len(v) == len(want[k])


_JUDGE_ALPHABET = st.sampled_from(list("ab <>&;/ \n\t") + ["amp;", "<b>", "</b>", "é", "　", "same", "A is better"])


@SETTINGS
@given(expl=st.lists(_JUDGE_ALPHABET, max_size=8), verd=st.lists(_JUDGE_ALPHABET, max_size=4),
       wrap=st.sampled_from(["plain", "fence", "noise"]))
def test_judge_fast_path_agrees_with_parser(spark, expl, verd, wrap):
    from turnstile.operators import judge
    e, v = "".join(expl), "".join(verd)
    core = f"<result><explanation>{e}</explanation><verdict>{v}</verdict></result>"
    raw = {"plain": core, "fence": "```xml\n" + core + "\n```", "noise": "x " + core + " y"}[wrap]
    df = spark.createDataFrame([(1, "p", "a", "b", raw)],
                               "id bigint, prompt string, response_a string, response_b string, raw_response string")

    def one(fast):
        r = judge.judge_rows(df, on_error="default", fast_path=fast).first()
        return r["verdict"], r["error"], r["result"]["score"], r["result"]["custom_fields"]["explanation"]

    assert one(True) == one(False)
