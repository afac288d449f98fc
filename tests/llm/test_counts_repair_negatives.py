"""Token counts, conversation repair and hard negatives against brute force, and on odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from turnstile.llm import catalog
from turnstile.llm import hardneg as H
from turnstile.llm import repair as R
from turnstile.llm import tokencounts as C
from turnstile.llm.oracles import ORACLE

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def as_duck(con, name, frame):
    con.register(name, frame.toArrow())


def same_rows(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = [tuple(str(r[c]) for c in names) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(str(x) for x in r) for r in want.select(", ".join(names)).fetchall())


# 11 token counts

ODD_TEXTS = [None, "", " ", "  ", " a", "a ", "a  ", "  a  b ", "a\nb\t c", "x▁y ▁", "</s><unk> <s>é ﬁ\x00 z", "one two one",
             "W" * 17 + " " + "w" * 16, "né " * 500, "q" * 100_000, " " * 5000, "数据 处理　流程", "one two one"]


def test_token_counts_equal_the_library(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000 + i if i % 5 else None, t) for i, t in enumerate(ODD_TEXTS)], docs.schema)
    rows = docs.unionByName(odd)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "")))
                  for r in rows.collect())
    for keys in (C.TABLE_KEYS, 16):             # all in the broadcast table, nearly all in the workers' tables
        got = C.count_tokens(rows, PIECES, table_keys=keys).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)


def test_token_counts_of_a_json_tokenizer(spark):
    import tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "id long, body string")
    whole = tokenizers.Tokenizer.from_file(path)
    got = C.count_tokens(rows, path, "id", "body", limit=3).collect()
    assert {r.id: r.n_tokens for r in got} == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD_TEXTS)}
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)


def test_token_counts_clashing_names_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b", 5, "x", 2)], "n_tokens long, text string, a int, size string, n_bytes long")
    got = C.count_tokens(rows.select(F.col("n_tokens").alias("n"), "text", "a", "size", "n_bytes"), PIECES, "n").first()
    assert (got["n"], got["n_bytes"], got["n_tokens"]) == (1, 3, 2)
    assert C.count_tokens(rows.where("false"), PIECES, "a").count() == 0


def test_worker_table_is_bounded():
    with open(PIECES, "rb") as f:
        counter = C.PieceCounter(f.read())
    counter.table = C.LengthTable(8)
    texts = [f"word{i} w{i}" for i in range(50)] + ["word1 word1"]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        n = counter.counts(C.LengthTable(1), data, np.array([0, len(data)]))
        assert n.tolist() == [len(counter.model.encode(t))] and counter.table.held <= 8


# 12 conversation repair

def brute_edits(rows, faults):
    """Least (cost, audit) by filling the whole lattice, row by row."""
    label = {(0, 0): (0, "")}

    def put(node, value):
        if node not in label or value < label[node]:
            label[node] = value

    user_next = {0: 2, 1: 2, 2: 3, 3: 2}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for q, to in user_next.items():
                if (i, q) in label:
                    cost, audit = label[i, q]
                    put((i, to), (cost + 5, audit + "I"))
        if i == len(rows):
            break
        for q, to in user_next.items():
            if (i, q) not in label:
                continue
            cost, audit = label[i, q]
            put((i + 1, q), (cost + 2, audit + "D"))
            if faults[i] != R.MUST_GO:
                more = 5 if faults[i] == R.CUT_OFF else 0
                if rows[i] == "s" and q == 0:
                    put((i + 1, 1), (cost + more, audit + "K"))
                if rows[i] == ("a" if to == 3 else "u"):
                    put((i + 1, to), (cost + more, audit + "K"))
                put((i + 1, to), (cost + more + 1, audit + "R"))
    return min(label[k] for k in ((len(rows), 0), (len(rows), 3)) if k in label)


def test_cheapest_edits():
    random.seed(3)
    for _ in range(4000):
        n = random.randint(0, 10)
        rows = [random.choice("suaxS ") if random.random() < 0.5 else "ua"[i % 2] for i in range(n)]
        faults = bytes(random.choice([0, 0, 0, 1, 2]) for _ in range(n))
        assert R.cheapest_edits(rows, faults) == brute_edits(rows, faults)
    assert R.cheapest_edits([], b"") == (0, "")
    assert R.cheapest_edits(["u"], b"\0") == (2, "D") and R.cheapest_edits(["s"], b"\0") == (2, "D")
    rows = [random.choice("suaa") for _ in range(3000)]
    assert R.cheapest_edits(rows, bytes(3000)) == brute_edits(rows, bytes(3000))


TALKS = "conv_id long, turn long, role string, text string, audit string, key long"
ODD_TALKS = ([(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Yes!", "x", 1), (1, 1, "assistant", "Yes!", "x", 1), (1, None, "system", "S.", "x", 1),
              (2, 5, None, None, None, None), (2, None, "tool", "", None, 2), (2, None, "user", "a.", None, 2), (2, 900, "", "x?  \n", None, 2),
              (None, 0, "user", "Q?", None, 3), (None, 1, "assistant", "A", None, 3), (3, -7, "usher", "..", None, 3), (3, 4, "user", " \t\x0b", None, 3)]
             + [(10 + i // 6, i % 6, "ua"[i % 2] and ("user", "assistant")[i % 2], f"t{i % 5}" + ".?"[i % 2] * (i % 3 > 0), None, i) for i in range(600)]
             + [(500, t, ("user", "assistant")[t % 2], f"a long talk, row {t % 90}.", None, t) for t in range(700)])


def test_repair_report_matches_sql(spark):
    rows = spark.createDataFrame(ODD_TALKS, TALKS).repartition(5)
    con = duckdb.connect()
    as_duck(con, "conversations", rows)
    want = con.sql(ORACLE["op12_repair_conversations"])
    broken = R.damage(rows)
    same_rows(R.repair_report(broken, gone=F.col("dropped")), want)
    # texts of longer conversations stay behind and stream by in the second pass: the same result
    same_rows(R.repair_report(broken, gone=F.col("dropped"), held_bytes=2000), want)
    same_rows(R.repair_report(broken, gone=F.col("dropped"), held_bytes=0), want)


def test_repaired_rows_have_the_form_and_the_digest(spark):
    import re
    broken = R.damage(spark.createDataFrame(ODD_TALKS, TALKS))
    talks = {}
    for r in sorted(R.repair_conversations(broken, gone=F.col("dropped")).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(talks.setdefault(r.conv_id, []))
        talks[r.conv_id].append(r)
    for r in R.repair_report(broken, gone=F.col("dropped")).collect():
        mine = talks.get(r.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in mine))
        assert "".join(x.edit for x in mine) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256


def test_repair_of_empty_and_dropped(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    got = R.repair_report(rows, gone=F.col("dropped")).first()
    assert tuple(got) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.repair_report(rows.where("false")).count() == 0 and R.repair_conversations(rows.where("false")).count() == 0


# 13 hard negatives

def brute_negatives(rows):
    """Rows (id, vector, label, is anchor) that take part, all against all, in Python's integers."""
    whole = [(H.NO_ID if i is None else i, label, [int(np.floor(256.0 * float(x))) for x in v], a) for i, v, label, a in rows
             if label is not None and v is not None and all(x is not None and np.isfinite(256.0 * float(x)) for x in v)]
    out = []
    for i, label, q, a in whole:
        if not a:
            continue
        score = [(-max(-H.NO_ID, min(H.NO_ID, sum(x * y for x, y in zip(q, w)))), j, m) for j, m, w, _ in whole]
        for s, p, _ in sorted(x for x in score if x[2] == label and x[1] != i)[:H.POSITIVES]:
            inside = sorted((n, j) for n, j, m in score if m != label and -30 * s <= -100 * n <= -90 * s)[:H.NEGATIVES]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j) in enumerate(inside)]
    return sorted(tuple(None if x == H.NO_ID else x for x in r) for r in out)


def found(frame):
    return sorted((tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                                  "negative_score").collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, is_anchor boolean, id long, cell int"


def with_names(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA).repartition(3)


def test_hard_negatives_clusters_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 10))
    rows = []
    for i in range(900):
        v = centre[i % 6] + 0.3 * rng.normal(size=10)
        rows.append((i, [float(np.float32(x / np.linalg.norm(v))) for x in v], int(rng.integers(0, 4)), i % 60 == 0))
    rows += [(2000 + i, rows[7][1], i % 3, i == 5) for i in range(150)]           # one vector many times
    monkeypatch.setattr(H, "STEP_ROWS", 16)
    want = sorted(brute_negatives(rows), key=str)
    for chunk, k in ((H.CHUNK, None), (4, 5)):
        assert found(H.hard_negatives(with_names(spark, rows), F.col("is_anchor"), k=k, chunk=chunk)) == want
    assert want


def test_search_stops_early_and_visits_by_falling_bounds():
    rng = np.random.default_rng(2)
    points = np.floor(256 * np.repeat(rng.normal(size=(8, 6)), 60, axis=0) + rng.integers(-3, 4, (480, 6)))
    books = H.Codebooks(points, 4)
    block = H.Block(np.arange(480), np.arange(480) % 2, points, list(books.codes(points)), books)
    first, second = block.bounds(points[:1])
    runs, seen, lasts = [], 0, []
    for left, rows in block.visit(first[0], second[0]):
        runs.append(left)
        seen += len(rows)
        lasts.append((block.rows[rows] @ points[0]).max())
    assert seen == 480 and runs == sorted(runs, reverse=True)
    assert all(later <= left for left, later in zip(runs, lasts[1:]))
    step = H.STEP_ROWS
    try:
        H.STEP_ROWS = 16
        best, visited = H.Best(5), 0
        for left, rows in block.visit(first[0], second[0]):
            visited += len(rows)
            best.offer(block.rows[rows] @ points[0], block.ids[rows])
            if best.last() is not None and left < best.last():
                break
        assert visited < 300
        assert best.score == sorted((block.rows @ points[0]).tolist(), reverse=True)[:5]
    finally:
        H.STEP_ROWS = step


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5, 0.1], 1, True), (1, [0.5, 0.4], 1, False), (2, [0.3, 0.3, 0.3], 2, False), (2, [0.3, 0.3, 0.3], 2, False),
            (None, [0.2, 0.3, 0.1], 2, False), (3, None, 1, True), (4, [0.1, None], 1, True), (5, [nan, 1.0], 2, False), (6, [inf], 2, True),
            (7, [], 1, True), (8, [0.4, 0.4], None, True), (0, [0.25, 0.5, 0.1], 1, True), (9, [0.0, 0.0], 3, False), (10, [-0.5, 0.1], 2, False),
            (11, [1e30, 1e30], 5, True), (12, [1e30, 1.0], 5, False), (13, [5e29, 1.0], 6, False), (None, [0.1, 0.1], 2, True), (14, [0.2], 2, None)]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label, a) for i, v, label, a in rows]
    assert found(H.hard_negatives(with_names(spark, rows), F.col("is_anchor"))) == sorted(brute_negatives(rows), key=str)
    assert found(H.hard_negatives(with_names(spark, rows).where("false"), F.col("is_anchor"))) == []
    assert found(H.hard_negatives(with_names(spark, rows), F.lit(None).cast("boolean"))) == []


@pytest.mark.parametrize("name", ["op12_repair_conversations", "op13_hard_negatives"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    same_rows(catalog.QUERIES[name](spark, SF_SMALL), con.sql(catalog.ORACLE[name]))
