"""Every operator against a brute-force version, and on nulls, empty tables, repeats, long texts and clashing names."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.test_words_codec import SPACES, SYMBOLS, low
from turnstile.llm import bloomlm as B
from turnstile.llm import catalog
from turnstile.llm import decontaminate as D
from turnstile.llm import graph as G
from turnstile.llm import jaccard as J
from turnstile.llm import language as L
from turnstile.llm import mixing as M
from turnstile.llm import quality as Q
from turnstile.llm import secretscan as X
from turnstile.llm import sharding as S
from turnstile.llm import tokenstore as T
from turnstile.llm import urlfilter as U

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 30_000
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (4, "one", None, "b", 3),
       (5, "one", "en", "b", 3), (6, LONG, "en", "a", len(LONG)), (7, LONG + "x", "en", "a", 1), (8, "é ü ß", "de", None, 5),
       (None, "one two three", "en", "c", 13), (9, "one\none\ntwo", "en", "c", 11)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD + ODD[3:5], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=5):
    w = re.findall(SPACES, low(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


# 1 language model

def test_lm_scores(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    token = {r.doc_id: re.findall(SPACES, low(r.text)) + [None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in token}
    count = collections.Counter(w for d, ws in token.items() if not held[d] for w in ws)
    total, distinct = sum(count.values()), len(count)
    train = docs.where(~B.held_out("doc_id"))
    small = B.LanguageModel(train, hot_words=50, max_broadcast_bytes=20_000)
    assert small.slices_per_pass < B.SLICES            # several passes, and words beyond the hot table
    scores = [dict(x.score(docs).select("doc_id", "score").collect()) for x in (B.LanguageModel(train), B.LanguageModel(train, hot_words=50))]
    assert scores[0] == pytest.approx(scores[1])        # the hot table plays no part in the score
    for model in (B.LanguageModel(train), small):
        got = {r.doc_id: r for r in model.score(docs).collect()}
        assert len(got) == len(token)
        for d, words in token.items():
            base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
            assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(words), sum(count[w] > 0 for w in words), total)
            assert got[d].base_score == pytest.approx(base, rel=1e-9)
            assert got[d].score < 0
    seen = sum(r.score for r in got.values() if not held[r.doc_id])
    assert seen > sum(r.base_score for r in got.values() if not held[r.doc_id])


def test_lm_pass_count_does_not_change_scores(docs):
    train = docs.where(~B.held_out("doc_id"))
    one, many = B.LanguageModel(train), B.LanguageModel(train, max_broadcast_bytes=20_000)
    a, b = (dict(m.score(docs).select("doc_id", "score").collect()) for m in (one, many))
    assert a == pytest.approx(b)


def test_lm_filter_levels(spark):
    key = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.arange(1, 4000) % 50 + 1
    rows = [(int(s), int(k), int(c)) for s, k, c in zip(B._slice_of(key), key.view(np.int64), count)]
    table = spark.createDataFrame(rows, "slice int, key long, n long").sort("slice")
    size = 3
    words = np.zeros((B.SLICES, size), np.uint64)
    for r in B.build_slices(table, size).collect():
        words[r["slice"]] |= np.frombuffer(r["bits"], np.uint64)
    found = np.zeros(len(key), np.uint8)
    B.Filter(0, B.SLICES, size, words.reshape(-1)).levels(key, found)
    want = B.level_of(count)
    assert (found >= want).all() and (found == want).mean() > 0.9
    other = np.zeros(len(key), np.uint8)
    B.Filter(0, B.SLICES, size, words.reshape(-1)).levels(key + np.uint64(1), other)
    assert (other > 0).mean() < 0.2
    means = B.level_counts()
    assert means[0] == 0 and means[1] == 1 and abs(means[B.level_of(np.array([40]))[0]] - 40) < 20


def test_lm_odd_rows(odd, none):
    model = B.LanguageModel(odd)
    assert model.score(odd).count() == odd.count()
    assert model.score(none).count() == 0
    nothing = B.LanguageModel(none).score(odd).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


# 2 mixing

def test_water_filling_targets(spark):
    size, weight, cap = [10, 100, 1000, 5], [5.0, 3.0, 1.0, 0.0], 3
    rows = [(str(i), s, w) for i, (s, w) in enumerate(zip(size, weight))]
    got = {r.source: r.target for r in M.water_fill(
        spark.createDataFrame(rows, "source string, source_size long, weight double"), cap).collect()}
    target, open_, left = {}, set(range(3)), float(sum(size))
    while open_:
        share = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > cap * size[i]]
        if not over:
            target |= share
            break
        for i in over:
            target[i] = cap * size[i]
            left -= target[i]
            open_.remove(i)
    assert [got[str(i)] for i in range(4)] == pytest.approx([target[0], target[1], target[2], 0.0])


def test_mix(docs):
    sizes, plan = M.mix_plan(docs, (1, 2, 3))
    first = M.mix_report(sizes, plan).join(docs.select("doc_id", "source"), "doc_id")
    rows = first.collect()
    again = M.mix_report(*M.mix_plan(docs.repartition(5), (1, 2, 3))).select("doc_id", "taken")
    assert dict(again.collect()) == {r.doc_id: r.taken for r in rows}
    by = collections.defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        by[r.source].append(r)
    for group in by.values():
        assert sum(r["size"] for r in group) == group[0].source_size
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r["size"] for r in group) / 2 + 1
    mixed = M.mix_documents(docs, plan)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(M.word_count())).first()[0] == sum(r.taken for r in rows)


def test_mix_odd_rows(odd, none):
    rows = M.mix_report(*M.mix_plan(odd, (1, 2, 3))).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert M.mix_report(*M.mix_plan(none, (1, 2, 3))).count() == 0
    clash = odd.withColumn("whole", F.lit(1)).withColumn("draw", F.lit("x")).withColumn("cut", F.lit(0))
    _, plan = M.mix_plan(clash, (1, 2, 3))
    assert M.mix_documents(clash, plan).columns == clash.columns


# 3 sharding

def test_shards(docs):
    rows = S.shard_documents(docs.select("doc_id", "text", S.row_size().alias("size")), 8).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert len(rows) == docs.count() and sorted(by) == list(range(8))
    ideal = sum(r["size"] for r in rows) / 8
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
        assert abs(sum(r["size"] for r in group) - ideal) <= max(r["size"] for r in rows) + 0.01 * ideal


def test_shards_split_a_hot_text_and_slot_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_SLOT_RANGE", 20)
    hot = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "same text").otherwise(
        F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = S.shard_documents(hot, 4).collect()
    bytes_of = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        bytes_of[r.shard] += len(r.text) + 8
        slots[r.shard].append(r.slot)
    assert max(bytes_of.values()) < 1.02 * min(bytes_of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_odd_rows(odd, none):
    rows = S.shard_documents(odd.withColumn("slot", F.lit("x")), 3).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert S.shard_documents(none, 3).count() == 0


# 4 url filters

def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x", "http://www.example.com/en/1", "https://x.net/es/1?q", "http://x.net/de/#f", "no url",
            None, "http://foo.com", "http://badexample.com/en/", "http://x.org/" + "a" * 5000, "http://net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([(f"h{i}.org", "/spam/" if i % 2 else "/news/", float(i % 2)) for i in range(60)],
                                     "host string, path string, block double")
    got = {r.page_id: r for r in U.judge_urls(pages, catalog.URL_RULES, labelled).collect()}
    assert [got[i].rule for i in range(10)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None,
                                                "com/", None, "net/fr/"]
    assert [got[i].verdict for i in (0, 1, 2, 7, 9)] == ["block", "allow", "block", "allow", "block"]
    assert (got[0].host, got[0].path, got[5].host, got[5].path) == ("a.example.com", "/en/x", "", "")
    assert got[0].score is None and 0 < got[3].score < 1


def test_url_model_held_out_accuracy(spark):
    rows = [(f"site{i}.org", ("/casino/win" if i % 3 == 0 else "/science/paper") + str(i), float(i % 3 == 0)) for i in range(400)]
    train, test = rows[:300], rows[300:]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(test)], "page_id long, url string")
    labelled = spark.createDataFrame(train, "host string, path string, block double")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, catalog.URL_RULES, labelled).collect()}
    assert np.mean([(got[i] == "block") == bool(b) for i, (_, _, b) in enumerate(test)]) > 0.95
    for few, verdict in ((labelled.where("block = 1"), "block"), (labelled.where("block > 1"), "allow")):
        assert {r.verdict for r in U.judge_urls(pages, catalog.URL_RULES, few).collect()} == {verdict}


def test_url_model_on_given_pages(spark):
    """AUC on hosts not trained on, and a verdict of its own for pages without a rule."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from tests.conftest import SF_CHECK
    from turnstile.llm import url_labels

    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    listed = spark.createDataFrame(url_labels.labelled_urls(), "host string, path string, block double")
    labelled = U.labelled_by_rules(pages, catalog.URL_RULES).unionByName(listed)
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    model, _ = U.train(labelled.where(~held))
    scored = model.transform(U.featurize(labelled.where(held)))
    assert scored.count() > 200
    assert BinaryClassificationEvaluator(rawPredictionCol="_raw", labelCol="block").evaluate(scored) > 0.9
    free = catalog.QUERIES["op4_url_filter"](spark, SF_CHECK).where("rule is null")
    assert {r.verdict for r in free.select("verdict").distinct().collect()} == {"allow", "block"}


def test_url_odd_tables(spark):
    labelled = spark.createDataFrame([("a.org", "/x", 1.0), ("b.org", "/y", 0.0)] * 3, "host string, path string, block double")
    rows = [(1, "http://q.org/x", "h", "r", 1.0), (1, "http://q.org/x", "h", "r", 1.0), (None, "http://q.org/x", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, _p double")
    got = U.judge_urls(pages, catalog.URL_RULES, labelled)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    assert len(got.collect()) == 3 and got.select("host", "path", "verdict", "score").distinct().count() == 1
    empty = pages.where("false")
    assert U.judge_urls(empty, catalog.URL_RULES, labelled).count() == 0
    assert U.judge_urls(empty, catalog.URL_RULES, U.labelled_by_rules(empty, catalog.URL_RULES)).count() == 0


# 5 language

def identify(rows, model):
    return L.identify(rows, model, F.col("text"), F.col("source"), F.col("lang"))


def test_language_held_out_accuracy(docs):
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 60")
    model = L.train_text(train)
    found = L.identify(test, model, F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")).collect()
    assert np.mean([r.language == r.lang for r in found]) > 0.95
    by_name = L.identify(docs, L.train_text(docs), "text", F.col("source"), F.col("lang"))
    assert all(r.accepted for r in by_name.collect())
    assert sorted(by_name.collect()) == sorted(identify(docs, L.train_text(docs)).collect())


def test_language_evidence_decides_short_texts(spark):
    rows = [(i, "the and of with that", "en", "h1.example.org") for i in range(30)]
    rows += [(100 + i, "der und die mit das", "de", "h2.example.org") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = L.train_text(table)
    test = table.union(spark.createDataFrame([(200, "xqz", "de", "h2.example.org"), (201, "xqz", "en", "h1.example.org")], table.schema))
    got = {r.doc_id: r.language for r in L.identify(test, model, F.col("text"), F.col("host"), F.col("lang")).collect()}
    assert (got[200], got[201], got[0], got[100]) == ("de", "en", "en", "de")


def test_language_odd_rows(odd, none):
    model = L.train_text(odd)
    clash = odd.withColumn("language", F.lit("x")).withColumn("label", F.lit(1)).withColumn("_text", F.lit("y"))
    found = identify(clash, model).collect()
    assert len(found) == odd.count()
    assert not any(r.accepted for r in found if not re.search("[a-zé-ü]", r.text or "", re.I))
    assert identify(none, model).count() == 0
    unknown = identify(odd, L.train_text(none)).collect()
    assert len(unknown) == odd.count() and not any(r.accepted for r in unknown)


def test_markup_and_visible_text(spark):
    pages = spark.createDataFrame([("<html lang='en-GB'><style>p{}</style><p>Hi<!-- x --> there</p><script>var t='</p>'</script>",),
                                   ("no markup",), (None,)], "html string")
    got = pages.select(L.markup_language("html"), L.visible_text("html")).collect()
    assert [g[0] for g in got] == ["en", None, None]
    assert [g[1].split() for g in got] == [["Hi", "there"], ["no", "markup"], []]


# 6 quality

def test_quality_odd_rows(odd, none):
    got = {r.doc_id: r for r in Q.quality_rules(odd).collect()}
    assert Q.quality_rules(none).count() == 0 and Q.quality_rules(odd).count() == odd.count()
    assert (got[1].n_words, got[1].kept, got[9].n_dup_lines, got[8].word_chars) == (0, False, 1, 3)
    assert got[6].n_repeat_words == got[6].n_words == 90_000 and got[6].base_failed


# 7 Jaccard join

def test_jaccard_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == brute_components(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("blocks", [512, 7])
def test_jaccard_hot_group(spark, monkeypatch, blocks):
    """Chains of edits, a passage shared by all, and several blocks in a cell."""
    monkeypatch.setattr(J, "BLOCK_ROWS", blocks)
    r = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(3):
        text = passage + [f"g{g}w{i}" for i in range(15 * g)]
        for k in range(25):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[int(r.integers(len(text)))] = f"e{g}x{k}"
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(table).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(odd, none):
    rows = J.jaccard_components(odd).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == odd.count()
    assert (got[1], got[2], got[3], got[4], got[5], got[6], got[7]) == (1, 2, 3, 4, 4, 6, 7)     # 6 and 7 share three of four shingles
    assert J.jaccard_components(none).count() == 0
    kept = J.keep_one(odd, J.jaccard_components(odd))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = dict(G.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 1 for i in range(2, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert G.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8 secrets

def test_secret_scan(spark):
    rows = [(i, f"the key AKIA{i:016d} is here and password=a1b2c3d4e5f6{i:04d} there", "src/a") for i in range(40)]
    rows += [(100 + i, "plain " + chr(97 + i % 26) * 3 + "extraordinarilylongword" + " more", "src/b") for i in range(40)]
    rows += [(200, None, None), (201, "", "x"), (202, "password=changeme123", "docs/example")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = X.scan_secrets(table).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(text[r.doc_id][r.start:r.end] == r.value for r in found)
    secret = collections.Counter((r.doc_id < 100, r.is_secret) for r in found if r.doc_id < 200)
    assert secret[(True, True)] == 80 and secret[(False, False)] == 40 and not secret[(True, False)] and not secret[(False, True)]
    redacted = {r.doc_id: r.text for r in X.redact(table, X.scan_secrets(table)).collect()}
    assert "[secret] is here and password=[secret] there" in redacted[0] and redacted[200] is None


def test_secret_scan_odd_rows(odd, none):
    assert X.scan_secrets(none).count() == 0
    no_labels = odd.sparkSession.createDataFrame([], "value string, features array<double>, secret double")
    assert all(r.is_secret and r.score is None for r in X.scan_secrets(odd, labelled=no_labels).collect())
    assert not any(r.is_secret for r in X.scan_secrets(odd).collect())          # long words and runs of one word


def test_secret_scan_clashing_names(spark):
    table = spark.createDataFrame([("token = 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c", 3, "k")], "kind string, start long, value string")
    got = X.scan_secrets(table.select("kind", F.col("start").alias("key"), "value"), "key", "kind", "value").first()
    assert (got["key"], got["value"], got["is_secret"]) == (3, "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c", True)


def test_secret_forest_precision_and_recall_by_kind(spark, docs):
    """On labelled lines not trained on: verdicts don't follow the kind."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stats = X.statistics(docs)
    labelled = X.labelled_findings(spark, stats).cache()
    model = X.train(labelled.where("_line % 5 <> 0"))
    scored = model.transform(labelled.where("_line % 5 = 0").withColumn("vector", array_to_vector("features")))
    rows = scored.select("kind", "secret", (vector_to_array("chance")[1] >= 0.5).alias("y")).collect()
    for kind, least in (("value", 500), ("run", 500)):
        mine = [(r.secret == 1.0, r.y) for r in rows if r.kind == kind]
        hit, said, true = (sum(f(x) for x in mine) for f in (all, lambda x: x[1], lambda x: x[0]))
        assert len(mine) > least and 0 < said < len(mine)
        assert hit / said > 0.97 and hit / true > 0.97, kind


def test_secret_forest_held_out_accuracy(spark):
    r = np.random.default_rng(2)
    hexes = ["".join(r.choice(list("0123456789abcdef"), 24)) for _ in range(200)]
    plain = ["".join(r.choice(["ing", "tion", "the", "and", "er"], 7)) for _ in range(200)]
    rows = [(i, f"token={h} x" if i < 100 else f"see {h} x", "s") for i, h in enumerate(hexes)]
    rows += [(1000 + i, f"{p} word " + "the and ing tion er " * 3, "s") for i, p in enumerate(plain)]
    got = X.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    open_ = [g for g in got if 100 <= g.doc_id < 200]          # bare hex runs: no label by form
    assert len(open_) == 100 and np.mean([g.is_secret for g in open_]) > 0.9


# 9 token ids

def test_tokens(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    hard = ["", " ", "  a", "a  b ", "a \n b", "a\n\nb c", "don't  stop x　y", "<|endoftext|> a <|endoftext|>b", "tail ",
            " lead", "\x1ca \x1cb", "x" * 300 + " y", None]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    T.write_tokens(table.repartition(3), str(tmp_path / "store"), path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.read_digest(spark, str(tmp_path / "store")).collect()}
    whole = {r.doc_id: r.ids for r in T.read_tokens(spark, str(tmp_path / "store")).collect()}
    start = 0
    for d, text in sorted(table.collect()):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert whole[d] == ids
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_odd_rows(spark, odd, none, tmp_path):
    import public_tokenizers

    for name, table in (("odd", odd), ("none", none)):
        T.write_tokens(table, str(tmp_path / name), public_tokenizers.path("byte_bpe_50k.json"))
        rows = T.read_digest(spark, str(tmp_path / name)).collect()
        assert len(rows) == table.count()
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens


# 10 decontamination

def brute_hits(rows, items, n=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(SYMBOLS, low(t))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k:k + size])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, found = re.findall(SYMBOLS, low(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontaminate(spark, docs):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").union(
        spark.createDataFrame([(900, "Short item"), (901, None), (902, "..."), (903, "Short item")], "item_id long, text string"))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(
        [(5000, "a short, ITEM here"), (5001, None), (5002, "short"), (5003, "short item short item")], "doc_id long, text string"))
    want = brute_hits(table.collect(), items.collect())
    for size in (D.SEGMENT_WINDOWS, 100):
        segments = D.build_index(items, segment_windows=size)
        got = {r.doc_id: r for r in D.scan_documents(table, segments).collect()}
        assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in got.items()} == want
        kept = {r.doc_id for r in D.decontaminate(table, segments).collect()}
        assert kept == {d for d, x in want.items() if not x[1]}
        cut = {r.doc_id: r.text for r in D.decontaminate(table, segments, remove="spans").collect()}
        assert len(cut) == len(want) and cut[5000] == "a  here" and cut[5001] is None
        assert all(cut[d] == t for d, t in table.collect() if not want[d][1])
    assert got[5000]["items"] == ["900", "903"] and D.digest_of(["903", "900"]) == got_digest(D, spark, got[5000]["items"])


def got_digest(module, spark, items):
    return spark.createDataFrame([(items,)], "items array<string>").select(module.items_digest()).first()[0]


def test_decontaminate_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    segments = D.build_index(items)
    assert D.scan_documents(odd, segments).count() == odd.count()
    assert D.scan_documents(none, segments).count() == 0
    assert D.build_index(items.limit(0)) == []
    assert D.decontaminate(odd.withColumn("items", F.lit(1)), []).columns == [*odd.columns, "items"]
    with pytest.raises(ValueError):
        D.decontaminate(odd, segments, remove="lines")
