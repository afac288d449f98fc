"""Registered queries that write derived rows to the session's scratch folder and read them back (SRC, SNK), and queries of
the operators that the other catalogs don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokenize import MD5_TOKENIZER
from ..operators import boards, judge, leak, ranking, tokens
from ..session import materialize, scratch_path
from ..sources import readers, sinks, table_functions
from ..sources.tables import load_table
from .catalog import _JUDGE_RAW_SQL, _SAMPLE_TEXT_SQL, _SCORE_OF_VERDICT, leak_inputs, mixed_samples, raw_judge_responses, register
from .catalog_tables import _TURN, _ids_sql, _weighted, weighted_sum
from .sqlgen import sql_str


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------------------- JSON lines and Parquet

_ALL = "conv_id, turn, role, text"


@register("roundtrip_jsonl", f"""SELECT 'plain' AS kind, {_ALL}, true AS as_written FROM conversations
UNION ALL SELECT 'ascii', {_ALL}, true FROM conversations""")
def roundtrip_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK2, SRC1, SRC2, SRC5: JSON lines, plain and with escapes only, read through the catalog by name."""
    out, names = None, readers.DatasetCatalog()
    for kind in ("plain", "ascii"):
        path = f"{scratch_path(spark, 'turns')}.jsonl"
        sinks.write_jsonl(_turns(spark, sf_dir), path, num_shards=3, ascii_only=kind == "ascii", order_by=["conv_id", "turn"])
        names.register(kind, readers.DatasetEntry(path, lambda s, p: readers.read_any(s, p, _TURN)))
        # every line of the escaped file is ASCII; the plain one holds the characters themselves
        lines = spark.read.text(path).agg(F.max(F.octet_length("value") - F.length("value")).alias("more"))
        wide = lines.select((F.col("more") > 0).alias("wide"), F.lit(1).alias("one"))
        has = _turns(spark, sf_dir).agg(F.max(F.octet_length("text") > F.length("text")).alias("has"), F.lit(1).alias("one"))
        right = F.col("wide") == (F.col("has") if kind == "plain" else F.lit(False))
        rows = (names.load(spark, kind).withColumn("one", F.lit(1)).join(wide, "one").join(has, "one")
                .select(F.lit(kind).alias("kind"), "conv_id", "turn", "role", "text", right.alias("as_written")))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("roundtrip_parquet", f"""SELECT 'parquet' AS kind, {_ALL}, true AS in_order FROM conversations
UNION ALL SELECT 'records', {_ALL}, true FROM conversations""")
def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SRC4, SRC5, SNK5: an ordered set of Parquet shards, and the same rows converted to JSON records."""
    path, records = scratch_path(spark, "shards"), f"{scratch_path(spark, 'records')}.json"
    sinks.write_parquet(_turns(spark, sf_dir), path, num_shards=4, order_by=["conv_id", "turn"])
    stored = readers.read_any(spark, path)
    sinks.write_jsonl(stored, records)
    # shards are runs of the order: each begins behind the end of the one before
    ends = stored.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    before = ends.alias("x").join(ends.alias("y"), (F.col("x.f") < F.col("y.f")) & (F.col("x.b") > F.col("y.a")))
    bad = before.agg((F.count(F.lit(1)) == 0).alias("in_order"), F.lit(1).alias("one"))
    both = (stored.select(F.lit("parquet").alias("kind"), "conv_id", "turn", "role", "text")
            .unionByName(readers.read_any(spark, records, _TURN).select(F.lit("records").alias("kind"), "conv_id", "turn", "role", "text")))
    return both.withColumn("one", F.lit(1)).join(bad, "one").drop("one")


@register("roundtrip_files", """SELECT conv_id % 3 AS k, count(*) AS n_rows, CAST(sum(conv_id * 100 + turn) AS BIGINT) AS keys_sum, CAST(1 AS BIGINT) AS n_files
FROM conversations GROUP BY 1""")
def roundtrip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: every file of a folder with its name; each file holds one third of the conversations."""
    folder = scratch_path(spark, "by-file")
    keyed = _turns(spark, sf_dir).withColumn("k", F.pmod("conv_id", F.lit(3)))
    keyed.repartition(3, "k").write.partitionBy("k").json(folder)
    schema = T.StructType([*_TURN.fields])
    rows = readers.read_dir_by_file(spark, f"{folder}/*", schema, "*.json").withColumn("k", F.pmod("conv_id", F.lit(3)))
    per_file = rows.groupBy("k", "file_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("conv_id") * 100 + F.col("turn")).alias("s"))
    return per_file.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("s").alias("keys_sum"), F.count(F.lit(1)).alias("n_files"))


@register("roundtrip_documents", """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       count(DISTINCT text) AS n_texts FROM documents WHERE text IS NOT NULL""")
def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: one ``{"text": ...}`` object a document; lines of a text stay inside its object."""
    path = scratch_path(spark, "documents")
    sinks.write_jsonl(load_table(spark, sf_dir, "documents").where("text is not null").select("text"), path)
    back = readers.read_jsonl(spark, path, "text string")
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.countDistinct("text").alias("n_texts"))


# ---------------------------------------------------------------------------- summaries, errors, judge documents, lists

@register("roundtrip_summary_csv", """SELECT role, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY role""")
def roundtrip_summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: a summary table as one CSV file with a header."""
    path = f"{scratch_path(spark, 'summary')}.csv"
    sinks.write_summary_csv(_turns(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars")), path)
    return readers.read_any(spark, path).select("role", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_chars").cast("long").alias("n_chars"))


@register("roundtrip_errors", f"""WITH {_JUDGE_RAW_SQL}
SELECT id, CASE WHEN err THEN 'errors' ELSE 'results' END AS side FROM jr""")
def roundtrip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: results and error rows side by side, each row on one side."""
    path = scratch_path(spark, "judged")
    sinks.write_with_errors(judge.judge_rows(raw_judge_responses(spark, sf_dir), on_error="default", keep=("id", "model")).select("id", "verdict", "error"), path)
    sides = [spark.read.parquet(f"{path}/{side}").select("id", F.lit(side).alias("side")) for side in ("results", "errors")]
    return sides[0].unionByName(sides[1])


@register("roundtrip_judge_document", f"""WITH {_JUDGE_RAW_SQL}
SELECT id, verdict, CASE WHEN err THEN CAST(0 AS DOUBLE) ELSE CAST({_SCORE_OF_VERDICT} AS DOUBLE) END AS score FROM jr""")
def roundtrip_judge_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SRC8: the judge document as ordered lines, re-read with its examples; a missing document adds none."""
    rows = judge.judge_rows(raw_judge_responses(spark, sf_dir), on_error="default", keep=("id", "model"))
    path = scratch_path(spark, "judge-document")
    sinks.judge_envelope(rows.select("id", "verdict", F.col("result.score").alias("score")), "stub-judge", ["id"]).coalesce(1).write.text(path)
    examples = readers.read_judge_document(spark, path).select("id", "verdict", "score")
    missing = readers.read_judge_document(spark, f"{path}-missing")
    return examples.unionByName(examples.limit(0).join(missing, F.lit(False), "left_semi"))


_NAMES = ("labels", "benchmark", "conversations")


@register("dataset_names", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in _NAMES))
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC10, SRC11: a list of names, with blank lines, loaded through the registry."""
    registry = readers.catalog_from_mapping({n: f"{sf_dir.rstrip('/')}/{n}.parquet" for n in _NAMES})
    out = None
    for name in readers.dataset_list("\n".join(f"  {n} \n" for n in _NAMES)):
        one = registry.load(spark, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@register("question_range", """SELECT conv_id AS question_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY conv_id LIMIT 25 OFFSET 10""")
def question_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: questions [10, 35) by position."""
    ids = _turns(spark, sf_dir).select(F.col("conv_id").alias("question_id")).distinct()
    return readers.question_range(ids, 10, 35)


# ---------------------------------------------------------------------------- judge: simple clean-up, strict mode, statistics, backends

@register("judge_strict", f"""WITH {_JUDGE_RAW_SQL}
SELECT id, form IN (0, 1, 2, 5) AS has_result, coalesce(verdict, 'same') AS verdict FROM jr WHERE form IN (0, 1, 2, 5)""")
def judge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG3, JDG5: the simple clean-up and the strict extraction of responses that hold a result element."""
    raw = raw_judge_responses(spark, sf_dir).where(F.pmod("id", F.lit(6)).isin(0, 1, 2, 5))
    cleaned = raw.withColumn("xml", judge.clean_xml(F.col("raw_response"), robust=False))
    found = judge.with_verdict(cleaned, "xml", "found", mode="strict")
    return found.select("id", F.startswith("xml", F.lit("<result>")).alias("has_result"), judge.validate_verdict(F.col("found.verdict")).alias("verdict"))


@register("judge_run_stats", """SELECT 'model' || (conv_id % 4) AS model, count(*) AS total_examples, CAST(sum(length(text)) AS DOUBLE) / 8 AS processing_time,
       CAST(max(turn) AS DOUBLE) AS model_load_time, CAST(16 AS INTEGER) AS batch_size,
       CAST(count(*) AS DOUBLE) / (CAST(sum(length(text)) AS DOUBLE) / 8) AS examples_per_second
FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def judge_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG12: statistics of a run log (an answer takes an eighth of a second a character)."""
    log = _turns(spark, sf_dir).where("role = 'assistant'").select(
        F.concat(F.lit("model"), F.pmod("conv_id", F.lit(4))).alias("model"), F.lit(1).cast("long").alias("total_examples"),
        (F.length("text") / 8).alias("processing_time"), F.col("turn").cast("double").alias("model_load_time"), F.lit(16).alias("batch_size"))
    return judge.run_stats(log)


@register("model_formats", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'own' ELSE 'rule' END AS kind, "
          f"CASE turn % 3 WHEN 0 THEN {sql_str(judge.OWN_FAMILY_PROMPT)} END AS own_prompt FROM conversations WHERE turn % 3 IN (0, 1)")
def model_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG14: format and system prompt by the path of the model, the own family first."""
    rows = _turns(spark, sf_dir).where("turn % 3 in (0, 1)")
    first = judge.MODEL_RULES[0][0]
    path = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("org/own-family-"), F.lit(first))).otherwise(F.concat(F.lit("org/"), F.lit(first)))
    found = judge.model_format(path, "own-family")
    rule = found["format"].eqNullSafe(F.lit(judge.MODEL_RULES[0][1])) & found["system_prompt"].eqNullSafe(F.lit(judge.MODEL_RULES[0][2]))
    own = found["system_prompt"] == judge.OWN_FAMILY_PROMPT
    kind = F.when(F.coalesce(own, F.lit(False)) & found["format"].isNull(), "own").when(rule, "rule")
    return rows.select("conv_id", "turn", kind.alias("kind"), F.when(own, found["system_prompt"]).alias("own_prompt"))


@register("backend_answers", """SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN '' ELSE list_last(string_split(text, chr(10))) END AS response
FROM conversations WHERE role = 'user'""")
def backend_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG16: a backend answers prompts in batches (the stand-in repeats the last line)."""
    prompts = _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return judge.generate_with_backend(prompts, judge.EchoBackend, batch_size=7).select("conv_id", "turn", "response")


# ---------------------------------------------------------------------------- vocabulary files, leak records, leaderboards

@register("vocabulary_files", """WITH w AS (SELECT DISTINCT role || '_' || (turn % 5) AS word FROM conversations)
SELECT count(*) AS vocab_size, count(*) AS n_merges FROM w""")
def vocabulary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK13: entries of a vocabulary file and merges of a merges file (comments and blank lines don't count)."""
    words = _turns(spark, sf_dir).select(F.concat("role", F.lit("_"), (F.col("turn") % 5).cast("string")).alias("word")).distinct()
    vocab, merges = scratch_path(spark, "vocab"), scratch_path(spark, "merges")
    whole = words.agg(F.map_from_entries(F.collect_list(F.struct("word", F.length("word")))).alias("m"))       # a few words
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.text(vocab)
    lines = words.select(F.explode(F.array(F.concat("word", F.lit(" x")), F.lit(""), F.lit("#version"))).alias("value"))
    lines.write.text(merges)
    one = F.lit(1).alias("one")
    sizes = tokens.vocab_count(spark, vocab).where("vocab_size is not null").select("vocab_size", one)
    counted = tokens.merges_count(spark, merges)
    return (sizes.join(counted.select(F.col(counted.columns[0]).alias("n_merges"), one), "one")
            .select(F.col("vocab_size").cast("long").alias("vocab_size"), F.col("n_merges").cast("long").alias("n_merges")))


@register("leak_ids", f"""WITH a AS (SELECT conv_id, turn, text AS chosen FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, CAST({_weighted(_ids_sql('a.chosen'))} AS BIGINT) AS ids_sum
FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1""")
def leak_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEAK2-5: the chosen ids themselves, by a sum over ids and places."""
    recs = leak.leak_records(leak_inputs(spark, sf_dir), tokenizer=MD5_TOKENIZER)
    return recs.select("conv_id", "turn", weighted_sum(F.col("input_ids")).alias("ids_sum"))


@register("leak_probabilities", """WITH p AS (SELECT conv_id, turn, [1.0 / (1 + turn), 1.0 / (2 + conv_id)] AS bad, 1.0 / (1 + conv_id + turn) AS good
  FROM conversations WHERE role = 'assistant')
SELECT sum(list_sum(bad)) / sum(len(bad)) AS mean_bad_prob, avg(good) AS mean_good_prob FROM p""")
def leak_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEAK8: mean probabilities over a scored table."""
    scored = _turns(spark, sf_dir).where("role = 'assistant'").select(
        "conv_id", F.array(1.0 / (1 + F.col("turn")), 1.0 / (2 + F.col("conv_id"))).alias("bad_probs"),
        (1.0 / (1 + F.col("conv_id") + F.col("turn"))).alias("good_prob"))
    return leak.probability_means(scored, "conv_id")


_BOARD_SQL = """b AS (SELECT conv_id, ['8B', '13B', '30B', '70B'][conv_id % 4 + 1] AS class,
  ['org/Own-Family-', 'x/llama-3.1-', 'gpt-', 'a/b/qwen-', 'meti-geniac-405b-'][conv_id % 5 + 1] || conv_id AS model, count(*) AS ja_avg,
  CASE WHEN conv_id % 7 = 0 THEN 'MIT' WHEN conv_id % 7 = 1 THEN '' END AS license FROM conversations GROUP BY conv_id)"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table of made-up models, one a conversation; the score is its number of turns."""
    i = F.col("conv_id")
    classes, names = (F.array(*[F.lit(x) for x in xs]) for xs in (boards.CLASS_ORDER, ("org/Own-Family-", "x/llama-3.1-", "gpt-", "a/b/qwen-", "meti-geniac-405b-")))
    return (_turns(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("ja_avg"))
            .select("conv_id", F.get(classes, (i % 4).cast("int")).alias("class"), F.concat(F.get(names, (i % 5).cast("int")), i).alias("model"), "ja_avg",
                    F.when(i % 7 == 0, "MIT").when(i % 7 == 1, "").alias("license")))


@register("board_order", f"""WITH {_BOARD_SQL}
SELECT model, class, ja_avg, CAST(conv_id % 4 AS INTEGER) AS class_rank, contains(lower(model), 'own-family') AS highlight,
       row_number() OVER (ORDER BY conv_id % 4, ja_avg, model) AS place FROM b""")
def board_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LB1: the table in class order, then score, with the highlighted family."""
    from ..operators.index import with_row_index

    table = boards.order_by_class(_board(spark, sf_dir), "own-family").select("model", "class", "ja_avg", "class_rank", "highlight")
    return with_row_index(table, ["class_rank", "ja_avg", "model"], name="place").withColumn("place", F.col("place") + 1)


@register("board_deltas", f"""WITH {_BOARD_SQL}
SELECT t.model AS tuned, b.model AS base, CAST(t.ja_avg - b.ja_avg AS BIGINT) AS delta FROM b t JOIN b ON b.conv_id = t.conv_id - 1 WHERE t.conv_id % 2 = 1""")
def board_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LB2: every second model against the one before."""
    table = _board(spark, sf_dir)
    base = table.select((F.col("conv_id") + 1).alias("conv_id"), F.col("model").alias("base"), F.col("ja_avg").alias("base_ja"))
    pairs = table.where("conv_id % 2 = 1").select("conv_id", F.col("model").alias("tuned"), F.col("ja_avg").alias("tuned_ja")).join(base, "conv_id")
    return boards.tuned_vs_base(pairs).select("tuned", "base", "delta")


@register("board_labels", f"""WITH {_BOARD_SQL}
SELECT model, CASE WHEN coalesce(license, '') <> '' THEN license WHEN conv_id % 5 = 1 THEN 'Llama 3.1' WHEN conv_id % 5 = 2 THEN 'Proprietary' WHEN conv_id % 5 = 3 THEN 'Apache 2.0' END AS license,
       CASE conv_id % 5 WHEN 0 THEN 'Own-Family-' || conv_id WHEN 1 THEN 'llama-3.1-' || conv_id WHEN 3 THEN 'b/qwen-' || conv_id ELSE model END AS label,
       CASE conv_id % 5 WHEN 0 THEN 'deeppink' WHEN 2 THEN 'black' WHEN 4 THEN 'red' ELSE 'lightgrey' END AS color,
       CAST(CASE conv_id % 5 WHEN 0 THEN 60 WHEN 2 THEN 40 WHEN 4 THEN 60 ELSE 30 END AS INTEGER) AS size FROM b""")
def board_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LB3-5: licenses by rule, labels without the organisation, style classes."""
    style = boards.style_class(F.col("model"), "own-family")
    return _board(spark, sf_dir).select("model", boards.impute_license(F.col("license"), F.col("model")).alias("license"),
                                        boards.clean_label(F.col("model")).alias("label"), style["color"].alias("color"), style["size"].alias("size"))




# ---------------------------------------------------------------------------- ranking of models

def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up verdicts: two of six models are compared by the length of a turn and of the one before it."""
    t = _turns(spark, sf_dir)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").alias("other"))
    a, step = F.pmod("conv_id", F.lit(5)), F.col("turn") % 4 + 1
    return t.join(before, ["conv_id", "turn"]).select(
        F.concat(F.lit("m"), a).alias("a"), F.concat(F.lit("m"), (a + step) % 5).alias("b"),
        (F.floor(F.length("text") / 200) - F.floor(F.col("other") / 200)).alias("score"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))


_VERDICT_PAIRS = """v AS (SELECT 'm' || (c.conv_id % 5) AS x, 'm' || ((c.conv_id % 5 + c.turn % 4 + 1) % 5) AS y,
  length(c.text) // 200 - length(p.text) // 200 AS s FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, CASE WHEN x < y THEN s ELSE -s END AS s FROM v WHERE x <> y)"""


@register("model_pairs", f"""WITH {_VERDICT_PAIRS}
SELECT a, b, count(*) AS n, count_if(s > 0) AS wins_a, count_if(s < 0) AS wins_b, count_if(s = 0) AS ties FROM p GROUP BY a, b""")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG17: wins and ties of every pair of models."""
    return ranking.pair_counts(_verdicts(spark, sf_dir), "a", "b", "score").drop("sampled")


@register("model_ranking", f"""WITH {_VERDICT_PAIRS},
side AS (SELECT a AS model, s FROM p UNION ALL SELECT b, -s FROM p)
SELECT model, min(model) OVER () AS component, count(*) AS n, count_if(s > 0) AS wins, count_if(s = 0) AS ties, count_if(s < 0) AS losses,
       true AS balanced, true AS inside FROM side GROUP BY model""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG17: Bradley-Terry strengths.  ``balanced``: at the strengths every model wins as often as expected (with the prior);
    ``inside``: they lie in their intervals."""
    rows = materialize(ranking.rank_models(_verdicts(spark, sf_dir), "a", "b", "score", F.col("id")), "ranking")
    pairs = ranking.pair_counts(_verdicts(spark, sf_dir), "a", "b", "score").drop("sampled")
    one, two = (rows.select(F.col("model").alias(c), F.col("strength").alias(f"s{c}")) for c in ("a", "b"))
    games = F.col("n") + 2 * ranking.PRIOR
    chance = 1 / (1 + F.exp(F.col("sb") - F.col("sa")))
    met = pairs.join(one, "a").join(two, "b").withColumn("d", F.col("wins_a") + F.col("ties") / 2 + ranking.PRIOR - games * chance)
    off = (met.select(F.col("a").alias("model"), "d").unionByName(met.select(F.col("b").alias("model"), (-F.col("d")).alias("d")))
           .groupBy("model").agg((F.abs(F.sum("d")) < 1e-4).alias("balanced")))
    return rows.join(off, "model").select("model", "component", "n", "wins", "ties", "losses", "balanced",
                                          F.col("strength").between(F.col("low"), F.col("high")).alias("inside"))


@register("sample_text_function", _SAMPLE_TEXT_SQL)
def sample_text_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: the sample processor as a table function, called from SQL."""
    table_functions.register_processors(spark)
    mixed_samples(spark, sf_dir).createOrReplaceTempView("turnstile_mixed_samples")
    return spark.sql("SELECT kind, sample_id, sample_text AS text FROM process_samples(TABLE(turnstile_mixed_samples), 'conversation_text')")
