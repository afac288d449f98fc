"""Registered queries: each reads the driver tables at ``sf_dir`` and applies
one family of operators end to end; ``ORACLE`` holds the DuckDB SQL that must
produce the same rows (column names aliased identically).

Queries without an oracle are the packing heuristic (TOK5), whose contract
``sample_pack_summary`` checks, and the listing of files (TOK14).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import at
from ..functions.text import japanese_or_acceptable_class, sql_str
from ..functions.tokenize import COUNTERS, DEFAULT_TOKENIZER, TOKEN_PATTERN, WHITESPACE_TOKEN_PATTERN
from ..operators import judge, leak, metrics, mix, packing, prefs, quality, render, tokens, turns
from ..operators.index import with_row_index
from ..session import materialize
from ..sources.tables import SHAREGPT_ROLE_NAMES, conversations_nested, conversations_sharegpt, load_table, nest_turns
from . import recipes
from . import sqlgen as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver conversations normalised (PRJ1-3, FLT1) on the flat rows, then nested;
    conversations left empty never appear (FLT2)."""
    flat = turns.normalize_flat(load_table(spark, sf_dir, "conversations"))
    return nest_turns(flat)


# --------------------------------------------------------------------------- shared SQL

_ROLE_CASE = S.case_map("lower(role)", turns.invert_role_map(turns.DEFAULT_ROLE_MAP))
NL = S.NL
SQL_NORM = f"""norm AS (
  SELECT conv_id, turn, {_ROLE_CASE} AS role, text AS content
  FROM conversations WHERE text IS NOT NULL AND {_ROLE_CASE} IS NOT NULL
),
normi AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM norm
)"""
SQL_CHATML_STRICT = f"""cm AS (
  SELECT conv_id,
         coalesce(string_agg('<|im_start|>' || r || {NL} || c || '<|im_end|>', {NL} ORDER BY turn)
                  FILTER (WHERE length(r) > 0 AND length(c) > 0) || {NL}, '') AS text,
         count(*) AS n_turns
  FROM (SELECT conv_id, turn, {S.strip('role')} AS r, {S.strip('content')} AS c FROM norm) s
  GROUP BY conv_id
)"""


def _tok_count(expr: str) -> str:
    return S.regex_count(expr, TOKEN_PATTERN)


# =========================================================================== PRJ / FLT

@register("sft_chatml", f"WITH {SQL_NORM}, {SQL_CHATML_STRICT} SELECT conv_id, text, n_turns FROM cm")
def sft_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise roles -> drop invalid turns and empty conversations -> ChatML render
    (PRJ1-3, PRJ13, FLT1-2), rendered per turn on the flat table before one groupBy."""
    flat = turns.normalize_flat(load_table(spark, sf_dir, "conversations"))
    return render.chatml_strict_flat(flat)


@register("sharegpt_normalize", f"""WITH {SQL_NORM}, {SQL_CHATML_STRICT}
SELECT cm.conv_id, cm.text, r.roles FROM cm JOIN
  (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM norm GROUP BY conv_id) r USING (conv_id)""")
def sharegpt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1 key-presence rule on ``{from,value}`` turns + PRJ2 alias map (human/gpt)."""
    conv = turns.load_conversation(conversations_sharegpt(spark, sf_dir), fields=["conv_id", "conversations"])
    return conv.select("conv_id", render.chatml_strict(F.col("conversations")).alias("text"),
                       F.array_join(F.transform("conversations", lambda t: t["role"]), ",").alias("roles"))


_SG_NAME = S.case_map("role", {"user": "human", "assistant": "gpt", "system": "system"}, "role")
_SG_BACK = S.case_map(_SG_NAME, turns.SHAREGPT_TO_OPENAI, _SG_NAME)


@register("sharegpt_converters", f"""
SELECT conv_id,
  string_agg({_SG_BACK}, ',' ORDER BY turn) AS roles_openai,
  coalesce(string_agg(CASE WHEN {_SG_NAME} = 'human' THEN 'user' ELSE 'assistant' END, ',' ORDER BY turn)
           FILTER (WHERE {_SG_NAME} IN ('human', 'gpt')), '') AS roles_no_system,
  string_agg(CASE WHEN {_SG_NAME} = 'human' THEN 'user' ELSE 'assistant' END, ',' ORDER BY turn) AS roles_two,
  string_agg({_SG_NAME}, ',' ORDER BY turn) AS roles_verbatim
FROM conversations GROUP BY conv_id""")
def sharegpt_converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7 (pass-through map), PRJ8 (drop system), PRJ9 (two roles), PRJ10 (verbatim)."""
    sg = conversations_sharegpt(spark, sf_dir)
    c = F.col("conversations")

    def roles(x):
        return F.array_join(F.transform(x, lambda t: t["role"]), ",")

    return sg.select("conv_id", roles(turns.sharegpt_to_messages(c)).alias("roles_openai"),
                     roles(turns.sharegpt_to_messages_no_system(c)).alias("roles_no_system"),
                     roles(turns.sharegpt_two_roles(c)).alias("roles_two"),
                     roles(turns.sharegpt_verbatim(c)).alias("roles_verbatim"))


def _template_query(column_builder, doc: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        conv = normalized(spark, sf_dir)
        return conv.select("conv_id", column_builder(F.col("conversations")).alias("text"))
    q.__doc__ = doc
    return q


def _flat_template_query(piece, doc: str, suffix: str = ""):
    """Position-independent templates render per turn on the flat table (no lambdas)."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = turns.normalize_flat(load_table(spark, sf_dir, "conversations"))
        return render.render_flat(flat, piece, suffix=suffix)
    q.__doc__ = doc
    return q


def _template_sql(piece: str, tail: str = "", head: str = "") -> str:
    return f"""WITH {SQL_NORM}
SELECT conv_id, {head}string_agg({piece}, '' ORDER BY turn){tail} AS text FROM normi GROUP BY conv_id"""


register("render_chatml_generation", _template_sql(
    f"'<|im_start|>' || role || {NL} || content || '<|im_end|>' || {NL}", tail=f" || '<|im_start|>assistant' || {NL}"))(
    _flat_template_query(lambda t: render.chatml_piece(t["role"], t["content"]),
                         "PRJ14: ChatML default template with generation prompt.",
                         suffix=render.IM_START + "assistant\n"))

register("render_llama2", _template_sql(
    f"""CASE WHEN role = 'user' AND idx > 1 THEN '<s>[INST] ' || content || ' [/INST]'
         WHEN role = 'user' THEN content || ' [/INST]'
         WHEN role = 'system' THEN '[INST] <<SYS>>' || {NL} || content || {NL} || '<</SYS>>' || {NL} || {NL}
         WHEN role = 'assistant' THEN ' ' || content || ' </s>' END"""))(_template_query(render.llama2, "PRJ15: Llama-2 [INST]/<<SYS>> template."))

register("render_instruction_ja", _template_sql(
    f"""CASE WHEN role = 'system' THEN content || {NL} || {NL}
         WHEN role = 'user' THEN '### 指示:' || {NL} || content || {NL} || {NL}
         WHEN role = 'assistant' THEN '### 応答:' || {NL} || content || {NL} || {NL} END""",
    tail=" || '### 応答:'"))(_flat_template_query(render.instruction_ja_piece,
                         "PRJ16: ### 指示 / ### 応答 template (swallow generation prompt).",
                         suffix=render.instruction_ja_prompt("swallow")))

register("render_role_upper", _template_sql(f"upper(role) || ': ' || content || {NL}"))(
    _flat_template_query(render.role_upper_piece, "PRJ17: upper-cased ROLE: content template."))

register("render_vicuna", _template_sql(
    f"""CASE WHEN role = 'system' THEN content || ' '
         WHEN role = 'user' THEN 'USER:' || {NL} || content || ' '
         WHEN role = 'assistant' THEN ' ASISTANT:' || {NL} || content || ' ' END"""))(
    _flat_template_query(render.vicuna_piece(parity_misspelling=True),
                         "PRJ18: USER/ASISTANT template (parity spelling)."))

register("render_header", _template_sql(
    f"""CASE WHEN idx = 0 THEN '<|begin_of_text|>' ELSE '' END || '<|start_header_id|>' || role
         || '<|end_header_id|>' || {NL} || {NL} || {S.strip('content')} || '<|eot_id|>'"""))(
    _template_query(render.header_template, "PRJ21: header-marker template with stripped content and BOS."))

register("render_one_line", f"WITH {SQL_NORM}, {SQL_CHATML_STRICT} SELECT conv_id, replace(text, {NL}, ' ') AS text FROM cm")(
    _template_query(lambda c: render.one_line(render.chatml_strict(c)), "PRJ22: rendered text flattened to one line."))


@register("render_inst_checked", f"""WITH {SQL_NORM},
o AS (SELECT conv_id, max(CASE WHEN idx = 0 AND role = 'system' THEN 1 ELSE 0 END) AS off FROM normi GROUP BY conv_id),
g AS (
  SELECT n.conv_id,
    bool_and((role = 'user') = (idx % 2 = 0)) AS alt0,
    bool_and(role IN ('user', 'assistant')) AS ua,
    bool_and((role = 'user') = (idx % 2 = o.off)) AS alt_sys,
    '<s>' || string_agg(CASE WHEN role = 'user' THEN '[INST] ' || content || ' [/INST]' ELSE content || '</s>' END, '' ORDER BY turn) AS t19,
    '<s>' || string_agg(CASE WHEN role = 'user' THEN ' [INST] ' || content || ' [/INST] '
                         WHEN role = 'assistant' THEN content || '</s>' ELSE content END, '' ORDER BY turn) AS t20
  FROM normi n JOIN o USING (conv_id) GROUP BY n.conv_id
)
SELECT conv_id,
  CASE WHEN alt0 AND ua THEN t19 END AS strict_text,
  CASE WHEN NOT alt0 THEN 'Conversation roles must alternate user/assistant/user/assistant/...'
       WHEN NOT ua THEN 'Only user and assistant roles are supported!' END AS strict_error,
  CASE WHEN alt_sys THEN t20 END AS system_text,
  alt0 AS alternating, alt_sys AS alternating_with_system
FROM g""")
def render_inst_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ19/PRJ20 with FLT6: strict ``[INST]`` templates and their alternation checks."""
    conv = normalized(spark, sf_dir)
    c = F.col("conversations")
    s19, s20 = render.inst_strict(c), render.inst_with_system(c)
    return conv.select("conv_id", s19["text"].alias("strict_text"), s19["error"].alias("strict_error"),
                       s20["text"].alias("system_text"), turns.is_alternating(c, 0).alias("alternating"),
                       turns.is_alternating(c, turns.system_offset(c)).alias("alternating_with_system"))


_SAMPLE_TEXT_SQL = f"""
SELECT 'document' AS kind, doc_id AS sample_id, CASE WHEN length(text) > 0 THEN text END AS text FROM documents
UNION ALL
SELECT 'conversation' AS kind, conv_id AS sample_id,
       string_agg(coalesce(nullif(role, ''), 'unknown') || ': ' || coalesce(nullif(text, ''), ''), {NL} ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""


def mixed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of documents and chats: ``kind, sample_id, text, conversations``."""
    docs = load_table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("sample_id"), "text",
        F.lit(None).cast("array<struct<role:string,content:string>>").alias("conversations"))
    convs = conversations_nested(spark, sf_dir).select(
        F.lit("conversation").alias("kind"), F.col("conv_id").alias("sample_id"),
        F.lit(None).cast("string").alias("text"), "conversations")
    return docs.unionByName(convs)


@register("sample_text", _SAMPLE_TEXT_SQL)
def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11: text-or-conversation extractor over a corpus mixing documents and chats."""
    both = mixed_samples(spark, sf_dir)
    return both.select("kind", "sample_id", turns.sample_text(both, on_missing="null").alias("text"))


@register("plain_concat", f"""
SELECT conv_id, string_agg(coalesce(role, 'None') || ': ' || coalesce(text, 'None') || {NL}, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def plain_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: ``role: content`` plain concatenation fallback with key fallback."""
    conv = conversations_nested(spark, sf_dir)
    return conv.select("conv_id", turns.plain_concat(conv).alias("text"))


@register("train_flags", f"""WITH {SQL_NORM}
SELECT conv_id, idx AS turn_index, role, role = 'assistant' AS train FROM normi""")
def train_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ23: per-turn training flag (assistant turns trained, prompts masked)."""
    conv = normalized(spark, sf_dir)
    return (conv.select("conv_id", F.posexplode(turns.with_train_flags(F.col("conversations"))).alias("turn_index", "t"))
            .select("conv_id", F.col("turn_index").cast("long").alias("turn_index"), "t.role", "t.train"))


@register("clean_rebuild", f"""WITH {SQL_NORM}
SELECT conv_id, count(*) AS n_turns, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM norm GROUP BY conv_id""")
def clean_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4-6 + FLT3: keep requested fields, rebuild turns as role+content only, drop empty."""
    raw = conversations_nested(spark, sf_dir)
    conv = turns.load_conversation(raw, fields=["conv_id", "conversations", "not_a_column"])
    rebuilt = turns.rebuild_clean_schema(conv, "conversations", keep=["conv_id"])
    return rebuilt.select(
        "conv_id", F.size("conversations").cast("long").alias("n_turns"),
        F.aggregate(F.transform("conversations", lambda t: F.length(t["content"]).cast("long")),
                    F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"))


# =========================================================================== quality

_SCAN_SQL = f"""
msg AS (SELECT conv_id, count(*) AS num_turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id),
allrows AS (
  SELECT 'messages' AS dataset, conv_id AS k, num_turns, last_role,
         num_turns > 0 AND coalesce(last_role IN ('assistant'), false) = false AS bad FROM msg
  UNION ALL
  SELECT 'sharegpt' AS dataset, conv_id AS k, num_turns, NULL AS last_role, num_turns > 0 AS bad FROM msg
  UNION ALL
  SELECT 'documents' AS dataset, doc_id AS k, 0 AS num_turns, NULL AS last_role, false AS bad FROM documents
)"""


def _scan_inputs(spark: SparkSession, sf_dir: str):
    """The chat table in two layouts, scanned flat (no text, no nesting), and a table without messages."""
    flat = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    datasets = {
        "messages": quality.flat_scan(flat),
        # the {from, value} layout has no role field: its last turns name no role
        "sharegpt": quality.flat_scan(flat.withColumn("role", F.lit(None).cast("string"))),
        "documents": load_table(spark, sf_dir, "documents").select("doc_id"),
    }
    order = {"messages": ["conv_id"], "sharegpt": ["conv_id"], "documents": ["doc_id"]}
    return datasets, order


@register("trainability_summary", f"""WITH {_SCAN_SQL}
SELECT dataset, count(*) AS total_rows, CAST(count_if(bad) AS BIGINT) AS bad_rows,
       CASE WHEN count(*) > 0 THEN round_even(CAST(100 AS DOUBLE) * count_if(bad) / count(*), 3) ELSE 0.0 END AS percent_bad
FROM allrows GROUP BY dataset""")
def trainability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4-5 + AGG5: per-dataset totals of examples whose last turn is not trainable."""
    return quality.scan_summary(*_scan_inputs(spark, sf_dir))


@register("trainability_problems", f"""WITH {_SCAN_SQL}
SELECT dataset, row_id, last_role, num_turns FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY k) - 1 AS row_id FROM allrows) WHERE bad""")
def trainability_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6: problem rows with their 0-based row id (distributed row index)."""
    return quality.scan_problems(*_scan_inputs(spark, sf_dir))


@register("last_turn_scan", """
SELECT conv_id, count(*) AS num_turns, arg_max(role, turn) AS last_role,
       count(*) > 0 AND coalesce(arg_max(role, turn) IN ('assistant'), false) = false AS not_trainable
FROM conversations GROUP BY conv_id""")
def last_turn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4 on the flat table with partial aggregates only (skew-safe form)."""
    return quality.flat_scan(load_table(spark, sf_dir, "conversations"))


@register("source_counts", """
SELECT source, count(*) AS n_samples, (count(*) * 3) // 512 AS est_steps FROM documents GROUP BY ROLLUP (source)""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7: samples per source plus the total row and estimated steps."""
    return quality.source_counts(load_table(spark, sf_dir, "documents"))


@register("stage_counts", f"""WITH {SQL_NORM}
SELECT 'loaded' AS stage, count(DISTINCT conv_id) AS n_rows FROM conversations
UNION ALL SELECT 'normalized', count(DISTINCT conv_id) FROM norm
UNION ALL SELECT 'rebuilt', count(DISTINCT conv_id) FROM norm""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: rows of every build stage, observed while the build runs once."""
    loaded, n_loaded = quality.observed(conversations_nested(spark, sf_dir), "loaded")
    normal, n_normal = quality.observed(turns.load_conversation(loaded, "conversations", turns.DEFAULT_ROLE_MAP, fields=["conv_id", "conversations"]), "normalized")
    rebuilt, n_rebuilt = quality.observed(turns.rebuild_clean_schema(normal, "conversations", keep=["conv_id"]), "rebuilt")
    materialize(rebuilt, "rebuilt")
    counts = [(stage, seen.get["rows"]) for stage, seen in (("loaded", n_loaded), ("normalized", n_normal), ("rebuilt", n_rebuilt))]
    return spark.createDataFrame(counts, "stage string, n_rows long")


# =========================================================================== MIX

_RECIPE = recipes.document_recipe()
_RECIPE_VALUES = ", ".join(f"({sql_str(s.name)}, {s.percent})" for s in _RECIPE.sources if s.percent is not None)


@register("slice_mix", f"""WITH r(source, pct) AS (VALUES {_RECIPE_VALUES}),
d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
             count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT d.source, d.doc_id FROM d JOIN r USING (source)
WHERE d.rn <= round_even(CAST(r.pct AS DOUBLE) * d.n / CAST(100 AS DOUBLE), 0)""")
def slice_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX1-3, MIX7-8: per-source percent slices from a recipe, concatenated (a malformed
    split contributes no rows), isolation per source."""
    mixed, _status = recipes.build_document_mix(spark, sf_dir, _RECIPE)
    return mixed.select("source", "doc_id")


_RECIPE_STATUS = ", ".join(f"({sql_str(x.name)}, {'NULL' if x.percent is None else x.percent})" for x in _RECIPE.sources)


@register("recipe_status", f"""WITH r(source, pct) AS (VALUES {_RECIPE_STATUS}),
d AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT coalesce(r.source, d.source) AS source,
       CASE WHEN r.source IS NULL THEN 'not in the recipe' WHEN r.pct IS NULL THEN 'error' ELSE 'ok' END AS status,
       CAST(coalesce(round_even(CAST(r.pct AS DOUBLE) * d.n / CAST(100 AS DOUBLE), 0), 0) AS BIGINT) AS n_rows
FROM r FULL JOIN d ON r.source IS NOT DISTINCT FROM d.source""")
def recipe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX2, MIX7-8, FLT2: outcome and rows of every source of the recipe and of the table."""
    mixed, status = recipes.build_document_mix(spark, sf_dir, _RECIPE)
    taken = mixed.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return (status.join(taken, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", "status", F.coalesce("n", F.lit(0)).alias("n_rows")))


_CATALOG = {name: recipes.catalog_recipe(name, [f"src{i}" for i in range(len(splits))], ("doc_id",))
            for name, splits in recipes.CATALOG_SPLITS.items()}
_CATALOG_VALUES = ", ".join(f"({sql_str(name)}, {sql_str(x.name)}, {x.percent})" for name, r in _CATALOG.items() for x in r.sources)


@register("recipe_catalog", f"""WITH r(recipe, source, pct) AS (VALUES {_CATALOG_VALUES}),
d AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT recipe, source, CAST(round_even(CAST(pct AS DOUBLE) * n / CAST(100 AS DOUBLE), 0) AS BIGINT) AS n_rows
FROM r JOIN d USING (source)
WHERE round_even(CAST(pct AS DOUBLE) * n / CAST(100 AS DOUBLE), 0) > 0""")
def recipe_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX7: rows that each known mix takes from its sources (the ``documents`` sources in order)."""
    parts = []
    for name, recipe in _CATALOG.items():
        mixed, _ = recipes.build_document_mix(spark, sf_dir, recipe)
        parts.append(mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("recipe"), "source", "n_rows"))
    return mix.concat_sources(parts)


def _key_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({sql_str(f'{seed}:')} || {key}), 1, 15))::BIGINT"


@register("shuffled_mix", f"""WITH r(source, pct) AS (VALUES {_RECIPE_VALUES}),
d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
             count(*) OVER (PARTITION BY source) AS n FROM documents),
m AS (SELECT d.source, d.doc_id FROM d JOIN r USING (source)
      WHERE d.rn <= round_even(CAST(r.pct AS DOUBLE) * d.n / CAST(100 AS DOUBLE), 0))
SELECT source, doc_id, row_number() OVER (ORDER BY {_key_sql('doc_id')}, doc_id) - 1 AS position FROM m""")
def shuffled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX5-6: seeded, partition-independent permutation of the mix with output positions."""
    mixed, _ = recipes.build_document_mix(spark, sf_dir, _RECIPE)
    keyed = mixed.select("source", "doc_id").withColumn("_h", mix.shuffle_key(["doc_id"], 42))
    return with_row_index(keyed, ["_h", "doc_id"], name="position").drop("_h")


@register("holdout_split", f"""SELECT doc_id, source, {_key_sql('doc_id')} % 1000000 < 20000 AS is_holdout FROM documents""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX12: 2 % hash-threshold hold-out on the document key."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.withColumn("is_holdout", mix.holdout_flag(["doc_id"], 0.02))


@register("contiguous_split", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
b AS (SELECT DISTINCT n, CAST(round_even(CAST(995 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(n AS DOUBLE), 0) AS BIGINT) AS b1,
             CAST(round_even(CAST(5 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(n AS DOUBLE), 0) AS BIGINT) AS w2 FROM d)
SELECT doc_id, CASE WHEN i < b1 THEN 'train' WHEN i < b1 + w2 THEN 'valid' ELSE 'test' END AS split FROM d JOIN b USING (n)""")
def contiguous_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX13: contiguous 995/5/0 split by row position."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id")
    return mix.contiguous_split(docs, [995, 5, 0], ["doc_id"])


_WORLD = 4
_SHARD_SQL = f"""CASE WHEN i < (n // {_WORLD} + 1) * (n % {_WORLD}) THEN i // (n // {_WORLD} + 1)
     ELSE n % {_WORLD} + (i - (n // {_WORLD} + 1) * (n % {_WORLD})) // greatest(n // {_WORLD}, 1) END"""


@register("rank_shards", f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST({_SHARD_SQL} AS INTEGER) AS shard FROM d""")
def rank_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX16: contiguous shard per data-parallel rank (4 ranks)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id")
    return mix.shard_contiguous(docs, _WORLD, ["doc_id"])


@register("epoch_repeat", "SELECT e.range AS epoch, d.doc_id FROM documents d, range(3) e")
def epoch_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX14: three epochs, each with its own seeded order."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id")
    return mix.repeat_epochs(docs, 3, ["doc_id"]).select(F.col("epoch").cast("long").alias("epoch"), "doc_id")


@register("last_wins", """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
FROM conversations GROUP BY conv_id""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX17: last row per integer key, sorted by key (turn rows as appended answers)."""
    return mix.last_wins(load_table(spark, sf_dir, "conversations"), "conv_id", "turn")


@register("cap_per_source", """SELECT source, doc_id FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10""")
def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX19: at most 10 samples per evaluation dataset, all datasets."""
    docs = load_table(spark, sf_dir, "documents").select("source", "doc_id")
    return mix.cap_per_group(docs, 10, ["source"], ["doc_id"])


def _layout_reader(sf_dir: str):
    """Reader for the derived chat layouts of the driver ``conversations`` table."""
    def read(spark: SparkSession, name: str) -> DataFrame:
        raw = conversations_nested(spark, sf_dir)
        if name == "messages":
            return raw.select("conv_id", F.col("conversations").alias("messages"),
                              F.col("conversations").alias("original_messages"))
        if name == "sharegpt":
            return conversations_sharegpt(spark, sf_dir)
        raise turns.SourceError(f"unknown layout {name!r}")
    return read


# Fixed recipe for the conversation mix: the same source through two message
# columns (MIX4) plus a ShareGPT-layout source, with load-time slices.
SFT_RECIPE = recipes.Recipe([
    recipes.SourceSpec("chat-messages", "train[:50%]", "messages", path="messages"),
    recipes.SourceSpec("chat-original", "train", "original_messages", path="messages"),
    recipes.SourceSpec("chat-sharegpt", "train[:25%]", "conversations", path="sharegpt"),
    recipes.SourceSpec("chat-missing-column", "train", "dialogue", path="messages"),
], order_cols=("conv_id",), strict=False)


@register("sft_mix", f"""WITH {SQL_NORM}, {SQL_CHATML_STRICT},
ri AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rn, count(*) OVER () AS n
       FROM (SELECT DISTINCT conv_id FROM conversations)),
sel AS (
  SELECT 'chat-messages' AS source, conv_id FROM ri WHERE rn <= round_even(CAST(50 AS DOUBLE) * n / CAST(100 AS DOUBLE), 0)
  UNION ALL SELECT 'chat-original', conv_id FROM ri
  UNION ALL SELECT 'chat-sharegpt', conv_id FROM ri WHERE rn <= round_even(CAST(25 AS DOUBLE) * n / CAST(100 AS DOUBLE), 0))
SELECT sel.source, sel.conv_id, cm.text, cm.n_turns FROM sel JOIN cm USING (conv_id)""")
def sft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline A: MIX1/3/4/6/7/8 + PRJ1-6 + FLT1-3/7: recipe sources sliced at load,
    normalised, rebuilt, unioned and put in seeded order; the source without its
    message column is isolated (status row, no data)."""
    mixed, _status = recipes.build_conversation_mix(spark, SFT_RECIPE, _layout_reader(sf_dir))
    return mixed.select("source", "conv_id", render.chatml_strict(F.col("conversations")).alias("text"),
                        F.size("conversations").cast("long").alias("n_turns"))


# =========================================================================== PRF

_PAIRS_SQL = f"""{SQL_NORM},
lastt AS (SELECT conv_id, max(turn) AS lt FROM norm GROUP BY conv_id),
q AS (SELECT n.conv_id FROM norm n JOIN lastt l ON n.conv_id = l.conv_id AND n.turn = l.lt WHERE n.role = 'assistant'),
qi AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS k FROM q),
fa AS (SELECT conv_id, arg_min(content, turn) AS fa FROM norm WHERE role = 'assistant' GROUP BY conv_id),
pr AS (SELECT n.conv_id,
              string_agg('<|im_start|>' || n.role || {NL} || n.content || '<|im_end|>' || {NL}, '' ORDER BY n.turn) AS p,
              arg_min(n.content, n.turn) FILTER (WHERE n.role = 'user') AS first_user
       FROM norm n JOIN lastt l ON n.conv_id = l.conv_id WHERE n.turn < l.lt GROUP BY n.conv_id),
ch AS (SELECT n.conv_id, n.content AS c FROM norm n JOIN lastt l ON n.conv_id = l.conv_id AND n.turn = l.lt),
pairs AS (
  SELECT a.conv_id, coalesce(pr.p, '') AS prompt, ch.c AS chosen, fa.fa AS rejected,
         coalesce(pr.first_user, '') AS inst
  FROM qi a JOIN qi b ON b.k = a.k + 1 JOIN fa ON fa.conv_id = b.conv_id
  JOIN ch ON ch.conv_id = a.conv_id LEFT JOIN pr ON pr.conv_id = a.conv_id
)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefs.pairs_from_conversations(normalized(spark, sf_dir))


@register("dpo_pairs", f"""WITH {_PAIRS_SQL}
SELECT conv_id, prompt, chosen, rejected,
       prompt || {NL} || '### CHOSEN:' || {NL} || chosen || {NL} || '### REJECTED:' || {NL} || rejected AS text
FROM pairs""")
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRF2 append layout -> PRF5 prompt split -> PRF6 single text (pairs derived from chats)."""
    full = prefs.append_pairs(_pairs(spark, sf_dir))
    split = prefs.prompt_split(F.col("chosen"), F.col("rejected"))
    return full.select("conv_id", split["prompt"].alias("prompt"), split["chosen"].alias("chosen"),
                       split["rejected"].alias("rejected"),
                       prefs.single_text(split["prompt"], split["chosen"], split["rejected"]).alias("text"))


@register("dpo_mix", f"""WITH {_PAIRS_SQL},
n AS (SELECT count(*) AS n FROM pairs),
pi AS (SELECT pairs.*, row_number() OVER (ORDER BY conv_id) AS rn, n.n FROM pairs, n)
SELECT 'full' AS source, conv_id AS id, chosen AS chosen_last, rejected AS rejected_last FROM pi
UNION ALL
SELECT 'message', conv_id, chosen, rejected FROM pi WHERE rn <= round_even(CAST(20 AS DOUBLE) * n / CAST(100 AS DOUBLE), 0)""")
def dpo_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline D: PRF1 full layout + PRF3 message layout on a 20 % slice, PRF4 mix,
    PRF7 column contract, MIX9 empty check, seeded order."""
    pairs = _pairs(spark, sf_dir)
    full = (prefs.full_pairs(prefs.append_pairs(pairs, layout="append"), keep=("conv_id",))
            .select(F.col("conv_id").alias("id"), F.lit("full").alias("source"), "chosen", "rejected"))
    sliced = mix.slice_rows(pairs, "train[:20%]", ["conv_id"])
    message = prefs.append_pairs(sliced, layout="message").select(
        F.col("conv_id").alias("id"), F.lit("message").alias("source"), "chosen", "rejected")
    mixed = recipes.build_preference_mix([full, message])
    return mixed.select("source", "id", at("chosen", -1)["content"].alias("chosen_last"),
                        at("rejected", -1)["content"].alias("rejected_last"))


# =========================================================================== JDG

_JUDGE_SQL_PROMPT = (f"{sql_str(judge.JUDGE_PROMPT_HEAD)} || inst || {sql_str(judge.JUDGE_PROMPT_A)} || chosen || "
                     f"{sql_str(judge.JUDGE_PROMPT_B)} || rejected || {sql_str(judge.JUDGE_PROMPT_TAIL)}")


def judge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived ``judge_input``: first user turn of the prompt, chosen vs rejected answers."""
    pairs = _pairs(spark, sf_dir)
    first_user = at(F.filter("conversations", lambda t: t["role"] == "user"), 1)["content"]
    return pairs.select(F.col("conv_id").alias("id"), F.coalesce(first_user, F.lit("")).alias("prompt"),
                        F.col("chosen.content").alias("response_a"), F.col("rejected.content").alias("response_b"))


@register("judge_prompts", f"""WITH {_PAIRS_SQL}
SELECT conv_id AS id, {_JUDGE_SQL_PROMPT} AS judge_prompt,
       CASE WHEN contains(inst, 'Japanese to English') THEN 'Japanese to English' ELSE 'English to Japanese' END AS tag
FROM pairs""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG1 + JDG8: pairwise judging prompt and direction tag."""
    ji = judge_inputs(spark, sf_dir)
    return ji.select("id", judge.judge_prompt(F.col("prompt"), F.col("response_a"), F.col("response_b")).alias("judge_prompt"),
                     judge.direction_tag(F.col("prompt")).alias("tag"))


# Fixed set of verdict spellings used to exercise validation (includes invalid ones).
VERDICT_SPELLINGS = ["A is much better", " a is better ", "B IS SLIGHTLY BETTER", "same", "C wins",
                     "B is better", "A is slightly better", "b is much better", "", "B is slightly better"]


def _verdict_pick(id_col: str) -> F.Column:
    pool = F.array(*[F.lit(v) for v in VERDICT_SPELLINGS])
    return at(pool, (F.pmod(F.col(id_col), F.lit(len(VERDICT_SPELLINGS))) + 1).cast("int"))


_VERDICT_SQL_POOL = "[" + ", ".join(sql_str(v) for v in VERDICT_SPELLINGS) + "]"
_VALID_SQL = S.case_map(S.strip("lower(v)"), judge.VALID_VERDICTS, "'same'")
_SCORE_SQL = S.case_map(S.strip("vv"), {k: str(v) for k, v in judge.VERDICT_SCORES.items()}, "'0.0'")


@register("judge_scores", f"""WITH {_PAIRS_SQL},
v AS (SELECT conv_id AS id, {_VERDICT_SQL_POOL}[(conv_id % {len(VERDICT_SPELLINGS)}) + 1] AS v,
             CASE WHEN contains(inst, 'Japanese to English') THEN 'Japanese to English' ELSE 'English to Japanese' END AS tag
      FROM pairs),
s AS (SELECT id, tag, {_VALID_SQL} AS vv FROM v),
sc AS (SELECT id, tag, vv, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM s)
SELECT tag, count(*) AS n, CAST(count_if(score > 0) AS BIGINT) AS wins, CAST(count_if(score = 0) AS BIGINT) AS ties,
       CAST(count_if(score < 0) AS BIGINT) AS losses,
       sum(score) AS total_score FROM sc GROUP BY tag""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG6 + JDG7 + JDG17: verdict validation, scoring and win/tie/loss summary by tag."""
    ji = judge_inputs(spark, sf_dir).withColumn("v", _verdict_pick("id"))
    result = F.struct(F.array(judge.direction_tag(F.col("prompt"))).alias("tags"),
                      judge.verdict_score(judge.validate_verdict(F.col("v"))).alias("score"))
    summary = judge.verdict_summary(ji.select(F.lit("stub-judge").alias("model"), result.alias("result")))
    return summary.select("tag", "n", "wins", "ties", "losses", (F.col("mean_score") * F.col("n")).alias("total_score"))


def raw_judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived ``judge_raw``: model outputs in the raw forms seen in practice
    (clean, fenced, surrounded, bare children, free text, empty verdict)."""
    ji = judge_inputs(spark, sf_dir).withColumn("v", _verdict_pick("id"))
    e, v = F.col("response_a"), F.col("v")
    clean = F.concat(F.lit("<result><explanation>"), e, F.lit("</explanation><verdict>"), v, F.lit("</verdict></result>"))
    form = F.pmod(F.col("id"), F.lit(6))
    raw = (F.when(form == 0, clean)
           .when(form == 1, F.concat(F.lit("```xml\n"), clean, F.lit("\n```")))
           .when(form == 2, F.concat(F.lit("Here is my judgement:\n"), clean, F.lit("\nThanks")))
           .when(form == 3, F.concat(F.lit("<explanation>"), e, F.lit("</explanation>\n<verdict>"), v, F.lit("</verdict>")))
           .when(form == 4, F.concat(F.lit("explanation: "), e, F.lit(" verdict: "), v))
           .otherwise(F.concat(F.lit("<result><explanation>"), e, F.lit("</explanation><verdict/></result>"))))
    return ji.withColumn("raw_response", raw).withColumn("model", F.lit("stub-judge"))


# Expected outcome of each raw form on the derived fixture (texts hold no XML
# metacharacters): forms 0-3 parse to the collapsed explanation and the validated
# verdict, form 4 falls back to "Failed to parse explanation"/same, form 5 and an
# empty verdict element raise inside extraction and take the neutral default row.
_NONE_STRIP = "empty element"
_JUDGE_RAW_SQL = f"""{_PAIRS_SQL},
jv AS (SELECT conv_id AS id, inst, chosen, {_VERDICT_SQL_POOL}[(conv_id % {len(VERDICT_SPELLINGS)}) + 1] AS v,
              conv_id % 6 AS form FROM pairs),
jc AS (SELECT *, {S.strip(S.ws_collapse('chosen'))} AS expl_c, {S.strip(S.ws_collapse('v'))} AS v_c,
              form = 5 OR (form < 4 AND length(v) = 0) AS err FROM jv),
jr AS (SELECT *, CASE WHEN err THEN NULL WHEN form = 4 THEN 'same'
                      ELSE {S.case_map(S.strip('lower(v_c)'), judge.VALID_VERDICTS, "'same'")} END AS verdict
       FROM jc)"""
_SCORE_OF_VERDICT = S.case_map("verdict", {k: str(v) for k, v in judge.VERDICT_SCORES.items()}, "'0.0'")


@register("judge_verdicts", f"""WITH {_JUDGE_RAW_SQL}
SELECT id, 'stub-judge' AS model, verdict,
       CASE WHEN err THEN CAST(0 AS DOUBLE) ELSE CAST({_SCORE_OF_VERDICT} AS DOUBLE) END AS score,
       CASE WHEN err THEN 'Failed to process response' WHEN form = 4 THEN 'Failed to parse explanation'
            ELSE expl_c END AS explanation,
       CASE WHEN contains(inst, 'Japanese to English') THEN 'Japanese to English' ELSE 'English to Japanese' END AS tag,
       CASE WHEN err THEN {sql_str(_NONE_STRIP)} END AS error
FROM jr""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG2-5, JDG9-10: clean -> parse -> validate -> score, neutral default rows on error."""
    raw = raw_judge_responses(spark, sf_dir)
    rows = judge.judge_rows(raw, on_error="default", keep=("id", "model"))
    return rows.select("id", "model", "verdict", F.col("result.score").alias("score"),
                       F.col("result.custom_fields.explanation").alias("explanation"),
                       F.col("result.tags")[0].alias("tag"), "error")


@register("judge_resume", f"""WITH {_JUDGE_RAW_SQL} SELECT id, inst AS prompt FROM jr WHERE err""")
def judge_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG11: inputs still to judge = inputs without a successful result (key-based resume)."""
    raw = raw_judge_responses(spark, sf_dir)
    done = judge.judge_rows(raw, on_error="drop", keep=("id",))
    return judge.pending_inputs(judge_inputs(spark, sf_dir), done, "id").select("id", "prompt")


@register("answer_rows", f"""SELECT c.conv_id AS question_id, c.turn,
       (SELECT string_agg('<|im_start|>' || coalesce(d.role, '') || {NL} || coalesce(d.text, '') || '<|im_end|>' || {NL}, '' ORDER BY d.turn)
        FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn <= c.turn) || '<|im_start|>assistant' || {NL} AS prompt,
       CAST(0.7 AS DOUBLE) AS temperature
FROM conversations c WHERE c.role = 'user'""")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG13 + JDG15: the prompt of every user turn (all turns up to it, then the generation prompt)."""
    nested = conversations_nested(spark, sf_dir).join(
        load_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("numbers")), "conv_id")
    turn = nested.select("conv_id", "conversations", F.posexplode("numbers").alias("i", "turn"))
    asked = turn.where(F.col("conversations")[F.col("i")]["role"] == "user")
    return asked.select(F.col("conv_id").alias("question_id"), "turn",
                        render.chatml(F.slice("conversations", F.lit(1), F.col("i") + 1), add_generation_prompt=True).alias("prompt"),
                        judge.category_temperature(F.lit(None).cast("string")).alias("temperature"))


@register("answer_script_share", f"""SELECT role AS model_id, CAST(sum(length(text)) AS BIGINT) AS total_chars,
  CAST(sum({S.class_count('text', japanese_or_acceptable_class())}) AS BIGINT) AS counted_chars,
  CAST(100 AS DOUBLE) - CASE WHEN sum(length(text)) > 0 THEN
     CAST(sum(length(text)) - sum({S.class_count('text', japanese_or_acceptable_class())}) AS DOUBLE) / CAST(sum(length(text)) AS DOUBLE) * CAST(100 AS DOUBLE)
     ELSE CAST(0 AS DOUBLE) END AS japanese_pct
FROM conversations GROUP BY role""")
def answer_script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 as used on answer files: script share over all turns of every speaker."""
    flat = load_table(spark, sf_dir, "conversations").withColumnRenamed("role", "model_id")
    return metrics.japanese_share(flat, "text", ["model_id"])


# =========================================================================== AGG

_JA = japanese_or_acceptable_class()


@register("japanese_share", f"""SELECT source, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum({S.class_count('text', _JA)}) AS BIGINT) AS counted_chars,
  CAST(100 AS DOUBLE) - CASE WHEN sum(length(text)) > 0 THEN
     CAST(sum(length(text)) - sum({S.class_count('text', _JA)}) AS DOUBLE) / CAST(sum(length(text)) AS DOUBLE) * CAST(100 AS DOUBLE)
     ELSE CAST(0 AS DOUBLE) END AS japanese_pct
FROM documents GROUP BY source""")
def japanese_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1: Japanese/punctuation/digit share per source file."""
    return metrics.japanese_share(load_table(spark, sf_dir, "documents"), "text", ["source"])


@register("chars_per_token", f"""SELECT CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({_tok_count('text')}) AS BIGINT) AS n_tokens,
       coalesce(CAST(sum(length(text)) AS DOUBLE) / nullif(CAST(sum({_tok_count('text')}) AS DOUBLE), 0), 0.0) AS chars_per_token
FROM documents""")
def chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2: chars per token over all documents."""
    return metrics.chars_per_token(load_table(spark, sf_dir, "documents"), "text")


@register("first_documents", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIX10 + MIX11: the first 100 documents by key (the limit is the feature)."""
    return mix.first_n(load_table(spark, sf_dir, "documents").select("doc_id", "source"), 100, ["doc_id"])


@register("rendered_chars_per_token", f"""WITH r AS (
  SELECT conv_id, string_agg('<|im_start|>' || {_SG_NAME} || {NL} || text || '<|im_end|>' || {NL}, '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)
SELECT CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({_tok_count('text')}) AS BIGINT) AS n_tokens,
       coalesce(CAST(sum(length(text)) AS DOUBLE) / nullif(CAST(sum({_tok_count('text')}) AS DOUBLE), 0), 0.0) AS chars_per_token
FROM r""")
def rendered_chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: ShareGPT turns rendered verbatim (PRJ10 + PRJ14), chars per token.

    Both counts are additive over ChatML pieces, so they are summed per turn on
    the flat table (partial aggregation; no conversation is assembled).
    """
    m = turns.literal_map(SHAREGPT_ROLE_NAMES)
    flat = load_table(spark, sf_dir, "conversations")
    pieces = flat.select(render.chatml_piece(F.coalesce(m[F.col("role")], F.col("role")), F.col("text")).alias("text"))
    return metrics.chars_per_token(pieces, "text")


def _tok_table_sql() -> str:
    counts = {
        "regex-word": _tok_count("text"),
        "whitespace": S.regex_count("text", WHITESPACE_TOKEN_PATTERN),
        "char": "length(text)",
        "utf8-byte": "strlen(text)",
    }
    parts = []
    for name, expr in counts.items():
        parts.append(f"""SELECT {sql_str(name)} AS tokenizer, {COUNTERS[name][1]} AS vocab_size,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({expr}) AS BIGINT) AS n_tokens,
  coalesce(CAST(sum(length(text)) AS DOUBLE) / nullif(CAST(sum({expr}) AS DOUBLE), 0), 0.0) AS chars_per_token FROM documents""")
    return "\nUNION ALL\n".join(parts)


@register("tokenizer_table", _tok_table_sql())
def tokenizer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: tokenizer comparison table from one scan."""
    return metrics.tokenizer_table(load_table(spark, sf_dir, "documents"), "text")


# =========================================================================== TOK

_STORE_SQL = f"""{SQL_NORM}, {SQL_CHATML_STRICT},
st AS (SELECT conv_id AS doc_idx, {_tok_count('text')} AS k, text FROM cm),
store AS (SELECT doc_idx, CASE WHEN length(text) = 0 THEN 0 WHEN k = 0 THEN 0 ELSE k + 1 END AS n_tokens,
                 CASE WHEN length(text) = 0 THEN 'empty_formatted_text' WHEN k = 0 THEN 'empty_tokens' ELSE 'success' END AS status
          FROM st)"""


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = render.chatml_strict_flat(turns.normalize_flat(load_table(spark, sf_dir, "conversations")))
    return tokens.token_build(rendered, "text", "conv_id", max_len=None)


@register("token_build", f"WITH {_STORE_SQL} SELECT doc_idx, n_tokens, status FROM store")
def token_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK1 + FLT8: render -> tokenize -> ids + end-of-document id -> status."""
    return _store(spark, sf_dir).select("doc_idx", F.col("n_tokens").cast("long").alias("n_tokens"), "status")


@register("token_totals", f"""WITH {_STORE_SQL}
SELECT CAST(count_if(status = 'success') AS BIGINT) AS processed, CAST(count_if(status <> 'success') AS BIGINT) AS skipped,
       CAST(sum(n_tokens) AS BIGINT) AS total_tokens, CAST(count_if(status = 'success') AS BIGINT) AS sequences,
       CAST(sum(n_tokens) AS DOUBLE) / nullif(CAST(count_if(status = 'success') AS DOUBLE), 0) AS avg_tokens_per_sample,
       CAST(sum(n_tokens) * 4 AS BIGINT) AS bytes
FROM store""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK2 + TOK3 + TOK12: totals and token-store statistics (4-byte ids for a 65 536 vocab)."""
    store = _store(spark, sf_dir)
    totals, stats = tokens.token_totals(store), tokens.store_stats(store)
    both = totals.withColumn("_one", F.lit(1)).join(stats.withColumn("_one", F.lit(1)), "_one")     # a row each
    return both.select("processed", "skipped", "total_tokens", "sequences", "avg_tokens_per_sample", "bytes")


_SEQ = 512
_PACK_WORLD = 2
_PACK_SQL = f"""WITH d AS (SELECT doc_id, {_tok_count('text')} + 2 AS n,
                  row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS cnt FROM documents),
s AS (SELECT doc_id, n, {_SHARD_SQL.replace('n //', 'cnt //').replace('n %', 'cnt %').replace(f'{_WORLD}', f'{_PACK_WORLD}')} AS shard FROM d),
p AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM s),
t AS (SELECT shard, CAST(sum(n) // {_SEQ + 1} AS BIGINT) AS nch FROM s GROUP BY shard),
sp AS (SELECT p.shard, p.doc_id, unnest(range(p.st // {_SEQ + 1}, least((p.st + p.n - 1) // {_SEQ + 1}, t.nch - 1) + 1)) AS chunk
       FROM p JOIN t USING (shard))
SELECT CAST(shard AS INTEGER) AS shard, chunk, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       {_SEQ} AS input_len, {_SEQ} AS label_len
FROM sp GROUP BY shard, chunk"""


@register("stream_pack", _PACK_SQL)
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK4 (+MIX16): BOS/EOS stream packing into 513-token windows per rank shard."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = tokens.stream_pack_ranks(docs, "text", "doc_id", _SEQ, _PACK_WORLD)
    return packed.select(F.col("shard").cast("int").alias("shard"), F.col("chunk").cast("long").alias("chunk"),
                         F.size("doc_ids").cast("long").alias("n_docs"),
                         F.array_min("doc_ids").alias("first_doc"), F.array_max("doc_ids").alias("last_doc"),
                         F.size("input").alias("input_len"), F.size("label").alias("label_len"))


@register("stream_pack_dropped", f"""SELECT source AS shard, CAST(sum({_tok_count('text')} + 2) % {_SEQ + 1} AS BIGINT) AS dropped
FROM documents GROUP BY source""")
def stream_pack_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK4: tokens at the end of each shard that fill no window (a shard for every source)."""
    return tokens.dropped_tokens(load_table(spark, sf_dir, "documents"), "text", "doc_id", _SEQ, "source")


_PACK_BIN = 8192


@register("sample_pack")
def sample_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK5: whole documents packed into 8192-token bins (over-long ones flagged)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", (DEFAULT_TOKENIZER.count(F.col("text")) + 1).alias("n"))
    return packing.sample_pack(docs, "doc_id", "n", _PACK_BIN)


@register("sample_pack_summary", f"""WITH d AS (SELECT {_tok_count('text')} + 1 AS n FROM documents)
SELECT count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(count_if(n > {_PACK_BIN}) AS BIGINT) AS n_over_long,
       CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_repeated, true AS numbered_without_gaps,
       CAST(greatest(ceil(sum(n) FILTER (n <= {_PACK_BIN}) / {_PACK_BIN}), count_if(n <= {_PACK_BIN} AND 2 * n > {_PACK_BIN})) AS BIGINT) AS least_bins,
       true AS within_five_percent
FROM d""")
def sample_pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK5 by its contract: nothing lost or doubled, no bin overfull, at most 1.05 times the least number of bins."""
    rows = materialize(sample_pack(spark, sf_dir), "packed")
    one = F.lit(1).alias("one")
    fills = rows.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("fill"))
    bins = fills.agg(one, F.count_if(F.col("fill") > _PACK_BIN).alias("n_overfull"), F.count(F.lit(1)).alias("bins"),
                     F.coalesce(F.max("bin") + 1, F.lit(0)).alias("numbers"), F.sum("fill").alias("filled"))
    again = rows.groupBy("id").count().agg(one, F.count_if(F.col("count") > 1).alias("n_repeated"))
    total = rows.agg(one, F.count(F.lit(1)).alias("n_samples"), F.sum("n").alias("n_tokens"), F.count_if("over_long").alias("n_over_long"),
                     F.count_if(~F.col("over_long") & (2 * F.col("n") > _PACK_BIN)).alias("halves"))
    least = F.greatest(F.ceil(F.col("filled") / _PACK_BIN), F.col("halves"))
    return (total.join(bins, "one").join(again, "one")
            .select("n_samples", "n_tokens", "n_over_long", "n_overfull", "n_repeated",
                    (F.col("bins") == F.col("numbers")).alias("numbered_without_gaps"), least.alias("least_bins"),
                    (100 * F.col("bins") <= 105 * least).alias("within_five_percent")))


@register("packed_sequences", f"""WITH {_STORE_SQL}
SELECT doc_idx AS sample_id, n_tokens AS n, CAST(0 AS BIGINT) AS first_position, n_tokens - 1 AS last_position, true AS same_ids
FROM store WHERE status = 'success' AND n_tokens <= 2048""")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK5: every conversation's ids found again, whole and with positions of its own, inside the sequence it was packed in."""
    store = _store(spark, sf_dir).where(F.col("status") == "success")
    bins = packing.sample_pack(store, "doc_idx", "n_tokens", 2048)
    seq = packing.packed_sequences(store, bins)
    first = F.aggregate(F.slice("lengths", 1, F.col("i")), F.lit(0), lambda a, x: a + x)
    parts = (seq.select("*", F.posexplode("sample_ids").alias("i", "sample_id")).withColumn("lo", first + 1)
             .withColumn("n", F.element_at("lengths", F.col("i") + 1))
             .select("sample_id", "n", F.expr("slice(input_ids, lo, n)").alias("ids"), F.expr("slice(position_ids, lo, n)").alias("at")))
    return (parts.join(store.select(F.col("doc_idx").alias("sample_id"), "token_ids"), "sample_id")
            .select("sample_id", F.col("n").cast("long").alias("n"), F.element_at("at", 1).cast("long").alias("first_position"),
                    F.element_at("at", -1).cast("long").alias("last_position"), (F.col("ids") == F.col("token_ids")).alias("same_ids")))


@register("pad_batches", f"""WITH {_STORE_SQL},
b AS (SELECT doc_idx, n_tokens, (row_number() OVER (ORDER BY doc_idx) - 1) // 8 AS batch FROM store WHERE status = 'success')
SELECT doc_idx, batch, max(n_tokens) OVER (PARTITION BY batch) AS batch_len,
       max(n_tokens) OVER (PARTITION BY batch) - n_tokens AS n_pad, 1024 AS fixed_len,
       n_tokens > 1024 AS truncated FROM b""")
def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK7 + TOK8: pad to the batch maximum with attention masks; fixed-length padding."""
    store = _store(spark, sf_dir).where(F.col("status") == "success")
    padded = tokens.pad_batches(store, "token_ids", ["doc_idx"], 8)
    return padded.select("doc_idx", F.col("batch").cast("long").alias("batch"), F.col("batch_len").cast("long").alias("batch_len"),
                         (F.size("input_ids") - F.size("token_ids")).cast("long").alias("n_pad"),
                         F.size(tokens.pad_fixed(F.col("token_ids"), 1024)).alias("fixed_len"),
                         (F.size("token_ids") > 1024).alias("truncated"))


_CFG_VALUES = ", ".join(f"({e}, {b}, {sql_str(n)})" for e, b, n in tokens.CONFIGURATIONS)


@register("step_plan", f"""WITH {SQL_NORM}, c(epochs, batch_size, name) AS (VALUES {_CFG_VALUES}),
n AS (SELECT count(DISTINCT conv_id) AS n_samples FROM norm),
x AS (SELECT n_samples, epochs, batch_size, name, (n_samples * epochs) // batch_size AS steps FROM n, c)
SELECT n_samples, CAST(epochs AS BIGINT) AS epochs, CAST(batch_size AS BIGINT) AS batch_size, name, steps,
  CASE WHEN steps > 0 THEN greatest(steps // epochs, 1) ELSE 1 END AS save_interval,
  CASE WHEN steps = 0 THEN 'no training' WHEN steps < 10 THEN 'very short' WHEN steps < 100 THEN 'short' ELSE 'good' END AS status,
  CAST(ceil(CAST(n_samples * epochs AS DOUBLE) / batch_size) AS BIGINT) AS steps_ceil,
  greatest(steps // epochs, 100) AS save_interval_min100,
  CASE WHEN n_samples = 0 THEN 'empty' WHEN n_samples < 100 THEN 'very small' WHEN n_samples < 1000 THEN 'small'
       WHEN n_samples < 10000 THEN 'moderate' ELSE 'large' END AS tier
FROM x""")
def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK9-11: configuration matrix, step planning and size tier for the built set."""
    counts = normalized(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_samples"))
    plan = None
    for epochs, batch, name in tokens.CONFIGURATIONS:
        own = tokens.step_plan(F.col("n_samples"), epochs, batch)
        plan = own if plan is None else F.when(F.col("name") == name, own).otherwise(plan)
    m = tokens.config_matrix(counts).withColumn("p", plan)
    return m.select("n_samples", F.col("epochs").cast("long").alias("epochs"), F.col("batch_size").cast("long").alias("batch_size"),
                    "name", "steps", "save_interval", "status", F.col("p.steps_ceil").alias("steps_ceil"),
                    F.col("p.save_interval").alias("save_interval_min100"), tokens.size_tier(F.col("n_samples")).alias("tier"))


@register("artifact_check")
def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK14: required-artifact completeness of the table directory, with the row
    count of every table that is present (Parquet footers, no data pages)."""
    from functools import reduce

    from ..sources.tables import TABLES
    report = tokens.completeness(spark, sf_dir, [f"{t}.parquet" for t in TABLES] + ["vocab.json"])
    counts = reduce(lambda a, b: a.unionByName(b),
                    [load_table(spark, sf_dir, t).groupBy().count().select(F.lit(f"{t}.parquet").alias("name"),
                                                                           F.col("count").alias("rows"))
                     for t in TABLES])
    return report.join(F.broadcast(counts), "name", "left")


# =========================================================================== LEAK

def leak_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived ``leak`` rows: each assistant turn (chosen) against the turn before it
    (rejected); the third token of each side is the leak/correction pair; odd
    conversations carry them only inside the ``meta`` JSON string."""
    flat = load_table(spark, sf_dir, "conversations")
    a = flat.where(F.col("role") == "assistant").alias("a")
    prev = flat.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("rejected"))
    pairs = a.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("chosen"), "rejected")
    tok = leak.LEAK_TOKENIZER
    bad = F.when(F.size(tok.pieces(F.col("rejected"))) >= 3, F.array(at(tok.pieces(F.col("rejected")), 3)))
    good = at(tok.pieces(F.col("chosen")), 3)
    odd = F.pmod(F.col("conv_id"), F.lit(2)) == 1
    meta = F.to_json(F.struct(bad.alias("leak_tokens"), good.alias("corrected_token")))
    return pairs.select("conv_id", "turn", "chosen", "rejected",
                        F.when(~odd, bad).alias("leak_tokens"), F.when(~odd, good).alias("corrected_token"),
                        F.when(odd, meta).alias("meta"))


_LEAK_SQL = f"""WITH a AS (SELECT conv_id, turn, text AS chosen FROM conversations WHERE role = 'assistant'),
p AS (SELECT a.conv_id, a.turn, a.chosen, c.text AS rejected FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1),
t AS (SELECT conv_id, turn, rejected,
             regexp_extract_all(chosen, {sql_str(TOKEN_PATTERN)}) AS x,
             regexp_extract_all(rejected, {sql_str(TOKEN_PATTERN)}) AS y FROM p),
u AS (SELECT *, CASE WHEN len(y) >= 3 THEN y[3] END AS leak_tok, x[3] AS corr,
             list_position(x, x[3]) - 1 AS pos FROM t),
v AS (SELECT *, CASE WHEN pos > 0 THEN pos
                     WHEN length(rejected) > 0 THEN list_filter(range(1, least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1])[1] END AS position
      FROM u)
SELECT conv_id, turn, CAST(CASE WHEN leak_tok IS NOT NULL AND coalesce(length(corr), 0) > 0 THEN position END AS INTEGER) AS position,
       CASE WHEN leak_tok IS NULL OR coalesce(length(corr), 0) = 0 THEN 'missing_metadata'
            WHEN coalesce(position, 0) <= 0 THEN 'no_position' END AS skip_reason,
       CAST(CASE WHEN leak_tok IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_bad, len(x) AS n_input_ids
FROM v"""


@register("leak_positions", _LEAK_SQL)
def leak_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEAK1-7 + FLT9: metadata fallback, candidate ids, correction position, skip reasons."""
    recs = leak.leak_records(leak_inputs(spark, sf_dir))
    return recs.select("conv_id", "turn", F.when(F.col("skip_reason").isNull() | (F.col("skip_reason") == "no_position"),
                                                 F.col("position")).alias("position"),
                       "skip_reason", F.size("bad_token_ids").cast("long").alias("n_bad"),
                       F.size("input_ids").cast("long").alias("n_input_ids"))


from . import catalog_feeds, catalog_roundtrips, catalog_tables  # noqa: E402,F401  (they register their queries here)
