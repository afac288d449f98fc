"""Registered queries of readers, sinks and stored tables (written to the session's scratch folder and read back)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokenize import MD5_TOKENIZER, TOKEN_PATTERN
from ..operators import leak, metrics, mixed, render, tokens, turns, vocabularies
from ..session import scratch_path
from ..sources import line_batches, prepared, token_store
from ..sources.tables import load_table
from .catalog import _STORE_SQL, SQL_CHATML_STRICT, SQL_NORM, register
from .sqlgen import sql_str

_LINE_BATCHES = 4
_TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_BROKEN = "(conv_id * 31 + turn) % 23 = 7"


def _write_turn_lines(spark: SparkSession, sf_dir: str) -> str:
    """``conversations`` as JSON lines in order, some of them broken off; the folder."""
    path = scratch_path(spark, "turn-lines")
    turns = load_table(spark, sf_dir, "conversations").repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    turns.select(F.when(F.expr(_BROKEN), F.concat(F.lit('{"conv_id": '), "conv_id", F.lit(', "te'))).otherwise(whole).alias("value")).write.text(path)
    return path


@register("jsonl_line_batches", f"""WITH x AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line, count(*) OVER () AS total, {_BROKEN} AS broken FROM conversations),
b AS (SELECT *, line // ((total + {_LINE_BATCHES - 1}) // {_LINE_BATCHES}) AS batch FROM x)
SELECT CAST(batch AS INTEGER) AS batch, CAST(min(line) AS BIGINT) AS first_line, count_if(NOT broken) AS n_good, count_if(broken) AS n_bad,
       min(line) FILTER (broken) AS first_bad, CAST(sum(line) FILTER (broken) AS BIGINT) AS bad_lines_sum,
       CAST(sum(conv_id * 1000 + turn) FILTER (NOT broken) AS BIGINT) AS keys_sum,
       CAST(sum(length(text)) FILTER (NOT broken) AS BIGINT) AS n_chars, max(line) + 1 = any_value(total) AS is_end
FROM b GROUP BY batch""")
def jsonl_line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2 + SRC3: a folder of JSON lines read in batches by line number, with bad lines and the end."""
    index = line_batches.index_lines(spark, _write_turn_lines(spark, sf_dir), range_bytes=1 << 16)
    step, out = -(-index.lines // _LINE_BATCHES) or 1, None
    for batch, start in enumerate(range(0, index.lines, step)):
        rows = line_batches.parsed_lines(line_batches.read_lines(spark, index, start, step), _TURN)
        broken = F.col("bad").isNotNull()
        one = rows.agg(
            F.lit(batch).alias("batch"), F.min("line").alias("first_line"), F.count_if(~broken).alias("n_good"),
            F.count_if(broken).alias("n_bad"), F.min(F.when(broken, F.col("line"))).alias("first_bad"),
            F.sum(F.when(broken, F.col("line"))).alias("bad_lines_sum"),
            F.sum(F.col("record.conv_id") * 1000 + F.col("record.turn")).alias("keys_sum"),
            F.sum(F.length("record.text")).cast("long").alias("n_chars"), F.max("is_end").alias("is_end"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------------------- content of several kinds in one column

def mixed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages in JSON whose content is, by turn, a text, a list of lines, null, a number, under the
    older keys, or a list of mixed parts: ``conv_id, turn, message``."""
    kind = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(6))
    said = F.to_json(F.struct(F.col("text").alias("t")), {"ignoreNullFields": "false"})
    text = F.expr("substr(said, 6, length(said) - 6)")              # the JSON form of the text alone
    content = (F.when(F.col("kind") == 1, F.to_json(F.split("text", "\n"))).when(F.col("kind") == 2, "null")
               .when(F.col("kind") == 3, F.concat((F.col("conv_id") + 1).cast("string"), F.lit(".5")))
               .when(F.col("kind") == 5, F.concat(F.lit("["), text, F.lit(', 0, false, 7, null, true, 2.0, "", {"a": [1]}]'))).otherwise(text))
    role = F.to_json(F.struct(F.col("role").alias("r")))
    keys = F.when(F.col("kind") == 4, F.array(F.lit("from"), F.lit("value"))).otherwise(F.array(F.lit("role"), F.lit("content")))
    turns = load_table(spark, sf_dir, "conversations").withColumn("kind", kind).withColumn("said", said)
    message = F.concat(F.lit('{"'), keys[0], F.lit('": '), F.expr("substr(r, 6, length(r) - 6)"), F.lit(', "'), keys[1], F.lit('": '), "content", F.lit("}"))
    return turns.withColumn("r", role).withColumn("content", content).select("conv_id", "turn", message.alias("message"))


_MIXED_KIND = "(conv_id * 7 + turn) % 6"
_MIXED_TEXT = f"""CASE {_MIXED_KIND} WHEN 1 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))
  WHEN 2 THEN '' WHEN 3 THEN (conv_id + 1) || '.5'
  WHEN 5 THEN array_to_string(list_filter([text, '7', 'True', '2.0', '{{"a":[1]}}'], lambda x: x <> ''), chr(10)) ELSE text END"""


@register("mixed_content", f"""SELECT conv_id, turn, ['string', 'list', 'null', 'number', 'string', 'list'][{_MIXED_KIND} + 1] AS kind, role,
       {_MIXED_TEXT} AS content FROM conversations""")
def mixed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1 + PRJ3: string, list, null and number content in one column, each as the text the builders write."""
    m = mixed_turns(spark, sf_dir).select("conv_id", "turn", mixed.parsed("message").alias("m"))
    content = mixed.message_content(F.col("m"))
    return m.select("conv_id", "turn", mixed.kind_of(content).alias("kind"), mixed.scalar_text(mixed.message_role(F.col("m"))).alias("role"),
                    mixed.content_text(content).alias("content"))


@register("mixed_conversations", f"""WITH x AS (
  SELECT conv_id, turn, role, {_MIXED_KIND} AS k, {_MIXED_TEXT} AS content FROM conversations)
SELECT conv_id, count_if(k <> 2) AS n_turns, coalesce(string_agg(role || '|' || content, chr(10) ORDER BY turn) FILTER (k <> 2), '') AS normalized,
       string_agg(CASE WHEN k IN (1, 5) THEN '' WHEN k = 2 THEN role || ': None' ELSE role || ': ' || content END, chr(10) ORDER BY turn) AS concatenated
FROM x GROUP BY conv_id""")
def mixed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1-3 and PRJ12 over whole conversations stored as JSON lists of mixed messages.

    Lines of list content are blanked in ``concatenated`` (there they are JSON text, which has no fixed form in SQL).
    """
    nested = (mixed_turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("t"))
              .select("conv_id", F.concat(F.lit("["), F.array_join(F.col("t.message"), ","), F.lit("]")).alias("messages")))
    v = nested.select("conv_id", F.try_variant_get(mixed.parsed("messages"), "$", "array<variant>").alias("m"))
    clean = mixed.normalize_messages(F.col("m"), {"user": ["user"], "assistant": ["assistant"], "system": ["system"]})
    blanked = F.transform("m", lambda x: F.when(mixed.kind_of(mixed.message_content(x)) == "list", "").otherwise(
        F.rtrim(mixed.concat_messages(F.array(x)), F.lit("\n"))))
    return v.select("conv_id", F.size(clean).cast("long").alias("n_turns"),
                    F.array_join(F.transform(clean, lambda t: F.concat(t["role"], F.lit("|"), t["content"])), "\n").alias("normalized"),
                    F.array_join(blanked, "\n").alias("concatenated"))


# ---------------------------------------------------------------------------- token ids and the dense document index

_WIDTH, _SPECIAL, _EOD = MD5_TOKENIZER.vocab_size - MD5_TOKENIZER.n_special, MD5_TOKENIZER.n_special, MD5_TOKENIZER.eod


def _ids_sql(text: str) -> str:
    """Ids of the MD5 tokenizer as a DuckDB list."""
    return (f"list_transform(regexp_extract_all({text}, {sql_str(TOKEN_PATTERN)}), "
            f"lambda p: cast('0x' || substr(md5(p), 1, 8) AS BIGINT) % {_WIDTH} + {_SPECIAL})")


_IDS_SQL = f"""{SQL_NORM}, {SQL_CHATML_STRICT},
ids AS (SELECT conv_id, list_append({_ids_sql('text')}, {_EOD}) AS ids FROM cm WHERE length(text) > 0 AND len({_ids_sql('text')}) > 0)"""


def _weighted(ids: str) -> str:
    """SQL: a sum that depends on every id and its place."""
    return f"list_sum(list_transform({ids}, lambda x, i: x * (i % 1000 + 1)))"


def weighted_sum(ids):
    """The same as a Column; places count from 1."""
    return F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * ((i + 1) % 1000 + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def _md5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = render.chatml_strict_flat(turns.normalize_flat(load_table(spark, sf_dir, "conversations")))
    return tokens.token_build(rendered, "text", "conv_id", tokenizer=MD5_TOKENIZER)


@register("token_ids", f"WITH {_IDS_SQL} SELECT conv_id AS doc_idx, len(ids) AS n_tokens, CAST({_weighted('ids')} AS BIGINT) AS ids_sum FROM ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK1: the ids themselves, by a sum over ids and places."""
    return (_md5_store(spark, sf_dir).where("status = 'success'")
            .select("doc_idx", F.col("n_tokens").cast("long").alias("n_tokens"), weighted_sum(F.col("token_ids")).alias("ids_sum")))


_CUT = 64


@register("token_ids_truncated", f"""WITH {SQL_NORM}, {SQL_CHATML_STRICT},
x AS (SELECT conv_id, {_ids_sql('text')} AS ids FROM cm WHERE length(text) > 0 AND len({_ids_sql('text')}) > 0)
SELECT conv_id AS doc_idx, least(len(ids), {_CUT}) + 1 AS n_tokens, len(ids) > {_CUT} AS truncated,
       CAST({_weighted(f'list_append(ids[1:{_CUT}], {_EOD})')} AS BIGINT) AS ids_sum FROM x""")
def token_ids_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK1 + TOK6: ids cut to a maximum length, with a flag."""
    rendered = render.chatml_strict_flat(turns.normalize_flat(load_table(spark, sf_dir, "conversations")))
    store = tokens.token_build(rendered, "text", "conv_id", tokenizer=MD5_TOKENIZER, max_len=_CUT).where("status = 'success'")
    return store.select("doc_idx", F.col("n_tokens").cast("long").alias("n_tokens"), "truncated", weighted_sum(F.col("token_ids")).alias("ids_sum"))


_PART, _RANGES = 4096, ((0, 1), (1000, 5000), (4095, 4097), (9000, 20_000))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "token-store")
    token_store.write_token_store(_md5_store(spark, sf_dir), path, ["doc_idx"], part_tokens=_PART, keep=["doc_idx"])
    return path


_INDEX_SQL = f"""WITH {_IDS_SQL},
o AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS doc, conv_id, ids, len(ids) AS n,
             CAST(sum(len(ids)) OVER (ORDER BY conv_id) - len(ids) AS BIGINT) AS first FROM ids)"""


@register("token_store_index", f"""{_INDEX_SQL}
SELECT doc, first AS "offset", n AS n_tokens, CAST({_weighted('ids')} AS BIGINT) AS ids_sum FROM o
UNION ALL SELECT count(*), CAST(coalesce(sum(n), 0) AS BIGINT), NULL, NULL FROM o""")
def token_store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8 + TOK12: the store's index in original order with its sentinel, against lengths and ids read back from the data."""
    path = _stored(spark, sf_dir)
    docs = token_store.get_documents(spark, path, 0, 1 << 60)
    return (token_store.document_index(spark, path)
            .join(docs.select("doc", "n_tokens", weighted_sum(F.col("token_ids")).alias("ids_sum")), "doc", "left")
            .select("doc", "offset", "n_tokens", "ids_sum"))


@register("token_store_ranges", f"""{_INDEX_SQL}, r(lo, hi) AS (VALUES {', '.join(str(r) for r in _RANGES)})
SELECT lo, doc, greatest(first, lo) AS first, least(first + n, hi) - greatest(first, lo) AS n_tokens,
       CAST({_weighted('ids[greatest(first, lo) - first + 1 : least(first + n, hi) - first]')} AS BIGINT) AS ids_sum
FROM o, r WHERE first < hi AND first + n > lo""")
def token_store_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: token ranges of the stored stream, each read from the parts it touches."""
    path, out = _stored(spark, sf_dir), None
    for lo, hi in _RANGES:
        found = token_store.get_tokens(spark, path, lo, hi)
        one = found.select(F.lit(lo).alias("lo"), "doc", "first", F.size("token_ids").cast("long").alias("n_tokens"),
                           weighted_sum(F.col("token_ids")).alias("ids_sum"))
        out = one if out is None else out.unionByName(one)
    return out


@register("first_document_lengths", f"{_INDEX_SQL} SELECT doc, n AS n_tokens FROM o WHERE doc < 10")
def first_document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK12: lengths of the first ten documents, from the index."""
    return token_store.first_lengths(spark, _stored(spark, sf_dir))


# ---------------------------------------------------------------------------- prepared copies, rebuilt file by file

_SOURCES, _CHANGED = 5, 3


@register("prepared_incremental", f"""SELECT conv_id, turn, CASE WHEN conv_id % {_SOURCES} = {_CHANGED} THEN upper(role) ELSE role END AS role,
       length(text) AS n_chars, conv_id % {_SOURCES} = {_CHANGED} AS built_again FROM conversations WHERE text IS NOT NULL""")
def prepared_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: a folder of source files is prepared, one of them changes, and only its rows are built again."""
    source, target = scratch_path(spark, "sources"), scratch_path(spark, "prepared")
    turns_ = load_table(spark, sf_dir, "conversations").withColumn("k", F.pmod("conv_id", F.lit(_SOURCES)))

    def write(k: int, rows: DataFrame) -> None:
        rows.where(F.col("k") == k).drop("k").write.mode("overwrite").json(f"{source}/part-{k}.jsonl")

    def read(s: SparkSession, paths):
        return s.read.schema(_TURN).json(list(paths))

    def build(rows: DataFrame) -> DataFrame:
        return rows.where("text is not null").select("conv_id", "turn", "role", F.length("text").alias("n_chars"), "source_file")

    def bring_up_to_date() -> prepared.Manifest:
        return prepared.prepare(spark, f"{source}/*", target, build, read, pattern="*.json")

    for k in range(_SOURCES):
        write(k, turns_)
    first = bring_up_to_date()
    write(_CHANGED, turns_.withColumn("role", F.upper("role")))
    second = bring_up_to_date()
    again = F.col("source_file").isin([f.name for f in second.files if f.name in second.rebuilt and f.name not in {x.name for x in first.files}])
    return prepared.read_prepared(spark, target).select("conv_id", "turn", "role", "n_chars", again.alias("built_again"))


# ---------------------------------------------------------------------------- vocabularies

@register("vocabulary_table")
def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: the public vocabulary files beside the four built-in counters."""
    import public_tokenizers as P

    docs = load_table(spark, sf_dir, "documents").select("text")
    files = [vocabularies.Vocabulary(n, P.path(n), P.PATTERN if n.endswith(".tiktoken") else None) for n in (
        "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model")]
    measured = vocabularies.efficiency(vocabularies.measure_vocabularies(docs, "text", files))
    counted = metrics.tokenizer_table(docs, "text").select(*measured.columns)
    return measured.unionByName(counted).orderBy(F.desc("chars_per_token"), "tokenizer")
