"""Leak-correction records for unlikelihood training (LEAK1-8).

Everything is Column work: metadata fallback via ``get_json_object`` (invalid
or blank JSON -> null), candidate encodings with the JVM tokenizer, the first
position of the corrected token with ``array_position`` and the first
differing index against the rejected text with ``filter(sequence(...))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import at
from ..functions.text import ustrip
from ..functions.tokenize import RegexTokenizer

# Wide hash vocabulary so distinct pieces practically never share an id.
LEAK_TOKENIZER = RegexTokenizer(name="regex-word-wide", vocab_size=2_147_483_000)


def _as_list(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return c.cast(T.ArrayType(T.StringType()))
    return F.when(F.length(c.cast("string")) > 0, F.array(c.cast("string")))     # an empty string is no token


def _as_scalar(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        first = at(c.cast(T.ArrayType(T.StringType())), 1)
        return F.when(c.isNotNull(), F.coalesce(first, F.lit("")))      # an empty list stays empty: no fallback
    return c.cast("string")


def _meta_value(meta: Column, key: str) -> Column:
    """JSON text of ``meta[key]`` (null for blank, malformed or non-object meta)."""
    return F.get_json_object(F.nullif(ustrip(meta), F.lit("")), f"$.{key}")


def _json_as_list(txt: Column) -> Column:
    parsed = F.from_json(txt, T.ArrayType(T.StringType()))
    return F.when(ustrip(txt).startswith("["), parsed).when(txt.isNotNull(), F.array(txt))


def _json_as_scalar(txt: Column) -> Column:
    parsed = F.from_json(txt, T.ArrayType(T.StringType()))
    return F.when(ustrip(txt).startswith("["), at(parsed, 1)).otherwise(txt)


def leak_records(df: DataFrame, tokenizer: RegexTokenizer = LEAK_TOKENIZER, chosen_col: str = "chosen",
                 rejected_col: str = "rejected", leak_col: str = "leak_tokens",
                 corrected_col: str = "corrected_token", meta_col: str | None = "meta",
                 meta_leak_key: str | None = None, meta_corrected_key: str | None = None,
                 max_length: int | None = None, key_col: str | None = None) -> DataFrame:
    """LEAK1-7 + FLT9: one row per input with ``skip_reason`` (null = usable record).

    Texts are used whole; with ``max_length`` only that many ids are, and
    ``truncated`` says which records lost some.

    With the built-in tokenizer every step is a Column.  With a plug-in
    (Python) tokenizer the candidate ids are encoded once per *distinct*
    leak/correction string and joined back by ``key_col``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    leak = _as_list(F.col(leak_col), types[leak_col]) if leak_col in types else F.lit(None)
    corrected = _as_scalar(F.col(corrected_col), types[corrected_col]) if corrected_col in types else F.lit(None)
    if meta_col and meta_col in types:
        meta = F.col(meta_col).cast("string") if not isinstance(types[meta_col], T.StringType) else F.col(meta_col)
        if isinstance(types[meta_col], (T.StructType, T.MapType)):
            meta = F.to_json(F.col(meta_col))
        leak = F.when(F.coalesce(F.size(leak), F.lit(0)) > 0, leak).otherwise(
            _json_as_list(_meta_value(meta, meta_leak_key or leak_col)))
        listed = isinstance(types.get(corrected_col), T.ArrayType)
        given = corrected.isNotNull() if listed else F.coalesce(F.length(corrected), F.lit(0)) > 0
        corrected = F.when(given, corrected).otherwise(
            _json_as_scalar(_meta_value(meta, meta_corrected_key or corrected_col)))
    leak = F.coalesce(leak, F.array().cast(T.ArrayType(T.StringType())))
    tok = tokenizer
    # the ids are columns of their own: nothing below may tokenize a text again
    staged = (df.withColumn("_leak", leak).withColumn("_corr", corrected)
              .withColumn("_ids", tok.ids(F.col(chosen_col))))
    if rejected_col in types:
        staged = staged.withColumn("_rej_ids", tok.ids(F.col(rejected_col)))
    if isinstance(tok, RegexTokenizer):
        def candidate_id(s: Column) -> Column:
            return F.coalesce(tok.single_id_or_null(s), tok.single_id_or_null(F.concat(F.lit(" "), s)),
                              tok.single_id_or_null(ustrip(s)), tok.first_id_or_null(s))

        staged = (staged.withColumn("bad_token_ids", F.filter(F.transform("_leak", candidate_id), lambda x: x.isNotNull()))
                  .withColumn("good_token_id", F.when(F.col("_corr").isNotNull(), candidate_id(F.col("_corr")))))
    else:
        if key_col is None:
            raise ValueError("a plug-in tokenizer needs key_col to join candidate ids back")
        staged = _plugin_candidates(staged, tok, key_col)

    def cut(ids: str) -> Column:
        return F.col(ids) if max_length is None else F.slice(ids, 1, max_length)

    staged = (staged.withColumn("truncated", F.lit(False) if max_length is None else F.size("_ids") > max_length)
              .withColumn("input_ids", cut("_ids")))
    pos = F.array_position("input_ids", F.col("good_token_id")) - 1
    direct = F.when(pos > 0, pos)
    if rejected_col in types:
        staged = staged.withColumn("_rej_ids", cut("_rej_ids"))
        paired = F.arrays_zip(F.col("input_ids").alias("a"), F.col("_rej_ids").alias("b"))
        differs = F.transform(paired, lambda x, i: (i >= 1) & x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"]))
        first = F.array_position(differs, True) - 1
        wanted = direct.isNull() & (F.length(F.col(rejected_col)) > 0)        # looked for only where it is needed
        position = F.coalesce(direct, F.when(wanted & (first > 0), first))
    else:
        position = direct
    reason = (F.when((F.size("_leak") == 0) | F.coalesce(F.length("_corr") == 0, F.lit(True)), F.lit("missing_metadata"))
              .when(F.size("bad_token_ids") == 0, F.lit("no_bad_token_ids"))
              .when(F.coalesce(position, F.lit(0)) <= 0, F.lit("no_position")))
    return (staged.withColumn("position", position.cast("int"))
            .withColumn("skip_reason", reason)
            .withColumn("multi_leak", F.size("_leak") > 1)
            .withColumnRenamed("_leak", "leak_tokens_resolved")
            .withColumnRenamed("_corr", "corrected_token_resolved")
            .drop("_ids", "_rej_ids"))


def _plugin_candidates(staged: DataFrame, tok, key_col: str) -> DataFrame:
    """LEAK3/LEAK4 for a plug-in tokenizer: encode each distinct candidate string once
    (plain, space-prefixed, stripped; first single-token encoding wins, else the
    first id of the plain encoding) and join the ids back per row."""
    strings = (staged.select(F.explode("_leak").alias("s"))
               .unionByName(staged.select(F.col("_corr").alias("s")))
               .where(F.col("s").isNotNull()).distinct())
    plain = tok.ids(F.col("s"))
    spaced = tok.ids(F.concat(F.lit(" "), F.col("s")))
    stripped = tok.ids(ustrip(F.col("s")))

    def single(a: Column) -> Column:
        return F.when(F.size(a) == 1, at(a, 1))

    cand = strings.select("s", F.coalesce(single(plain), single(spaced), single(stripped),
                                          F.when(F.size(plain) >= 1, at(plain, 1))).alias("cid"))
    bad = (staged.select(key_col, F.posexplode("_leak").alias("_pos", "s")).join(cand, "s", "left")
           .groupBy(key_col)
           .agg(F.array_sort(F.collect_list(F.struct("_pos", "cid"))).alias("_b"))
           .select(key_col, F.filter(F.transform("_b", lambda x: x["cid"]), lambda x: x.isNotNull()).alias("bad_token_ids")))
    good = (staged.select(key_col, F.col("_corr").alias("s")).join(cand, "s", "left")
            .select(key_col, F.col("cid").alias("good_token_id")))
    return (staged.join(bad, key_col, "left").join(good, key_col, "left")
            .withColumn("bad_token_ids", F.coalesce("bad_token_ids", F.array().cast(T.ArrayType(T.IntegerType())))))


def leak_summary(records: DataFrame) -> DataFrame:
    """LEAK7: created / skipped / multi-leak counts."""
    return records.agg(F.count_if(F.col("skip_reason").isNull()).alias("created"),
                       F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"),
                       F.count_if(F.col("skip_reason").isNull() & F.col("multi_leak")).alias("multi_leak"))


def probability_means(scored: DataFrame, order_col: str, n: int | None = None) -> DataFrame:
    """LEAK8: mean bad-token and good-token probability over all samples, or the first ``n``.

    ``scored`` supplies ``bad_probs ARRAY<DOUBLE>`` and ``good_prob DOUBLE``
    (model scoring itself is outside this engine).
    """
    first = scored if n is None else scored.orderBy(order_col).limit(n)
    bad_sum = F.aggregate("bad_probs", F.lit(0.0), lambda acc, x: acc + x)
    return first.agg((F.sum(bad_sum) / F.sum(F.size("bad_probs"))).alias("mean_bad_prob"),
                     F.avg("good_prob").alias("mean_good_prob"))
