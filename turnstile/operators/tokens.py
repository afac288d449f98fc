"""Tokens, sequences, packing and step planning (TOK1-14).

Stream packing (TOK4) orders and tokenizes the texts in one pass that also
keeps running token counts, cuts every document's ids at the window edges, and
assembles each window from at most ``seq_len + 1`` tokens in a bounded
``groupBy(shard, chunk)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import at
from ..functions.tokenize import DEFAULT_TOKENIZER, RegexTokenizer, optimal_id_type
from ..session import materialize
from .index import with_row_index, with_running_starts
from .packing import sample_pack  # noqa: F401  (TOK5)
from .quality import document_status


# --------------------------------------------------------------------------- TOK1/TOK2/TOK6

def token_build(df: DataFrame, text_col: str, id_col: str, conv_col: str | None = None,
                tokenizer: RegexTokenizer = DEFAULT_TOKENIZER, add_eod: bool = True,
                max_len: int | None = None) -> DataFrame:
    """TOK1 + FLT8 (+TOK6): ``doc_idx, token_ids, n_tokens, status[, truncated]``.

    Ids get the end-of-document id appended; rows whose status is not
    ``success`` carry null ids.
    """
    if hasattr(tokenizer, "encode_status"):          # plug-in tokenizer: errors become statuses
        out = (df.withColumn("_enc", tokenizer.encode_status(F.col(text_col)))
               .withColumn("_ids", F.col("_enc.ids")).withColumn("_err", F.col("_enc.error")).drop("_enc"))
        err = F.col("_err")
    else:
        out = df.withColumn("_ids", tokenizer.ids(F.col(text_col)))
        err = None
    if max_len is not None:
        out = (out.withColumn("truncated", F.size("_ids") > F.lit(max_len))
               .withColumn("_ids", F.slice("_ids", 1, max_len)))
    conv = F.col(conv_col) if conv_col else F.array(F.lit(1))
    status = document_status(conv, F.col(text_col), F.size("_ids"), err)
    with_eod = F.concat(F.col("_ids"), F.array(F.lit(tokenizer.eod))) if add_eod else F.col("_ids")
    keep = ["truncated"] if max_len is not None else []
    return (out.withColumn("status", status)
            .select(F.col(id_col).cast("long").alias("doc_idx"),
                    F.when(F.col("status") == "success", with_eod).alias("token_ids"),
                    F.when(F.col("status") == "success", F.size(with_eod)).otherwise(F.lit(0)).alias("n_tokens"),
                    "status", *keep))


def token_totals(store: DataFrame) -> DataFrame:
    """TOK2: processed, skipped and total tokens of a token store."""
    return store.agg(F.count_if(F.col("status") == "success").alias("processed"),
                     F.count_if(F.col("status") != "success").alias("skipped"),
                     F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def narrow_ids(store: DataFrame, vocab_size: int) -> DataFrame:
    """TOK3: cast ids to the smallest integer type that holds the vocabulary."""
    return store.withColumn("token_ids", F.col("token_ids").cast(T.ArrayType(optimal_id_type(vocab_size))))


def store_stats(store: DataFrame, vocab_size: int = DEFAULT_TOKENIZER.vocab_size) -> DataFrame:
    """TOK12: sequences, tokens, average tokens per sample, bytes at the id width."""
    width = 2 if isinstance(optimal_id_type(vocab_size), T.ShortType) else 4
    ok = store.where(F.col("status") == "success")
    return (ok.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"))
            .withColumn("documents", F.col("sequences"))
            .withColumn("avg_tokens_per_sample", F.col("tokens") / F.nullif(F.col("sequences"), F.lit(0)))
            .withColumn("bytes", F.col("tokens") * F.lit(width))
            .withColumn("bytes_int32", F.col("tokens") * F.lit(4)))


# --------------------------------------------------------------------------- TOK4 stream packing

def _ordered_tokens(base: DataFrame, tokenizer: RegexTokenizer) -> DataFrame:
    """``_shard, _id, _full, _n`` in (shard, id) order with ``_start`` (tokens before) and ``_i`` (rows before).

    Texts are range-partitioned once, tokenized once behind that exchange, and
    written with the running sums of their partition; the sums of the
    partitions before (one row for each partition) are added on reading.
    """
    spark = base.sparkSession
    ids = tokenizer.ids(F.coalesce(F.col("_text"), F.lit("")))
    ordered = (base.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_shard", "_id")
               .sortWithinPartitions("_shard", "_id")
               .select("_shard", "_id", F.concat(F.array(F.lit(tokenizer.bos_id)), ids, F.array(F.lit(tokenizer.eos_id))).alias("_full"))
               .withColumn("_n", F.size("_full").cast("long")))
    return with_running_starts(ordered, "ordered-tokens")


def stream_pack(docs: DataFrame, text_col: str, id_col: str, seq_len: int,
                shard_col: str | None = None, tokenizer: RegexTokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """TOK4: BOS+EOS around each text, concatenate per shard in ``id_col`` order,
    cut into non-overlapping chunks of ``seq_len + 1``; ``input = x[:-1]``,
    ``label = x[1:]``; the remainder at the end of a shard is dropped (see
    ``dropped_tokens``).  A null text is an empty one.

    Output: ``shard, chunk, input, label, doc_ids``.
    """
    shard = F.col(shard_col) if shard_col else F.lit(0)
    base = docs.select(shard.alias("_shard"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _cut_windows(_ordered_tokens(base, tokenizer), seq_len)


def stream_pack_ranks(docs: DataFrame, text_col: str, id_col: str, seq_len: int, world_size: int,
                      tokenizer: RegexTokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """TOK4 + MIX16 fused: contiguous rank shards of ``id_col`` order, each packed
    into windows of ``seq_len + 1``; the shard follows from the row number.
    Same output as ``shard_contiguous`` followed by ``stream_pack(..., shard_col="shard")``.
    """
    return _cut_windows(rank_tokens(docs, text_col, id_col, world_size, tokenizer), seq_len)


def rank_tokens(docs: DataFrame, text_col: str, id_col: str, world_size: int, tokenizer: RegexTokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """``_shard, _id, _full, _n, _start, _i``: BOS + ids + EOS in ``id_col`` order, cut into contiguous rank shards."""
    base = docs.select(F.lit(0).alias("_shard"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ordered = _ordered_tokens(base, tokenizer)
    div, mod = divmod(ordered.count(), world_size)
    big, i = (div + 1) * mod, F.col("_i")
    shard = F.when(i < big, F.floor(i / F.lit(div + 1))).otherwise(F.lit(mod) + F.floor((i - F.lit(big)) / F.lit(max(div, 1))))
    return ordered.withColumn("_shard", shard.cast("int"))


def _shard_starts(ordered: DataFrame, width: int) -> DataFrame:
    """First token and number of whole windows of every shard (shards are runs of the order)."""
    return ordered.groupBy("_shard").agg(F.min("_start").alias("_s0"), F.floor(F.sum("_n") / F.lit(width)).alias("_chunks"))


def dropped_tokens(docs: DataFrame, text_col: str, id_col: str, seq_len: int, shard_col: str | None = None,
                   tokenizer: RegexTokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """Tokens at the end of each shard that fill no window: ``shard, dropped``."""
    shard = F.col(shard_col) if shard_col else F.lit(0)
    n = tokenizer.count(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(2)
    return (docs.select(shard.alias("shard"), n.alias("n")).groupBy("shard")
            .agg(F.pmod(F.sum("n"), F.lit(seq_len + 1)).cast("long").alias("dropped")))


def _cut_windows(ordered: DataFrame, seq_len: int) -> DataFrame:
    """Cut each document's token array at the window edges and put the pieces of a window together."""
    width = seq_len + 1
    starts = _shard_starts(ordered.select("_shard", "_start", "_n"), width).withColumnRenamed("_shard", "_s")
    # a row for each shard: joined by key, all tokens of a shard would meet in one task
    spans = (ordered.join(F.broadcast(starts), F.col("_shard").eqNullSafe(F.col("_s")))
             .withColumn("_start", F.col("_start") - F.col("_s0"))
             .withColumn("_c0", F.floor(F.col("_start") / width))
             .withColumn("_c1", F.least(F.floor((F.col("_start") + F.col("_n") - 1) / width), F.col("_chunks") - 1))
             .where(F.col("_c0") <= F.col("_c1")))

    def piece(c):
        lo = F.greatest(F.col("_start"), c * width) - F.col("_start")
        hi = F.least(F.col("_start") + F.size("_full"), (c + 1) * width) - F.col("_start")
        return F.struct(c.alias("chunk"), F.slice("_full", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_p"))

    pieces = (spans.select("_shard", "_id", "_start", F.explode(F.transform(F.sequence("_c0", "_c1"), piece)).alias("_q"))
              .select("_shard", "_id", "_start", F.col("_q.chunk").alias("chunk"), F.col("_q._p").alias("_p")))
    packed = (pieces.groupBy("_shard", "chunk")
              .agg(F.array_sort(F.collect_list(F.struct("_start", "_id", "_p"))).alias("_ps"))
              .select(F.col("_shard").alias("shard"), "chunk",
                      F.flatten(F.transform("_ps", lambda p: p["_p"])).alias("_x"),
                      F.transform("_ps", lambda p: p["_id"]).alias("doc_ids")))
    return packed.select("shard", "chunk", F.slice("_x", 1, seq_len).alias("input"),
                         F.slice("_x", 2, seq_len).alias("label"), "doc_ids")


# --------------------------------------------------------------------------- TOK7/TOK8 padding

def pad_fixed(ids: Column, length: int, pad_id: int = 0) -> Column:
    """TOK8: right-pad (after truncating) to exactly ``length``; callers flag the longer rows (``size(ids) > length``)."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(cut)))


def pad_batches(df: DataFrame, ids_col: str, order_cols: Sequence[str], batch_size: int,
                pad_id: int = 0) -> DataFrame:
    """TOK7: pad each contiguous batch to its longest member, with an attention mask.

    Only ``(key, length)`` is indexed and windowed (a window over one batch is
    bounded by ``batch_size``); the token rows are joined back once.
    """
    lengths = df.select(*order_cols, F.size(ids_col).alias("_len"))
    idx = with_row_index(lengths, order_cols, name="_i").withColumn("batch", F.floor(F.col("_i") / batch_size))
    per_row = idx.select(*order_cols, "batch", F.max("_len").over(Window.partitionBy("batch")).alias("batch_len"))
    out = df.join(per_row, list(order_cols)).withColumn("_len", F.size(ids_col))
    missing = F.col("batch_len") - F.col("_len")
    # both outputs come from the original ids (the column may itself be called input_ids)
    return (out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_len")),
                                                      F.array_repeat(F.lit(0), missing)))
            .withColumn("input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), missing)))
            .drop("_len"))


def leak_batches(records: DataFrame, order_cols: Sequence[str], batch_size: int, pad_id: int = 0,
                 max_bad_tokens: int | None = 4) -> DataFrame:
    """TOK7 for leak-correction records: batch padding plus fixed-width bad-token lists.

    ``bad_token_ids`` is cut and padded with 0 to ``max_bad_tokens`` (None: padded to the longest list of the
    batch) with a float ``bad_mask``; a missing or zero good id becomes -100 (ignored).
    """
    padded = pad_batches(records, "input_ids", order_cols, batch_size, pad_id)
    if max_bad_tokens is None:
        bad = F.col("bad_token_ids")
        width = F.max(F.size("bad_token_ids")).over(Window.partitionBy("batch"))
    else:
        bad, width = F.slice("bad_token_ids", 1, max_bad_tokens), F.lit(max_bad_tokens)
    padded = padded.withColumn("_width", width)
    missing = F.col("_width") - F.size(bad)
    good = F.when(F.coalesce(F.col("good_token_id"), F.lit(0)) != 0, F.col("good_token_id")).otherwise(F.lit(-100))
    return (padded.withColumn("bad_mask", F.concat(F.array_repeat(F.lit(1.0), F.size(bad)),
                                                   F.array_repeat(F.lit(0.0), missing)))
            .withColumn("bad_token_ids", F.concat(bad, F.array_repeat(F.lit(0), missing)))
            .withColumn("good_token_id", good.cast("long")).drop("_width"))


# --------------------------------------------------------------------------- TOK9-11 planning

# The configuration matrix (epochs, batch size, name).
CONFIGURATIONS = [
    (1, 32, "Quick test (1 epoch, small batch)"),
    (3, 32, "Small batch training"),
    (3, 128, "Medium batch training"),
    (3, 512, "Default configuration (current scripts)"),
    (5, 512, "Extended training"),
    (1, 1, "Single sample debugging"),
]
# Suggested batch sizes (3 epochs).
SUGGESTED_BATCHES = [1, 8, 16, 32, 64, 128, 256, 512]


def step_plan(n_samples: Column, epochs: int, batch: int, min_save: int = 100, evals: int | None = None) -> Column:
    """TOK9: ``struct<steps_floor, steps_ceil, save_interval, steps_per_epoch, eval_interval>``."""
    total = n_samples * F.lit(epochs)
    floor_steps = F.floor(total / F.lit(batch)).cast("long")
    ceil_steps = F.ceil(total / F.lit(batch)).cast("long")
    save = F.greatest(F.floor(floor_steps / F.lit(epochs)).cast("long"), F.lit(min_save).cast("long"))
    per_epoch = F.greatest(F.floor(n_samples / F.lit(batch)).cast("long"), F.lit(1).cast("long"))
    fields = [floor_steps.alias("steps_floor"), ceil_steps.alias("steps_ceil"), save.alias("save_interval"),
              per_epoch.alias("steps_per_epoch")]
    if evals:
        fields.append(F.greatest(F.lit(1.0), floor_steps / F.lit(epochs * evals)).alias("eval_interval"))
    return F.struct(*fields)


def config_matrix(counts: DataFrame, n_col: str = "n_samples") -> DataFrame:
    """TOK10: every configuration for every count row, with steps, save interval and status."""
    cfg = F.array(*[F.struct(F.lit(e).alias("epochs"), F.lit(b).alias("batch_size"), F.lit(nm).alias("name"))
                    for e, b, nm in CONFIGURATIONS])
    x = counts.select("*", F.explode(cfg).alias("cfg")).select("*", "cfg.*").drop("cfg")
    steps = F.floor(F.col(n_col) * F.col("epochs") / F.col("batch_size")).cast("long")
    status = (F.when(F.col("steps") == 0, F.lit("no training")).when(F.col("steps") < 10, F.lit("very short"))
              .when(F.col("steps") < 100, F.lit("short")).otherwise(F.lit("good")))
    return (x.withColumn("steps", steps)
            .withColumn("save_interval", F.when(F.col("steps") > 0, F.greatest(
                F.floor(F.col("steps") / F.col("epochs")).cast("long"), F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long")))
            .withColumn("status", status))


def size_tier(n: Column) -> Column:
    """TOK11: dataset size tier."""
    return (F.when(n == 0, F.lit("empty")).when(n < 100, F.lit("very small")).when(n < 1000, F.lit("small"))
            .when(n < 10000, F.lit("moderate")).otherwise(F.lit("large")))


def batch_suggestions(counts: DataFrame, n_col: str = "n_samples", epochs: int = 3) -> DataFrame:
    """TOK11: steps for each suggested batch size (``(n*3)//batch``)."""
    return (counts.select("*", F.explode(F.array(*[F.lit(b) for b in SUGGESTED_BATCHES])).alias("batch_size"))
            .withColumn("steps", F.floor(F.col(n_col) * F.lit(epochs) / F.col("batch_size")).cast("long"))
            .withColumn("tier", size_tier(F.col(n_col))))


# --------------------------------------------------------------------------- TOK13/TOK14 artifacts

def merges_count(spark, path: str) -> DataFrame:
    """TOK13: merge rules = non-blank lines not starting with ``#``."""
    lines = spark.read.text(path)
    return lines.agg(F.count_if((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#")).alias("merges"))


def vocab_count(spark, path: str) -> DataFrame:
    """TOK13: number of entries of a ``token -> id`` JSON object."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.size(F.from_json("value", T.MapType(T.StringType(), T.LongType()))).alias("vocab_size"))


def completeness(spark, directory: str, required: Sequence[str]) -> DataFrame:
    """TOK14: required artifact names left-joined with the directory listing (path, size)."""
    # a table may be a folder of files: a name's size is that of all files below it
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    below = F.regexp_replace("path", "^.*?" + re.escape("/" + directory.rstrip("/").rpartition("/")[2] + "/"), "")
    listing = files.withColumn("name", at(F.split(below, "/"), 1)).groupBy("name").agg(F.sum("length").alias("length"))
    need = spark.createDataFrame([(r,) for r in required], "name string")
    return (need.join(listing, "name", "left")
            .select("name", F.col("length").alias("size"), F.col("length").isNotNull().alias("present")))
