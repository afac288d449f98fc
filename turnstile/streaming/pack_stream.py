"""Resumable stream packing (TOK4 + MIX14): a training feed that can stop after any batch.

The batch operator ``tokens.stream_pack_ranks`` cuts a whole corpus at once.  A training job reads the same windows one
batch at a time, over as many epochs as it likes, and must go on where it stopped: its position is the number of samples
taken and the tokens that have not filled a window yet.  Here that position is the state of a streaming query, one value
for the open block of each rank, kept by ``transformWithState`` under the query's checkpoint:

* a counter source (``rate-micro-batch``) gives every micro-batch the next run of sample numbers; on a restart it goes on
  from the offset of the checkpoint;
* sample number ``v`` of a rank is its document ``v mod len`` in epoch ``v div len``, so epochs are re-looped without
  copies of the corpus and without an end (``epochs=None``) or up to a number of them;
* the numbers of a batch (at most ``rows_per_batch`` for each rank) are runs of numbers, joined to the token table, which is
  stored once in order of its positions; a run takes a row for each ``_SPAN`` of its samples in the side that is broadcast;
* the table also holds the place of a document's first token in its rank, so a sample's place in the endless stream of the
  rank is known and it is cut at the edges of *blocks*, runs of whole windows of about ``block_tokens`` tokens;
* the processor appends the pieces of a block in order to its tokens left over and emits full windows.  Its memory is that
  of a block, blocks go to all tasks, and only blocks that a batch leaves unfinished (the last one of each rank) keep
  state; tokens of one epoch run on into the next one, as in the batch operator over repeated documents;
* windows go to a Parquet sink with its own commit log, so a batch that dies half-way is run again and appears once.

A checkpoint belongs to a table, ``seq_len`` and ``block_tokens``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.tokenize import DEFAULT_TOKENIZER, RegexTokenizer
from ..operators.tokens import rank_tokens
from ..session import materialize

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOWS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()),
    T.StructField("input", T.ArrayType(T.IntegerType())), T.StructField("label", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("epoch", T.LongType()),
])
# Tokens of a block (whole windows), samples of a rank for each row that is broadcast, bytes of a batch sent to Python.
BLOCK_TOKENS, _SPAN, _BATCH_BYTES = 1 << 16, 1000, 1 << 24
# next: place of the next token in the rank's stream; docs/held: documents with tokens left over and how many of them
_POSITION = T.StructType([
    T.StructField("next", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())),
    T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.IntegerType())),
])


class PackProcessor(StatefulProcessor):
    """State of an open block of a rank: its position and the tokens that fill no window yet (fewer than ``seq_len + 1``)."""

    def __init__(self, seq_len: int, windows: int):
        self.width, self.windows = seq_len + 1, windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", _POSITION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank, block = int(key[0]), int(key[1])
        batch = pd.concat(list(rows)).sort_values("pos")
        first = block * self.windows * self.width
        opened = self.position.exists()
        following, tokens, docs, held = self.position.get() if opened else (first, [], [], [])
        sizes = batch["ids"].map(len).to_numpy(np.int64)
        ends = batch["pos"].to_numpy(np.int64) + sizes
        for expected, found in zip([following, *ends[:-1].tolist()], (ends - sizes).tolist()):
            if found != expected:
                raise ValueError(f"rank {rank}: token {expected} is missing, found {found}")
        begin = following - len(tokens)                     # a window starts here
        stream = np.concatenate([np.array(tokens, np.int32), *batch["ids"]])
        docs = [*docs, *(None if pd.isna(d) else int(d) for d in batch["doc"])]
        epochs = [*([-1] * len(held)), *batch["epoch"].tolist()]        # a window ends in a piece that came just now
        upto = np.cumsum([*held, *sizes.tolist()])
        full = len(stream) // self.width
        edges = np.arange(full + 1) * self.width
        opening, closing = np.searchsorted(upto, edges, "right"), np.searchsorted(upto, edges - 1, "right")
        out = []
        for w in range(full):
            ids, a, z = stream[edges[w]:edges[w + 1]], opening[w], closing[w + 1]
            out.append((rank, begin // self.width + w, ids[:-1], ids[1:], docs[a:z + 1], int(epochs[z])))
        following, rest, cut = int(ends[-1]), opening[full], edges[full]
        if following < first + self.windows * self.width:
            left = np.diff(np.maximum(upto[rest:], cut), prepend=cut)
            self.position.update((following, stream[cut:].tolist(), docs[rest:], left.tolist()))
        elif opened:
            self.position.clear()
        yield pd.DataFrame(out, columns=WINDOWS.names)

    def close(self) -> None:
        pass


def pack_table(docs: DataFrame, text_col: str, id_col: str, world_size: int,
               tokenizer: RegexTokenizer = DEFAULT_TOKENIZER) -> DataFrame:
    """``rank, i, doc, ids, first, n``: every document's BOS + ids + EOS at its position in the contiguous shard of a rank;
    ``first`` counts the rank's tokens before it, ``n`` its own.

    Written once, in order; the feed of every epoch reads it.  Ids are unique (they are the order).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ordered = rank_tokens(docs, "text", "doc", world_size, tokenizer)
    begins = materialize(ordered.groupBy("_shard").agg(F.min("_i").alias("_i0"), F.min("_start").alias("_s0")), "pack-ranks")
    return (ordered.join(F.broadcast(begins), "_shard")             # a row for each rank
            .select(F.col("_shard").alias("rank"), (F.col("_i") - F.col("_i0")).alias("i"), F.col("_id").alias("doc"),
                    F.col("_full").alias("ids"), (F.col("_start") - F.col("_s0")).alias("first"), F.col("_n").alias("n")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last number of the runs of consecutive numbers in each batch of a counter."""
    for batch in batches:
        v = batch.column(0).to_numpy()
        if len(v):
            ends = np.append(np.flatnonzero(np.diff(v) != 1), len(v) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(v[np.append(0, ends[:-1] + 1)]), pa.array(v[ends])], ["lo", "hi"])


def pack_feed(table: DataFrame, rows_per_batch: int, seq_len: int, epochs: int | None = 1,
              block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Streaming DataFrame of windows: ``shard, chunk, input, label, doc_ids, epoch`` (of the window's last sample)."""
    spark = table.sparkSession
    windows = max(1, block_tokens // (seq_len + 1))
    width = F.lit(windows * (seq_len + 1)).cast("long")
    lengths = table.groupBy("rank").agg(F.count(F.lit(1)).alias("len"), F.sum("n").alias("total"))      # a row for each rank
    ranks = spark.createDataFrame(lengths.toArrow())
    counter = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
               .option("numPartitions", 1).load().select("value").mapInArrow(_runs, "lo long, hi long")
               .withColumn("one", F.lit(1)))
    last = F.expr("hi div len") if epochs is None else F.least(F.expr("hi div len"), F.lit(epochs - 1).cast("long"))
    asked = counter.join(F.broadcast(ranks.withColumn("one", F.lit(1))), "one").withColumn("e0", F.expr("lo div len"))
    if epochs is not None:
        asked = asked.where(F.col("e0") < epochs)
    asked = (asked.select("rank", "len", "total", "lo", "hi", F.explode(F.sequence("e0", last)).alias("epoch"))
             .select("rank", "epoch", (F.col("epoch") * F.col("total")).alias("before"),
                     F.greatest(F.expr("lo - epoch * len"), F.lit(0).cast("long")).alias("i0"),
                     F.least(F.expr("hi - epoch * len"), F.expr("len - 1")).alias("i1"))
             .select("*", F.explode(F.sequence(F.expr(f"i0 div {_SPAN}"), F.expr(f"i1 div {_SPAN}"))).alias("span")))
    samples = (table.withColumn("span", F.expr(f"i div {_SPAN}")).join(F.broadcast(asked), ["rank", "span"])
               .where((F.col("i") >= F.col("i0")) & (F.col("i") <= F.col("i1")))
               .select("rank", "epoch", "doc", "ids", "n", (F.col("before") + F.col("first")).alias("at")))
    blocks = F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("n") - 1) / width))
    pos, end = F.greatest(F.col("at"), F.col("block") * width), F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * width)
    pieces = (samples.select("*", F.explode(blocks).alias("block"))
              .select("rank", "block", "epoch", "doc", pos.alias("pos"),
                      F.slice("ids", (pos - F.col("at") + 1).cast("int"), (end - pos).cast("int")).alias("ids")))
    return pieces.groupBy("rank", "block").transformWithStateInPandas(
        statefulProcessor=PackProcessor(seq_len, windows), outputStructType=WINDOWS, outputMode="Append", timeMode="None")


@contextmanager
def _state_store(spark: SparkSession, **more: str):
    """transformWithState keeps its state in RocksDB; the setting (and ``more``) is read when a query starts."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, **more}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def start_pack(table: DataFrame, output: str, checkpoint: str, rows_per_batch: int, seq_len: int, epochs: int | None = 1,
               one_batch: bool = True, block_tokens: int = BLOCK_TOKENS) -> StreamingQuery:
    """Go on from ``checkpoint`` (or from the start), appending windows to ``output``.

    ``one_batch`` takes the next ``rows_per_batch`` samples of every rank and ends; else the query runs until stopped.
    """
    with _state_store(table.sparkSession, **{"spark.sql.execution.arrow.maxBytesPerBatch": str(_BATCH_BYTES)}):
        w = (pack_feed(table, rows_per_batch, seq_len, epochs, block_tokens).writeStream.format("parquet").option("path", output)
             .option("checkpointLocation", checkpoint).outputMode("append"))
        return (w.trigger(availableNow=True) if one_batch else w).start()


def pack_batches(table: DataFrame, output: str, checkpoint: str, rows_per_batch: int, seq_len: int, batches: int,
                 epochs: int | None = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Take ``batches`` batches, each by a query of its own that resumes from the checkpoint; all windows so far."""
    for _ in range(batches):
        start_pack(table, output, checkpoint, rows_per_batch, seq_len, epochs, block_tokens=block_tokens).awaitTermination()
    return table.sparkSession.read.schema(WINDOWS).parquet(output)
