"""Registered queries of the streaming feeds: resumable packing and judged answers that arrive again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import load_table
from ..streaming import answer_stream, pack_stream
from ..streaming.judge_stream import RAW_RESPONSE
from .catalog import _JUDGE_RAW_SQL, _PACK_SQL, _PACK_WORLD, _SEQ, _SHARD_SQL, _WORLD, _tok_count, raw_judge_responses, register

_RESTARTS, _FEED_EPOCHS = 3, 2


def _fed(spark: SparkSession, sf_dir: str, epochs: int) -> DataFrame:
    """Windows of the feed, taken in three batches by three queries that resume from one checkpoint."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    table = pack_stream.pack_table(docs, "text", "doc_id", _PACK_WORLD)
    longest = table.groupBy("rank").count().agg(F.max("count")).first()[0] or 1
    windows = pack_stream.pack_batches(table, scratch_path(spark, "feed-windows"), scratch_path(spark, "feed-checkpoint"),
                                       -(-longest * epochs // _RESTARTS), _SEQ, _RESTARTS, epochs)
    return windows.select("shard", "chunk", F.size("doc_ids").cast("long").alias("n_docs"),
                          F.array_min("doc_ids").alias("first_doc"), F.array_max("doc_ids").alias("last_doc"),
                          F.size("input").alias("input_len"), F.size("label").alias("label_len"), "epoch")


@register("resumable_pack", _PACK_SQL)
def resumable_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK4 with the position of every rank as streaming state: the windows of ``stream_pack``, over restarts."""
    return _fed(spark, sf_dir, 1).drop("epoch")


@register("resumable_pack_epochs", f"""WITH d AS (SELECT doc_id, {_tok_count('text')} + 2 AS n,
                  row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS cnt FROM documents),
s AS (SELECT doc_id, n, {_SHARD_SQL.replace('n //', 'cnt //').replace('n %', 'cnt %').replace(f'{_WORLD}', f'{_PACK_WORLD}')} AS shard FROM d),
e AS (SELECT s.*, unnest(range({_FEED_EPOCHS})) AS epoch FROM s),
p AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY shard ORDER BY epoch, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM e),
t AS (SELECT shard, CAST(sum(n) // {_SEQ + 1} AS BIGINT) AS nch FROM e GROUP BY shard),
sp AS (SELECT p.shard, p.doc_id, p.epoch, unnest(range(p.st // {_SEQ + 1}, least((p.st + p.n - 1) // {_SEQ + 1}, t.nch - 1) + 1)) AS chunk
       FROM p JOIN t USING (shard))
SELECT CAST(shard AS INTEGER) AS shard, chunk, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       {_SEQ} AS input_len, {_SEQ} AS label_len, max(epoch) AS epoch
FROM sp GROUP BY shard, chunk""")
def resumable_pack_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK4 + MIX14: two epochs, re-looped by the feed; windows run on from one epoch into the next."""
    return _fed(spark, sf_dir, _FEED_EPOCHS)


@register("answers_again", f"""WITH {_JUDGE_RAW_SQL}, r AS (
  SELECT id, CASE WHEN err THEN NULL WHEN form = 4 THEN 'same' ELSE verdict END AS verdict FROM jr)
SELECT id, 'stub-judge' AS model, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision,
       CASE WHEN id % 3 = 0 THEN 'same' ELSE verdict END AS verdict FROM r""")
def answers_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JDG11: all answers arrive, then arrive again beside changed ones for every third input, over two queries of one stream."""
    incoming, output, state = (scratch_path(spark, x) for x in ("answers", "answers-judged", "answers-state"))
    raw = raw_judge_responses(spark, sf_dir).select(*[f.name for f in RAW_RESPONSE.fields])
    changed = raw.where(F.pmod("id", F.lit(3)) == 0).withColumn("raw_response", F.lit("no verdict in here"))
    raw.repartition(2).write.json(f"{incoming}/a")
    answer_stream.start_answers(spark, f"{incoming}/*", output, state).awaitTermination()
    raw.where(F.pmod("id", F.lit(3)) > 0).repartition(1).write.json(f"{incoming}/b")
    changed.repartition(1).write.json(f"{incoming}/c")
    answer_stream.start_answers(spark, f"{incoming}/*", output, state).awaitTermination()
    return answer_stream.latest_results(spark, output).select("id", "model", "revision", "verdict")
