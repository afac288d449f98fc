"""Raw judge answers that may arrive again (JDG11): each is judged once, a changed one replaces the earlier.

Files of raw answers are delivered at least once: a sender repeats a file after an error, and a corrected answer comes in a
later one.  State keyed by (model, id) holds the hash and the number of the last answer seen, so

* an answer that is there already passes no further, whatever file it comes in;
* another answer for the same key passes with the next ``revision``, and readers take the highest one;
* keys that were quiet for ``keep`` are forgotten (``None``: never); an answer that arrives after that counts as changed
  only if the results don't hold it yet, since its revision starts again behind the one they hold.

What passes is judged by the Columns of the batch path and written by ``foreachBatch`` into the folder of its batch, which a
repeated batch overwrites: a batch that dies half-way leaves nothing double and nothing out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.judge import judge_rows
from .judge_stream import RAW_RESPONSE
from .pack_stream import _state_store

_SEEN = T.StructType([T.StructField("hash", T.LongType()), T.StructField("revision", T.LongType())])
NEW_ANSWERS = T.StructType([*RAW_RESPONSE.fields, T.StructField("revision", T.LongType())])


class LastAnswer(StatefulProcessor):
    """State of a key: the last answer's hash and how many different answers came."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, revision = self.seen.get() if self.seen.exists() else (None, 0)
        passed = None
        # rows of one batch have no order of their own: by file, then by content, so that a repeated batch agrees
        for row in pd.concat(list(rows)).sort_values(["file", "hash"]).itertuples(index=False):
            if row.hash != known:
                known, revision, passed = row.hash, revision + 1, row
        if passed is not None:
            self.seen.update((int(known), revision))
            yield pd.DataFrame([(*(getattr(passed, f.name) for f in RAW_RESPONSE.fields), revision)], columns=NEW_ANSWERS.names)

    def close(self) -> None:
        pass


def new_answers(spark: SparkSession, input_dir: str, keep_ms: int | None = None, schema: T.StructType = RAW_RESPONSE) -> DataFrame:
    """Streaming DataFrame of answers that are new or changed, with their ``revision``.

    Of several answers for one key in a batch the one of the last file counts.
    """
    content = [f.name for f in RAW_RESPONSE.fields if f.name not in ("id", "model")]
    raw = (spark.readStream.schema(schema).json(input_dir)
           .withColumn("file", F.col("_metadata.file_name")).withColumn("hash", F.xxhash64(*content)))
    return raw.groupBy("model", "id").transformWithStateInPandas(
        statefulProcessor=LastAnswer(keep_ms), outputStructType=NEW_ANSWERS, outputMode="Update",
        timeMode="None" if keep_ms is None else "ProcessingTime")


def start_answers(spark: SparkSession, input_dir: str, output: str, checkpoint: str, keep_ms: int | None = None) -> StreamingQuery:
    """Judge what is there and stop; a later start goes on from ``checkpoint``."""
    def write(batch: DataFrame, number: int) -> None:
        judged = judge_rows(batch, on_error="default", keep=("id", "model", "revision"))
        judged.write.mode("overwrite").parquet(f"{output}/batch={number}")

    with _state_store(spark):
        return (new_answers(spark, input_dir, keep_ms).writeStream.foreachBatch(write).outputMode("update")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_results(spark: SparkSession, output: str) -> DataFrame:
    """One row for each (model, id): the result of its last answer."""
    rows = spark.read.parquet(output)
    whole = F.struct(*[c for c in rows.columns if c not in ("id", "model", "batch")])
    last = rows.groupBy("id", "model").agg(F.max_by(whole, F.struct("batch", "revision")).alias("r"))
    return last.select("id", "model", "r.*")
