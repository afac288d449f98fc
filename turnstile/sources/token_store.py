"""Token store with a dense document index (SNK8, TOK12).

``write_token_store`` keeps the documents that were tokenized, in their original order and numbered without gaps, in three
tables below one folder:

* ``data``: ``part, doc, offset, n_tokens, token_ids``; a part holds the documents that start in the same run of
  ``part_tokens`` tokens, so its size is bounded by tokens and not by documents.  Small parts share a folder
  (``part_folder``) of about ``FOLDER_TOKENS`` tokens, so the number of files follows the bytes and not the parts; files
  are sorted by document;
* ``index``: ``doc, offset`` of every document and of a sentinel behind the last one (its number is the count of documents,
  its offset the count of tokens), so a length is the difference of two neighbours;
* ``parts``: the first document and token of every part and their numbers: a row for each part.

Lookups of documents or of token ranges turn the range into the run of parts it touches with the ``parts`` table.
``part_folder`` is a partition column and ``part``/``doc``/``offset`` are ascending inside files, so Spark lists only
those folders and reads only the row groups whose statistics overlap.  The tables are written in this order and the sentinel is the last row of the
``index``; a store without its ``index`` was not finished.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import with_running_starts
from ..session import materialize

PART_TOKENS = 1 << 25
# Tokens of a folder of small parts, and the fewest for a task that orders them; documents for each file of the index.
FOLDER_TOKENS, TASK_TOKENS, INDEX_DOCS = 1 << 22, 1 << 18, 1 << 22


def write_token_store(store: DataFrame, path: str, order_cols: Sequence[str], ids_col: str = "token_ids",
                      part_tokens: int = PART_TOKENS, row_group_bytes: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Write the rows with ids in ``order_cols`` order (a unique key); returns ``processed, skipped, total_tokens``.

    Rows whose ids are null or empty are skipped and get no number.  ``keep`` are further columns of ``data``.  The ids are
    computed once and moved once, into their order.
    """
    spark = store.sparkSession
    keys = [f"_k{i}" for i in range(len(order_cols))]
    ids = F.when(F.size(ids_col) > 0, F.col(ids_col))
    named = store.select(*[F.col(c).alias(k) for c, k in zip(order_cols, keys)], ids.alias("token_ids"), *keep)
    named = materialize(named.withColumn("_n", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("long")), "token-store-rows")
    total, documents, skipped = named.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long"), F.count("_n"), F.count_if(F.col("_n").isNull())).first()
    tasks = max(-(-total // FOLDER_TOKENS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_TOKENS)), 1)
    ordered = named.where(F.col("_n").isNotNull()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop(*keys)
    placed = (with_running_starts(ordered, "token-store-places")
              .withColumn("part", F.floor(F.col("_start") / part_tokens))
              .select("part", F.col("_i").alias("doc"), F.col("_start").alias("offset"), F.col("_n").alias("n_tokens"), "token_ids", *keep))
    folder = F.floor(F.col("part") / max(1, FOLDER_TOKENS // part_tokens))
    w = placed.withColumn("part_folder", folder).sortWithinPartitions("part_folder", "doc").write.partitionBy("part_folder")
    (w.option("parquet.block.size", row_group_bytes) if row_group_bytes else w).parquet(f"{path}/data")
    parts = placed.groupBy("part").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("docs"), F.min("offset").alias("first_token"),
                                       F.sum("n_tokens").alias("tokens"), F.first(folder).alias("part_folder"))
    parts.repartition(1).sortWithinPartitions("part").write.parquet(f"{path}/parts")
    end = spark.range(1).select(F.lit(documents).cast("long").alias("doc"), F.lit(total).cast("long").alias("offset"))
    (placed.select("doc", "offset").unionByName(end).repartitionByRange(max(1, -(-documents // INDEX_DOCS)), "doc").sortWithinPartitions("doc")
     .write.parquet(f"{path}/index"))
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for n, c in ((documents, "processed"), (skipped, "skipped"), (total, "total_tokens"))])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc, offset``, the sentinel included."""
    return spark.read.parquet(f"{path}/index")


def _data(spark: SparkSession, path: str, touched: Column) -> DataFrame:
    """Rows of the folders that hold the run of parts that a condition on (first_doc, docs, first_token, tokens) picks."""
    lo, hi = spark.read.parquet(f"{path}/parts").where(touched).agg(F.min("part_folder"), F.max("part_folder")).first()
    data = spark.read.schema("doc long, offset long, n_tokens long, token_ids array<int>, part_folder long, part long").parquet(f"{path}/data")
    return data.where(F.lit(False) if lo is None else F.col("part_folder").between(lo, hi))


def get_documents(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """``doc, offset, n_tokens, token_ids`` of the documents [start, end)."""
    touched = (F.col("first_doc") < end) & (F.col("first_doc") + F.col("docs") > start)
    return (_data(spark, path, touched).where((F.col("doc") >= start) & (F.col("doc") < end))
            .select("doc", "offset", "n_tokens", "token_ids"))


def get_tokens(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """``doc, first, token_ids``: the tokens [start, end) of the whole stream, by document; ``first`` is the place of the
    first returned token in the stream."""
    # a document may run on beyond its part, so the last one that starts before ``start`` may lie in an earlier part
    last = document_index(spark, path).where(F.col("offset") <= start).agg(F.max("offset")).first()[0] or 0
    touched = (F.col("first_token") < end) & (F.col("first_token") + F.col("tokens") > last)
    rows = _data(spark, path, touched).where((F.col("offset") < end) & (F.col("offset") >= last) & (F.col("offset") + F.col("n_tokens") > start))
    lo = F.greatest(F.col("offset"), F.lit(start))
    hi = F.least(F.col("offset") + F.col("n_tokens"), F.lit(end))
    return rows.where(lo < hi).select("doc", lo.alias("first"), F.slice("token_ids", (lo - F.col("offset") + 1).cast("int"),
                                                                        (hi - lo).cast("int")).alias("token_ids"))


def first_lengths(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """``doc, n_tokens`` of the first documents, from the index alone: the differences of ``n + 1`` pointers."""
    pointers = document_index(spark, path).where(F.col("doc") <= n)
    after = pointers.select((F.col("doc") - 1).alias("doc"), F.col("offset").alias("next"))
    return pointers.join(after, "doc").select("doc", (F.col("next") - F.col("offset")).alias("n_tokens"))


def index_stats(spark: SparkSession, path: str, token_bytes: int = 4) -> DataFrame:
    """TOK12 from the index: documents (without the sentinel), tokens, tokens a document, bytes."""
    return (document_index(spark, path).agg((F.count(F.lit(1)) - 1).alias("documents"), F.max("offset").alias("tokens"))
            .withColumn("avg_tokens", F.col("tokens") / F.nullif("documents", F.lit(0)))
            .withColumn("bytes", F.col("tokens") * token_bytes))


def is_finished(spark: SparkSession, path: str) -> bool:
    """Was the store written to its end?  (The index comes last, and Spark marks a finished table.)"""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index/_SUCCESS")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
