"""Corpus pipeline over the ``documents`` table.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame: rows whose
language can't be told go; one document of each near-duplicate group stays;
documents with benchmark passages go; sources are mixed to target weights
(documents leave or repeat); the rest is placed into shards of equal bytes.
All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import decontaminate as D
from turnstile.llm import jaccard as J
from turnstile.llm import language as L
from turnstile.llm import mixing as M
from turnstile.llm import sharding as S
from turnstile.session import materialize
from turnstile.sources.tables import load_table

MIX_WEIGHTS, MIX_EPOCHS, SHARDS = (1, 2, 3), 3, 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID with the declared language and the source as host; rejected documents go."""
    model = L.train_text(docs)
    found = L.identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), model, "in_text",
                       F.col("in_source"), F.col("in_lang"))
    return found.where("accepted").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; the document with the smallest id of each group stays."""
    return J.keep_one(docs, J.jaccard_components(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return D.decontaminate(docs, D.build_index(load_table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    _, plan = M.mix_plan(docs, MIX_WEIGHTS, MIX_EPOCHS)
    return M.mix_documents(docs, plan)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    return S.shard_documents(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

# The language model and the hashes of the sharding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each result is written as Parquet and reread as the next one's documents."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
