"""Registered queries of the pipeline operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import load_table
from . import bloomlm as B
from . import decontaminate as D
from . import hardneg as H
from . import jaccard as J
from . import language as L
from . import mixing as M
from . import quality as Q
from . import repair as R
from . import secretscan as X
from . import sharding as S
from . import tokencounts as C
from . import tokenstore as T
from . import url_labels
from . import urlfilter as U
from .oracles import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


MIX_WEIGHTS, MIX_EPOCHS = (1, 2, 3), 3
SHARDS = 24


@_query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = B.LanguageModel(docs.where(~B.held_out("doc_id")))
    return model.score(docs).withColumn("held_out", B.held_out("doc_id"))


@_query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mix_report(*M.mix_plan(load_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS))


@_query
def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id", "text", S.row_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = S.shard_documents(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = (U.Rule("com", "/", "allow"), U.Rule("example.com", "/en/", "block"),
             U.Rule("www.example.com", "/en/", "allow"), U.Rule("net", "/es/", "block"), U.Rule("net", "/fr/", "block"))


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    ruled = U.labelled_by_rules(pages, URL_RULES)
    listed = spark.createDataFrame(url_labels.labelled_urls(), "host string, path string, block double")
    return U.judge_urls(pages, URL_RULES, ruled.unionByName(listed))


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = L.train_text(load_table(spark, sf_dir, "documents"))
    pages = load_table(spark, sf_dir, "pages")
    host = U.host_of("url")
    found = L.identify(pages.select("page_id", "url", "html"), model, L.visible_text("html"), host,
                       L.markup_language("html"), L.suffix_of(host), keep=("page_id", "url"))
    return found.select("page_id", U.host_of("url").alias("host"), "language", "posterior", "accepted")


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.quality_rules(load_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.jaccard_components(load_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scan_secrets(load_table(spark, sf_dir, "documents"))


@_query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-store")
    T.write_tokens(load_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return T.read_digest(spark, path)


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = D.build_index(load_table(spark, sf_dir, "benchmark"))
    found = D.scan_documents(load_table(spark, sf_dir, "documents"), segments)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        D.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return C.count_tokens(load_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repair_report(R.damage(load_table(spark, sf_dir, "conversations")), gone=F.col("dropped"))


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = load_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return H.hard_negatives(rows, F.col("vec_id") % 100 == 0)


__all__ = ["ORACLE", "QUERIES"]
