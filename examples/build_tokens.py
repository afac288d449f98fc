"""Pipeline B/E: render -> token store -> packed sequences
(`spark-submit examples/build_tokens.py SF_DIR OUT_DIR [SEQ_LEN] [WORLD]`).

Writes the token store (``doc_idx, token_ids, n_tokens, status``), its
statistics, and ``input``/``label`` windows of ``SEQ_LEN`` per rank shard.
"""

import sys

from pyspark.sql import functions as F

from turnstile.operators import mix, render, tokens, turns
from turnstile.sources import sinks
from turnstile.sources.tables import load_table, nest_turns
from turnstile.session import get_session


def main(sf_dir: str, out_dir: str, seq_len: int = 2048, world: int = 8) -> None:
    spark = get_session()
    conv = nest_turns(turns.normalize_flat(load_table(spark, sf_dir, "conversations")))
    rendered = conv.withColumn("text", render.chatml_strict(F.col("conversations")))
    store = tokens.token_build(rendered, "text", "conv_id", conv_col="conversations")
    sinks.write_parquet(store, f"{out_dir}/token_store")
    stored = spark.read.parquet(f"{out_dir}/token_store")
    tokens.token_totals(stored).show()
    tokens.store_stats(stored).show()
    docs = mix.shard_contiguous(load_table(spark, sf_dir, "documents").select("doc_id", "text"), world, ["doc_id"])
    packed = tokens.stream_pack(docs, "text", "doc_id", seq_len, shard_col="shard")
    sinks.write_parquet(packed, f"{out_dir}/packed", partition_by=["shard"])


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *(int(x) for x in sys.argv[3:5]))
