"""Pipeline D: preference mix -> JSONL (`spark-submit examples/build_dpo_mix.py SF_DIR OUT_DIR`).

Pairs are derived from the driver conversations (prompt = all but the last
turn, chosen = last assistant turn, rejected = the next conversation's first
assistant turn), mixed from a full-layout source and a 20 % message-layout
source, ordered by a seeded hash and written as ``{"chosen", "rejected"}``
lines (ASCII-escaped, like the original writer).
"""

import sys

from pyspark.sql import functions as F

from turnstile.operators import mix, prefs
from turnstile.plans import catalog, recipes
from turnstile.session import get_session
from turnstile.sources import sinks


def main(sf_dir: str, out_dir: str) -> None:
    spark = get_session()
    pairs = prefs.pairs_from_conversations(catalog.normalized(spark, sf_dir))
    full = prefs.append_pairs(pairs).withColumnRenamed("conv_id", "id").withColumn("source", F.lit("full"))
    message = (prefs.append_pairs(mix.slice_rows(pairs, "train[:20%]", ["conv_id"]), layout="message")
               .withColumnRenamed("conv_id", "id").withColumn("source", F.lit("message")))
    mixed = recipes.build_preference_mix([full, message])
    sinks.write_jsonl(mixed.select("chosen", "rejected"), f"{out_dir}/dpo.jsonl", ascii_only=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
