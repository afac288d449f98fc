"""Pipeline A: SFT mix -> JSONL (`spark-submit examples/build_sft_mix.py SF_DIR OUT_DIR`).

Reads the driver ``conversations`` table in two layouts, applies the recipe in
``turnstile.plans.catalog.SFT_RECIPE`` (load-time slices, role mapping,
clean rebuild, seeded order) and writes ``{"conversations": [...]}`` lines.
"""

import sys

from turnstile.operators import mix
from turnstile.plans import catalog, recipes
from turnstile.session import get_session, scratch
from turnstile.sources import sinks


def main(sf_dir: str, out_dir: str, shards: int | None = None) -> None:
    spark = get_session()
    with scratch(spark):
        recipe = catalog.SFT_RECIPE
        mixed, status = recipes.build_conversation_mix(spark, recipe, catalog._layout_reader(sf_dir))
        status.show(truncate=False)
        order = ["source", *recipe.order_cols]
        key = mix.shuffle_key(order, recipe.seed)
        if shards:          # consecutive ranges of the seeded order, so reading the shards in turn gives the mix
            mixed = mixed.repartitionByRange(shards, key, *order).sortWithinPartitions(key, *order)
        sinks.write_jsonl(mixed.select("conversations"), f"{out_dir}/sft.jsonl")
        sinks.write_summary_csv(status, f"{out_dir}/source_status")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else None)
