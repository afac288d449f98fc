"""Pipeline C: raw judge outputs (JSONL) -> validated results + summary
(`spark-submit examples/judge_results.py RAW_DIR OUT_DIR`).

Each input line holds ``id, model, prompt, response_a, response_b,
raw_response``.  Malformed lines go to a side table; rows whose extraction
fails are kept apart (``errors``) so a later run can retry exactly those ids.
"""

import sys

from turnstile.operators import judge
from turnstile.session import get_session
from turnstile.sources import readers, sinks
from turnstile.streaming.judge_stream import RAW_RESPONSE


def main(raw_dir: str, out_dir: str) -> None:
    spark = get_session()
    raw, bad_lines = readers.read_jsonl_tolerant(spark, raw_dir, RAW_RESPONSE)
    results, errors = judge.judge_rows(raw, on_error="side", keep=("id", "model"))
    sinks.write_parquet(results, f"{out_dir}/results")
    sinks.write_parquet(errors, f"{out_dir}/errors")
    sinks.write_parquet(bad_lines, f"{out_dir}/bad_lines")
    judge.verdict_summary(spark.read.parquet(f"{out_dir}/results")).show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
