"""Exact row positions and running sums without a single-task window.

``Window.orderBy(...)`` with no (or a skewed) ``partitionBy`` moves every row
of a group into one task.  Percent slices (MIX1), contiguous splits and
shards (MIX13/MIX16), row ids in reports (AGG6) and stream packing offsets
(TOK4) all need an exact position inside a possibly huge group, so they use
the classic two-pass scheme instead:

1. range-partition on ``(group, order)`` and sort inside partitions - Spark
   samples the key distribution, so one hot group is split over many tasks;
2. tag each row with ``monotonically_increasing_id`` (partition id in the
   high bits, position in the partition in the low bits) and write the tagged
   keys as a table in the shared checkpoint folder, which pins those ids if
   an executor is lost and a stage re-runs;
3. aggregate a tiny ``(group, partition) -> count/sum`` table, turn it into
   per-partition offsets with a window over that small table, and join it
   back (the optimizer chooses the join by its size in bytes).

Only the key columns the caller passes in are shuffled; callers project
before calling.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Key rows per range partition (keys are a few tens of bytes: ~100 MB per task);
# small inputs are not spread thinner than MIN_ROWS_PER_PARTITION per task.
ROWS_PER_PARTITION = 4_000_000
MIN_ROWS_PER_PARTITION = 50_000


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _tagged(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
            partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    keys = [*group_cols, *order_cols]
    # The range partitioner samples its input in a separate pass; the (narrow)
    # keys are written once, so that pass and the shuffle read them from there.
    src = materialize(df, "row-index-keys")
    n = partitions
    if n is None:
        rows = src.count()                      # from the Parquet footers
        default = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = max(-(-rows // ROWS_PER_PARTITION), min(default, -(-rows // MIN_ROWS_PER_PARTITION)), 1)
    ranged = src.repartitionByRange(n, *_cols(keys)).sortWithinPartitions(*_cols(keys))
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    return materialize(tagged, "row-index")


def _attach(tagged: DataFrame, stats: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    keys = [*group_cols, "_pid"]
    renamed = stats.select(*[F.col(k).alias(f"_r{k}") for k in keys],
                           *[c for c in stats.columns if c not in keys])
    cond = None
    for k in keys:
        c = tagged[k].eqNullSafe(renamed[f"_r{k}"])
        cond = c if cond is None else cond & c
    joined = tagged.join(renamed, cond, "inner")
    return joined.drop(*[f"_r{k}" for k in keys])


def with_row_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                   name: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position of each row inside its group in ``order_cols`` order.

    ``order_cols`` must make the order total inside a group (add a unique key).
    """
    tagged = _tagged(df, group_cols, order_cols, partitions)
    stats = tagged.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    out = _attach(tagged, stats.select(*group_cols, "_pid", "_off", "_first"), group_cols)
    return (out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_off", "_first"))


def with_prefix_sum(df: DataFrame, value_col: str | Sequence[str], order_cols: Sequence[str],
                    group_cols: Sequence[str] = (), name: str | Sequence[str] = "prefix",
                    partitions: int | None = None) -> DataFrame:
    """Add ``name``: sum of ``value_col`` over the rows *before* this one in its group.

    Several value columns (and as many names) can be summed in the same pass.
    """
    values = [value_col] if isinstance(value_col, str) else list(value_col)
    names = [name] if isinstance(name, str) else list(name)
    tagged = _tagged(df, group_cols, order_cols, partitions)
    local_w = (Window.partitionBy(*group_cols, "_pid").orderBy("_mid")
               .rowsBetween(Window.unboundedPreceding, -1))
    local = tagged
    for i, v in enumerate(values):
        local = local.withColumn(f"_local{i}", F.coalesce(F.sum(v).over(local_w), F.lit(0)))
    stats = tagged.groupBy(*group_cols, "_pid").agg(*[F.sum(v).alias(f"_tot{i}") for i, v in enumerate(values)])
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    for i in range(len(values)):
        stats = stats.withColumn(f"_off{i}", F.coalesce(F.sum(f"_tot{i}").over(w), F.lit(0)))
    out = _attach(local, stats.select(*group_cols, "_pid", *[f"_off{i}" for i in range(len(values))]), group_cols)
    for i, nm in enumerate(names):
        out = out.withColumn(nm, F.col(f"_off{i}") + F.col(f"_local{i}"))
    return out.drop("_pid", "_mid", *[f"_off{i}" for i in range(len(values))],
                    *[f"_local{i}" for i in range(len(values))])


def _running_starts(batches):
    """Add the tokens and rows of the partition that come before each row (rows arrive in order)."""
    from pyspark import TaskContext

    part, tokens, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("_n").to_numpy()
        before = tokens + np.cumsum(n) - n
        columns = [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before),
                   pa.array(rows + np.arange(len(n)))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_before", "_row"])
        tokens, rows = tokens + int(n.sum()), rows + len(n)


def with_running_starts(ordered: DataFrame, name: str) -> DataFrame:
    """Add ``_start`` (sum of the long ``_n`` of all rows before) and ``_i`` (rows before) to rows in order over partitions.

    The rows are written once with the running sums of their partition; the sums of the partitions before (one row for
    each partition, broadcast) are added on reading, so rows may be wide and are not moved again.
    """
    schema = T.StructType([*ordered.schema.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_before", T.LongType()), T.StructField("_row", T.LongType())])
    stored = materialize(ordered.mapInArrow(_running_starts, schema), name)
    parts = stored.groupBy("_part").agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("r"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_t"),
                           F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("_r"))
    offsets = materialize(offsets, f"{name}-offsets")
    return (stored.join(F.broadcast(offsets), "_part")
            .select(*ordered.columns, (F.col("_t") + F.col("_before")).alias("_start"), (F.col("_r") + F.col("_row")).alias("_i")))
