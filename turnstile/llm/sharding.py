"""Shards of equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts stay
together unless a shard boundary has to fall inside their group.  The
boundaries between shards are found without sorting: each round counts the
exact bytes below a set of candidate keys around every boundary that is still
open (one map-side aggregated histogram of a narrow table: at most 512
candidates for each of the boundaries), and the next round probes between the
two candidates that enclose the wanted byte count, until a candidate is within
``tolerance`` of it or a single key is left.  Then every row knows its shard
by comparing its key with the splitters, and rows are exchanged once, for
their slots.

Built-in functions only.  Null text counts no bytes; rows equal in text and id
go to one shard; an empty table gives no shards.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_BITS, _STEP = 63, 9
ROW_OVERHEAD = 8
ROWS_PER_SLOT_RANGE = 200_000


def row_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text plus a fixed overhead for each row."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def _hash63(col: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(col)), 1)


def sort_key(id_col: str, text_col: str, seed: int) -> tuple[Column, Column]:
    return _hash63(text_col, seed), _hash63(id_col, seed)


@dataclass
class _Probe:
    """Open boundary: rows of its cell share the first ``bits`` bits of the key; ``below`` bytes lie under the cell."""

    want: float
    bits: int = 0
    a: int = 0
    b: int = 0
    below: int = 0

    @property
    def cell(self) -> tuple[int, int, int]:
        return self.bits, self.a, self.b


def _in_cell(bits: int, a: int, b: int) -> Column:
    if bits <= _BITS:
        return F.shiftright("a", _BITS - bits) == F.lit(a)
    return (F.col("a") == F.lit(a)) & (F.shiftright("b", 2 * _BITS - bits) == F.lit(b))


def _bucket(bits: int) -> Column:
    """The next ``_STEP`` bits of the key."""
    if bits < _BITS:
        return F.shiftright("a", _BITS - bits - _STEP)
    return F.shiftright("b", 2 * _BITS - bits - _STEP)


def _edge(bits: int, a: int, b: int) -> tuple[int, int]:
    """Smallest key of a cell."""
    return (a << (_BITS - bits), 0) if bits <= _BITS else (a, b << (2 * _BITS - bits))


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Smallest keys of the shards after the first; ``keys`` has columns a, b, size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(0, 0)] * (shards - 1)
    slack = tolerance * total / shards
    open_probes = {i: _Probe(total * i / shards) for i in range(1, shards)}
    done: dict[int, tuple[int, int]] = {}
    while open_probes:
        cells = sorted({p.cell for p in open_probes.values()})
        which, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (bits, a, b) in enumerate(cells):
            inside = _in_cell(bits, a, b)
            which = F.when(inside, F.lit(i)).otherwise(which)
            bucket = F.when(inside, _bucket(bits)).otherwise(bucket)
        rows = (keys.select(which.alias("cell"), bucket.alias("bucket"), "a", "b", "size").where("cell is not null")
                .groupBy("cell", "bucket")
                .agg(F.sum("size").alias("size"), F.min("a").alias("a0"), F.max("a").alias("a1"),
                     F.min("b").alias("b0"), F.max("b").alias("b1")).collect())
        counted: dict[int, list] = {i: [] for i in range(len(cells))}
        for r in sorted(rows, key=lambda r: (r["cell"], r["bucket"])):
            counted[r["cell"]].append(r)
        for i, p in list(open_probes.items()):
            buckets = counted[cells.index(p.cell)]
            upto, at = [], p.below
            for r in buckets:
                at += r["size"]
                upto.append(at)
            k = min(bisect_left(upto, p.want), len(buckets) - 1)
            r, low, high = buckets[k], upto[k] - buckets[k]["size"], upto[k]
            bits = p.bits + _STEP
            a, b = (r["bucket"], 0) if bits <= _BITS else (p.a, r["bucket"])
            here = _edge(bits, a, b)
            after = (here[0] + (1 << (_BITS - bits)), 0) if bits <= _BITS else (p.a, here[1] + (1 << (2 * _BITS - bits)))
            single = r["a0"] == r["a1"] and r["b0"] == r["b1"]
            near_low = p.want - low <= high - p.want
            if min(p.want - low, high - p.want) <= slack or single or bits >= 2 * _BITS:
                done[i] = here if near_low else after
                del open_probes[i]
            elif bits < _BITS and r["a0"] == r["a1"]:      # one text: go on by the id
                open_probes[i] = _Probe(p.want, _BITS, r["a0"], 0, low)
            else:
                open_probes[i] = _Probe(p.want, bits, a, b, low)
    return [done[i] for i in range(1, shards)]


def _shard_of(splitters: list[tuple[int, int]]) -> Column:
    shard = F.lit(0)
    for a, b in splitters:
        shard = shard + ((F.col("_a") > F.lit(a)) | ((F.col("_a") == F.lit(a)) & (F.col("_b") >= F.lit(b)))).cast("int")
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, seed: int = 23,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (gapless from 0 inside a shard).

    Columns named shard or slot of the input are replaced.  Slots follow the id hash in a shard, a seeded
    shuffle; a shard's rows are numbered in ranges of that hash, so its sort is spread over tasks.
    """
    a, b = sort_key(id_col, text_col, seed)
    keys = materialize(docs.select(a.alias("a"), b.alias("b"), row_size(text_col).alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    rows = keys.count()
    ranges = 0                                              # bits of the id hash that name a slot range
    while rows >> ranges > shards * ROWS_PER_SLOT_RANGE:
        ranges += 1
    part = F.shiftright("_b", _BITS - ranges) if ranges else F.lit(0).cast("long")

    placed_keys = (keys.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
                   .select(_shard_of(splitters).alias("shard"), part.alias("_part")))
    counts = placed_keys.groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"),
                            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))

    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = (docs.select(*[F.col(f"`{c}`") for c in own], a.alias("_a"), b.alias("_b"))
              .withColumn("shard", _shard_of(splitters)).withColumn("_part", part))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_b", "_a"))
    numbered = placed.withColumn("_place", place.cast("long"))
    joined = numbered.join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.select(*[F.col(f"`{c}`") for c in own], "shard", (F.col("_offset") + F.col("_place") - 1).alias("slot"))
