"""Hard negatives by exact search over an inverted multi-index.

Components become ``floor(256 * x)``; a score is the integer inner product of two rows.

*Index*: the vector is cut into two halves, each with a codebook of ``k`` centres (k-means on a bounded sample, at most
``SAMPLE`` rows; results don't depend on it).  A row lies in cell (code of the first half, code of the second half).
Every row is placed by one scan and the index is written as a table; a task reads it in blocks of at most
``BLOCK_ROWS`` rows and keeps, for each block, the rows by cell and the radius of every half cluster.

*Search*: for an anchor, a half cluster can't score above centre * anchor + radius * |anchor| in that half.  The
multi-sequence heap visits the cells of a block by the sum of the two bounds, highest first.  A search stops when the
next bound is below what it still needs: below the last of the first ``positives`` rows of the same label, or, for the
window of a positive, below the last of its first ``negatives`` rows or below the window itself.  A block starts from
what the task found in earlier blocks.  Bounds carry a slack beyond the rounding error, and a cell whose bound equals
the last score is still visited, so ties by id come out right and results equal a full scan.

*Spark*: anchors are broadcast in chunks of ``CHUNK`` rows.  For each chunk one pass over the index finds the first
positives of each task and a second one, with the windows of the merged positives, the first negatives; a window over
(anchor) and (anchor, positive) merges the few rows of the tasks.  So a task holds one block and one chunk, whatever the
size of the table, the label or the group of equal vectors.

Rows with a null label, a null vector, or a null or non-finite component (256 times it, too) take no part.  Shorter vectors end in zeros.
A row is not its own positive: rows with the anchor's id aren't.  Rows that repeat an id are rows of their own.  A null
id comes last in ties and is returned as null.  Scores beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.index import with_row_index
from ..session import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90                      # percent of the positive's score
SAMPLE, ROUNDS = 4096, 8
BLOCK_ROWS, CHUNK, STEP_ROWS = 1 << 15, 1 << 13, 512
NO_ID = (1 << 63) - 1
_EXACT = 1 << 53


def quantised(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of floor(256 * x), as whole numbers in float64."""
    size = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(size) and (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _dot(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Exact scores: float64 while they fit, else Python's integers, held to 64 bits."""
    if exact:
        return rows @ anchor
    whole = [int(x) for x in anchor]
    return np.array([max(-NO_ID, min(NO_ID, sum(int(x) * y for x, y in zip(r, whole)))) for r in rows], object)


def _centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means from distinct starting points."""
    start = np.unique(points, axis=0)
    start = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(ROUNDS):
        code = _codes(points, start)
        n = np.bincount(code, minlength=len(start))
        total = np.zeros_like(start)
        np.add.at(total, code, points)
        start = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], start)
    return start


def _codes(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1) if len(points) else np.zeros(0, np.int64)


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        limit = 1e150           # squares stay finite; the codes of larger components are as good as any
        sample = np.clip(sample, -limit, limit)
        self.centres = (_centres(sample[:, :self.half], k, 1), _centres(sample[:, self.half:], k, 2))

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, :self.half], rows[:, self.half:]

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_codes(np.clip(h, -1e150, 1e150), c) for h, c in zip(self.halves(rows), self.centres))


def pick_k(rows: int) -> int:
    """Centres of a half for a table of so many rows: cells of a few rows to the square root of the table."""
    return min(64, max(2, int((rows ** 0.5 / 4) ** 0.5)))


class Block:
    """Inverted multi-index over the rows of one block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, codes: list[np.ndarray], books: Codebooks):
        self.k = [len(c) for c in books.centres]
        cell = codes[0] * self.k[1] + codes[1]
        order = np.lexsort((labels, cell))
        self.ids, self.labels, self.rows, cell = ids[order], labels[order], rows[order], cell[order]
        self.at = np.searchsorted(cell, np.arange(self.k[0] * self.k[1] + 1))
        self.books, self.largest = books, float(np.abs(rows).max()) if rows.size else 0.0
        self.radius = []
        for half, centres, code in zip(books.halves(rows), books.centres, codes):
            far = np.full(len(centres), -np.inf)
            np.maximum.at(far, code, np.sqrt(((half - centres[code]) ** 2).sum(1)))
            self.radius.append(far)

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Highest score of each half cluster for each anchor; -inf for clusters without rows."""
        out = []
        for half, centres, radius in zip(self.books.halves(anchors), self.books.centres, self.radius):
            size = np.sqrt((half * half).sum(1))[:, None]
            with np.errstate(invalid="ignore"):
                high = half @ centres.T + radius * size
            slack = 1e-9 * (np.abs(half) @ np.abs(centres).T + np.where(radius > 0, radius, 0) * size) + 1e-3
            out.append(np.where(np.isneginf(radius), -np.inf, high + slack))
        return out

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(highest score of what is left after these, rows) of runs of cells, by the sum of their bounds."""
        a, b = np.argsort(-first), np.argsort(-second)
        x, y = first[a], second[b]
        heap, rows, size = [(-(x[0] + y[0]), 0, 0)], [], 0
        while heap:
            top, i, j = heapq.heappop(heap)
            if top == np.inf:
                break
            cell = a[i] * self.k[1] + b[j]
            lo, hi = self.at[cell], self.at[cell + 1]
            if hi > lo:
                rows.append(np.arange(lo, hi))
                size += hi - lo
            if j + 1 < len(y):                              # each cell has one parent: to its left, or above in column 0
                heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
            if size >= STEP_ROWS:
                yield -heap[0][0] if heap else -np.inf, np.concatenate(rows)
                rows, size = [], 0
        if rows:
            yield -np.inf, np.concatenate(rows)


class Best:
    """The first ``most`` (score, id) by falling score, then rising id."""

    def __init__(self, most: int):
        self.most, self.score, self.id = most, [], []

    def last(self):
        return self.score[-1] if len(self.score) == self.most else None

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        last = self.last()
        if last is not None:
            keep = score >= last
            score, ids = score[keep], ids[keep]
        if not len(score):
            return
        if len(score) > 4 * self.most:                      # drop what lies below the last place, ties stay
            cut = np.partition(score, len(score) - self.most)[len(score) - self.most]
            score, ids = score[score >= cut], ids[score >= cut]
        pairs = sorted(zip((-s for s in (*self.score, *score.tolist())), (*self.id, *ids.tolist())))[:self.most]
        self.score, self.id = [-s for s, _ in pairs], [i for _, i in pairs]


class Anchors:
    """One broadcast chunk: vectors, labels, ids and, for the second pass, the windows of each anchor."""

    def __init__(self, number, ids, labels, rows, windows=None):
        self.number, self.ids, self.labels, self.rows, self.windows = number, ids, labels, rows, windows
        self.largest = float(np.abs(rows).max()) if rows.size else 0.0


def _search_positives(block: Block, anchors: Anchors, best: list[Best], exact: bool) -> None:
    firsts, seconds = block.bounds(anchors.rows)
    for n, keep in enumerate(best):
        for left, rows in block.visit(firsts[n], seconds[n]):
            rows = rows[(block.labels[rows] == anchors.labels[n]) & (block.ids[rows] != anchors.ids[n])]
            keep.offer(_dot(block.rows[rows], anchors.rows[n], exact), block.ids[rows])
            if keep.last() is not None and left < keep.last():
                break


def _search_negatives(block: Block, anchors: Anchors, best: list[list[Best]], exact: bool) -> None:
    firsts, seconds = block.bounds(anchors.rows)
    for n, (windows, kept) in enumerate(zip(anchors.windows, best)):
        if not windows:
            continue
        for left, rows in block.visit(firsts[n], seconds[n]):
            rows = rows[block.labels[rows] != anchors.labels[n]]
            score = _dot(block.rows[rows], anchors.rows[n], exact)
            certain = True
            for (low, high), keep in zip(windows, kept):
                inside = (score >= low) & (score <= high)
                if inside.any():
                    keep.offer(score[inside], block.ids[rows[inside]])
                certain &= left < low or (keep.last() is not None and left < keep.last())
            if certain:
                break


def _blocks(batches: Iterator[pa.RecordBatch], books: Codebooks, dim: int) -> Iterator[Block]:
    held, size = [], 0

    def close() -> Block:
        ids, labels, rows, c1, c2 = (np.concatenate(x) for x in zip(*held))
        return Block(ids, labels, rows, [c1, c2], books)

    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            ids, labels, codes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "cell"))
            if size and size + len(ids) > BLOCK_ROWS:
                yield close()
                held, size = [], 0
            k = len(books.centres[1])
            held.append((ids, labels, quantised(part.column("vector"), dim), codes // k, codes % k))
            size += len(ids)
    if size:
        yield close()


def build_index(vectors: DataFrame, books, dim: int) -> DataFrame:
    """(id, label, vector, cell) of every row; ``books`` is a broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = books.value.codes(quantised(batch.column("vector"), dim))
            cell = one * len(books.value.centres[1]) + two
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "label", "vector", "cell"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return materialize(vectors.mapInArrow(run, f"id long, label long, vector {kind}, cell int"), "multi-index")


def _pass(index: DataFrame, books, anchors, dim: int, negative: bool) -> DataFrame:
    """(anchor, place of the window, score, id): the first rows of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Anchors = anchors.value
        best = [[Best(NEGATIVES) for _ in w] for w in a.windows] if negative else [Best(POSITIVES) for _ in a.ids]
        for block in _blocks(batches, books.value, dim):
            exact = dim * block.largest * a.largest < _EXACT
            (_search_negatives if negative else _search_positives)(block, a, best, exact)
        out = [(a.number[n], p, int(s), i) for n, found in enumerate(best)
               for p, keep in enumerate(found if negative else [found]) for s, i in zip(keep.score, keep.id)]
        if out:
            number, place, score, ids = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(place, pa.int32()),
                                              pa.array(score, pa.int64()), pa.array(ids, pa.int64())],
                                             ["anchor", "place", "score", "id"])

    found = index.mapInArrow(run, "anchor long, place int, score long, id long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= (NEGATIVES if negative else POSITIVES)))


def windows_of(scores: list[int]) -> list[tuple[int, int]]:
    """Lowest and highest score of a hard negative for each positive score (empty if the first is the larger)."""
    return [(-(-LOW * s // 100), HIGH * s // 100) for s in scores]


def hard_negatives(vectors: DataFrame, anchors, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   k: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the rows of ``vectors``.
    """
    spark = vectors.sparkSession
    vec = F.col(vector_col)
    usable = (F.col(label_col).isNotNull() & vec.isNotNull()
              & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < F.lit(float("inf")))))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"),
        vec.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    total, dim, n_anchors = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.count_if("is_anchor")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    dim = max(dim, 1)
    sample = rows.select("vector").orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).toArrow()
    found = Codebooks(quantised(sample["vector"].combine_chunks(), dim), k or pick_k(total))
    books = spark.sparkContext.broadcast(found)
    index = build_index(rows.select("id", "label", "vector"), books, dim)
    asked = rows.where("is_anchor").select("id", "label", "vector")
    if n_anchors > chunk:
        asked = materialize(with_row_index(asked, ["id", "label", "vector"], name="anchor"), "anchors")
    out = []
    for lo in range(0, n_anchors, chunk):
        if n_anchors > chunk:
            part = asked.where((F.col("anchor") >= lo) & (F.col("anchor") < lo + chunk)).orderBy("anchor").toArrow()
        else:
            part = asked.orderBy("id", "label", "vector").toArrow()
        queries = Anchors(list(range(lo, lo + part.num_rows)), part["id"].to_numpy(), part["label"].to_numpy(),
                          quantised(part["vector"].combine_chunks(), dim))
        positives = materialize(_pass(index, books, spark.sparkContext.broadcast(queries), dim, False), "positives")
        scores = [[] for _ in queries.number]
        for anchor, score in zip(*positives.orderBy("anchor", "rank").select("anchor", "score").toArrow().to_pydict().values()):
            scores[anchor - lo].append(score)
        queries.windows = [windows_of(s) for s in scores]
        negatives = _pass(index, books, spark.sparkContext.broadcast(queries), dim, True)
        named = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"),
                                 F.col("score").alias("positive_score"))
        ids = spark.createDataFrame(pa.table({"anchor": pa.array(queries.number, pa.int64()), "anchor_id": pa.array(queries.ids)}))
        out.append(materialize(
            negatives.join(named, ["anchor", "place"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")), "hard-negatives"))
    shown = reduce(DataFrame.unionByName, out)
    return shown.select(*[F.nullif(F.col(c), F.lit(NO_ID)).alias(c) if c.endswith("_id") else c for c in shown.columns])
