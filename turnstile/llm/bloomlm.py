"""Language-model scores from a log-frequency Bloom filter.

Counting: tokens are the words of a text (A-Z lower-cased) and one end token;
each task counts its word and bigram hashes in numpy and one shuffle sums them.

Filter: a count c is quantised to level ``1 + floor(log_BASE c)``; for every
level up to its own an n-gram sets ``PROBES`` bits of one 64-bit word chosen
by its hash.  A lookup probes level after level until one is missing, so a
count is found with a small chance of reading one level too high and never too
low.  The filter grows with the n-grams (``BITS`` bits an entry) and consists of
``SLICES`` equal slices by n-gram hash.  Slices are broadcast in passes of at
most ``max_broadcast_bytes``; a pass fills in the levels of the n-grams of its
slices, and between passes the levels found so far travel with their document.

Model: P(w | h) = (c(hw) + MU * P1(w)) / (max(c(h), c(hw)) + MU), where the
counts come from the filter.  P1 is the add-0.1 unigram estimate; its counts come
from the filter too, for every word alike (0 for unseen ones), but for the exact
count of end tokens.
The base score is exact: counts of the most frequent words (``HOT_WORDS`` at
most) are broadcast as a bounded table, other words are joined with theirs.  That
table plays no part in ``score``.

Null text is the empty text (one end token).  An empty training part knows no
token.  A null id counts as the empty text in the hold-out rule.  Rows that
repeat an id are scored one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W

BASE, BITS, PROBES, SLICES = 1.5, 12, 5, 4096
MAX_LEVEL = 96
MU = 50.0
HOT_WORDS = 1 << 19                 # 12 bytes each: 6 MB
MAX_BROADCAST_BYTES = 512 << 20
ADD = 0.1
FLUSH_TOKENS = 1 << 21
END, BEGIN = np.uint64(0x1F0E5DB2A7C38641), np.uint64(0x7D3A96E1C0B54F29)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tokens(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the token before, first token of each text): the end token closes every text."""
    first = words.first + np.arange(len(words.first))
    token = np.full(first[-1], END, np.uint64)
    at = np.arange(len(words)) + words.doc
    token[at] = words.hashes()
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = BEGIN
    return token, before, first


def _bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return W.mix(before * np.uint64(0x9E3779B97F4A7C15) + W.mix(token))


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """Count that a level stands for: the mean of the whole numbers it covers; 0 for level 0."""
    edge = np.ceil(BASE ** np.arange(MAX_LEVEL + 1) - 1e-6)
    return np.concatenate([[0.0], (edge[:-1] + edge[1:] - 1) / 2])


def ngram_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(slice, key, word, n): counts of words (``word`` true), begins and bigrams; rows of a slice lie together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, held, size = W.space_separators(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, bigrams, begins = (np.concatenate(x) for x in zip(*held))
            for keys, word in ((tokens, True), (begins, False), (bigrams, False)):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(key)), pa.array(np.full(len(key), word)), pa.array(n, pa.int64())],
                    ["key", "word", "n"])

        for batch in batches:
            for _, _, words in W.chunks(batch.column(0), sep, True):
                token, before, first = _tokens(words)
                held.append((token, _bigram(before, token), before[first[:-1]]))
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    part = docs.select(text_col).mapInArrow(run, "key long, word boolean, n long")
    slice_of = F.shiftrightunsigned("key", 64 - SLICES.bit_length() + 1).cast("int")
    return (part.withColumn("slice", slice_of).repartition("slice").groupBy("slice", "key", "word")
            .agg(F.sum("n").alias("n")).sortWithinPartitions("slice"))


def _places(key: np.ndarray, level: int, words_per_slice: int) -> tuple[np.ndarray, np.ndarray]:
    """(word inside the slice, bits of it) of an n-gram at a level."""
    h = W.mix(key + np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    at = ((h >> np.uint64(32)) * np.uint64(words_per_slice) >> np.uint64(32)).astype(np.int64)
    bits = np.zeros(len(key), np.uint64)
    for j in range(PROBES):
        bits |= np.uint64(1) << (h >> np.uint64(6 * j) & np.uint64(63))
    return at, bits


def _slice_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SLICES.bit_length() + 1)).astype(np.int64)


def build_slices(counts: DataFrame, words_per_slice: int) -> DataFrame:
    """(slice, bits): a slice read by several tasks has several rows, to be combined by OR."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}

        def rows(done: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(done, pa.int32()), pa.array([made.pop(s).tobytes() for s in done], pa.binary())],
                ["slice", "bits"])

        for batch in batches:
            slices, key = batch.column(0).to_numpy(), W.unsigned(batch.column(1).to_numpy())
            level = level_of(batch.column(2).to_numpy())
            present, home = np.unique(slices, return_inverse=True)
            grid = np.zeros((len(present), words_per_slice), np.uint64)
            for q in range(1, int(level.max(initial=0)) + 1):
                pick = np.flatnonzero(level >= q)
                at, bits = _places(key[pick], q, words_per_slice)
                np.bitwise_or.at(grid.reshape(-1), home[pick] * words_per_slice + at, bits)
            for s, row in zip(present.tolist(), grid):
                made[s] = made[s] | row if s in made else row.copy()
            if len(made) > 1:               # rows come by slice: all but the last are complete
                yield rows(sorted(made)[:-1])
        if made:
            yield rows(sorted(made))

    return counts.select("slice", "key", "n").mapInArrow(run, "slice int, bits binary")


@dataclass
class Filter:
    """Slices ``first`` to ``last - 1`` of the filter."""

    first: int
    last: int
    words_per_slice: int
    words: np.ndarray

    def levels(self, key: np.ndarray, found: np.ndarray) -> None:
        """Fill in the level (0: absent) of the keys whose slices are held."""
        home = _slice_of(key)
        pick = np.flatnonzero((home >= self.first) & (home < self.last))
        base = (home[pick] - self.first) * self.words_per_slice
        for q in range(1, MAX_LEVEL + 1):
            at, bits = _places(key[pick], q, self.words_per_slice)
            hit = (self.words[base + at] & bits) == bits
            pick, base = pick[hit], base[hit]
            if not len(pick):
                return
            found[pick] = q


@dataclass
class Model:
    """What every pass needs besides its slices."""

    key: np.ndarray
    count: np.ndarray
    total: int
    distinct: int
    ends: int
    mu: float

    def counts_of(self, token: np.ndarray) -> np.ndarray:
        """Exact counts of hot words; -1 for all others."""
        if not len(self.key):
            return np.full(len(token), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, token), len(self.key) - 1)
        return np.where(self.key[at] == token, self.count[at].astype(np.int64), -1)

    @property
    def norm(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / self.norm


class LanguageModel:
    """Filter and word counts of a corpus; ``slices`` and ``counts`` are tables in the shared folder."""

    def __init__(self, docs: DataFrame, text_col: str = "text", mu: float = MU,
                 hot_words: int = HOT_WORDS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        self.spark, self.text_col = docs.sparkSession, text_col
        self.counts = materialize(ngram_counts(docs, text_col), "lm-counts")
        level = 1 + F.floor(F.log(F.col("n")) / math.log(BASE) + 1e-9)
        row = self.counts.agg(F.sum(level).alias("entries"), F.sum(F.when(F.col("word"), F.col("n"))).alias("total"),
                              F.sum(F.col("word").cast("long")).alias("distinct"),
                              F.sum(F.when(F.col("word") & (F.col("key") == int(END.view(np.int64))), F.col("n"))).alias("ends")).first()
        entries, total, distinct, ends = (int(x or 0) for x in row)
        self.words_per_slice = max(1, -(-entries * BITS // (64 * SLICES)))
        self.slices = materialize(build_slices(self.counts, self.words_per_slice), "lm-filter")
        self.slices_per_pass = max(1, min(SLICES, max_broadcast_bytes // (8 * self.words_per_slice)))
        hot = W.most_frequent(self.counts.where("word"), hot_words).select("key", "n").toArrow()
        key, n = W.unsigned(hot["key"].to_numpy()), hot["n"].to_numpy()
        order = np.argsort(key)
        # counts beyond 32 bits stay exact: the table is widened when one needs it
        width = np.int64 if len(n) and n.max() >= 1 << 31 else np.int32
        self.model = Model(key[order], n[order].astype(width), total, distinct, ends, mu)

    def passes(self) -> Iterator[Filter]:
        for first in range(0, SLICES, self.slices_per_pass):
            last = min(first + self.slices_per_pass, SLICES)
            words = np.zeros((last - first, self.words_per_slice), np.uint64)
            for row in self.slices.where((F.col("slice") >= first) & (F.col("slice") < last)).toLocalIterator():
                words[row["slice"] - first] |= np.frombuffer(row["bits"], np.uint64)
            yield Filter(first, last, self.words_per_slice, words.reshape(-1))

    def score(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """id, n_tokens, n_known, train_tokens, base_score, score of every row."""
        spark, m = self.spark, self.model
        rows = docs.select(F.col(id_col).alias("id"), F.col(self.text_col).alias("text"), F.lit(None).cast("binary").alias("state"))
        shared = spark.sparkContext.broadcast(vars(m))        # plain values: workers may lack this package
        count = -(-SLICES // self.slices_per_pass)
        for i, part in enumerate(self.passes()):
            if i:
                rows = materialize(rows, "lm-pass")
            rows = rows.mapInArrow(_score_pass(spark.sparkContext.broadcast(vars(part)), shared, i == count - 1),
                                   _PASS_SCHEMA if i < count - 1 else _LAST_SCHEMA)
        found = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-scores")

        listed = spark.createDataFrame([], "key long, n long") if m.distinct <= len(m.key) else (
            self.counts.where("word").select("key", "n"))
        rest = (found.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.times")
                .join(listed, "key").groupBy("row")
                .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + ADD)).alias("logs")))
        unseen = F.col("n_rest") - F.coalesce("known", F.lit(0))
        base = (F.col("base") + F.coalesce("logs", F.lit(0.0)) + unseen * math.log10(ADD)
                - F.col("n_tokens") * math.log10(m.norm))
        return (found.join(rest, "row", "left")
                .select(F.col("id").alias(id_col), "n_tokens", (F.col("n_tokens") - unseen).alias("n_known"),
                        F.lit(m.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))


_PASS_SCHEMA = "id long, text string, state binary"
_LAST_SCHEMA = ("id long, n_tokens long, n_rest long, base double, score double, "
                "rest array<struct<key:long,times:long>>")


def _score_pass(filter_part, shared, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, means = W.space_separators(), level_counts()
        part, model = Filter(**filter_part.value), Model(**shared.value)
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                token, before, first = _tokens(words)
                before_key = before
                states = batch.column(2).slice(lo, hi - lo).to_pylist()
                if states[0] is None:
                    found = np.zeros((2, len(token)), np.uint8)
                else:
                    found = np.concatenate([np.frombuffer(s, np.uint8).reshape(2, -1) for s in states], 1)
                pair, context = found
                part.levels(_bigram(before, token), pair)
                part.levels(before_key, context)
                if not last:
                    out = [np.ascontiguousarray(found[:, a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(out, pa.binary())],
                        ["id", "text", "state"])
                    continue
                yield _scores(batch.column(0).slice(lo, hi - lo), model, token, first, means[pair], means[context])
    return run


def _sum_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1])          # every text has a token


def _scores(ids: pa.Array, model: Model, token: np.ndarray, first: np.ndarray, pair: np.ndarray,
            context: np.ndarray) -> pa.RecordBatch:
    count = model.counts_of(token)
    hot = count >= 0
    own = np.append(context[1:], 0.0)                   # a word's count is the context of the token behind it
    own[first[1:] - 1] = model.ends
    chance = (pair + model.mu * model.unigram(own)) / (np.maximum(context, pair) + model.mu)
    base = np.where(hot, np.log10(np.maximum(count, 0) + ADD), 0.0)
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    left = np.flatnonzero(~hot)
    order = left[np.lexsort((token[left], doc[left]))]
    new = np.ones(len(order), bool)
    new[1:] = (token[order][1:] != token[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    start = np.flatnonzero(new)
    times = np.diff(start, append=len(order))
    key, owner = token[order][start], doc[order][start]
    rest = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(W.signed(key)), pa.array(times, pa.int64())], ["key", "times"]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(first), pa.int64()), pa.array(_sum_by_doc((~hot).astype(np.int64), first)),
         pa.array(_sum_by_doc(base, first)), pa.array(_sum_by_doc(np.log10(chance), first)), rest],
        ["id", "n_tokens", "n_rest", "base", "score", "rest"])
