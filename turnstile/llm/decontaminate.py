"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Benchmark items and documents are lower-cased (A-Z only) and cut into words at
every ASCII byte that is neither a digit nor a letter.  A *window* is
``window`` consecutive words of an item; an item with fewer words, but not
none, is one shorter window.  The distinct windows of the benchmark are held
as sorted 64-bit hashes with a second, independent 64-bit hash for
verification, and broadcast in segments of at most ``segment_windows``
entries: an index of any size is applied by that many passes over the rows of
a partition, each with a bounded broadcast.  Documents are scanned window by
window inside their partition; nothing is shuffled.

Null text has no words and is never contaminated; an empty benchmark hits
nothing; repeated items share their windows and are all reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW = 10
# 16 bytes of hashes and 8 of item offsets for each window: a segment takes under 50 MB.
SEGMENT_WINDOWS = 2_000_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Segment:
    """Windows of one length-sorted part of the benchmark; ``items[offset[i]:offset[i+1]]`` hold window i."""

    key: np.ndarray
    check: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    items: np.ndarray


def _two_hashes(words: W.Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = W.ngrams(h, words.doc, n)
    check, _ = W.ngrams(W.mix(h ^ _SECOND), words.doc, n)
    return key, check, at


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(key, check, length, items) of every distinct window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.symbol_separators()
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, _, words in W.chunks(batch.column(1), sep, True):
                h, counts = words.hashes(), words.counts
                for n in sorted({int(min(c, window)) for c in counts if c}):
                    key, check, at = _two_hashes(words, h, n)
                    doc = words.doc[at]
                    own = (np.minimum(counts, window) == n)[doc]
                    key, check, doc = key[own], check[own], doc[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.signed(key)), pa.array(W.signed(check)), pa.array(np.full(len(key), n, np.int32)),
                         pa.array(ids[lo + doc].tolist(), pa.string())], ["key", "check", "length", "item"])

    rows = benchmark.select(F.col(item_col).cast("string"), text_col).mapInArrow(
        run, "key long, check long, length int, item string")
    return rows.groupBy("key", "check", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))


def build_index(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                segment_windows: int = SEGMENT_WINDOWS) -> list:
    """Broadcast segments of the benchmark's windows.

    The driver holds one segment at a time: the windows are read back in
    key order as an iterator, a partition at a time.
    """
    spark = benchmark.sparkSession
    segments, part = [], []

    def close() -> None:
        if part:
            part.sort(key=lambda x: x["key"] & (2 ** 64 - 1))
            items = [x["items"] for x in part]
            segments.append(spark.sparkContext.broadcast((       # plain values: workers may lack this package
                W.unsigned(np.array([x["key"] for x in part], np.int64)),
                W.unsigned(np.array([x["check"] for x in part], np.int64)),
                np.array([x["length"] for x in part], np.int32),
                np.cumsum([0, *map(len, items)]), np.array([y for x in items for y in x], dtype=object))))
            part.clear()

    for row in item_windows(benchmark, item_col, text_col, window).sort("key", "check").toLocalIterator():
        part.append(row)
        if len(part) >= segment_windows:
            close()
    close()
    return segments


def _scan(words: W.Words, h: np.ndarray, segments: list, lengths: list[list[int]],
          cover: np.ndarray, found: dict[int, set]) -> None:
    """Mark the words of verified hits in ``cover`` and collect the items of each document."""
    made: dict[int, tuple] = {}
    for segment, own in zip(segments, lengths):
        s = Segment(*segment.value)
        for n in own:
            if n not in made:
                made[n] = _two_hashes(words, h, n)
            key, check, at = made[n]
            if not len(key):
                continue
            lo = np.searchsorted(s.key, key)
            lo[lo == len(s.key)] = 0
            candidates = np.flatnonzero(s.key[lo] == key)
            for c in candidates:
                i = int(lo[c])
                while i < len(s.key) and s.key[i] == key[c]:
                    if s.check[i] == check[c] and s.length[i] == n:
                        cover[at[c]:at[c] + n] = True
                        found.setdefault(int(words.doc[at[c]]), set()).update(s.items[s.offset[i]:s.offset[i + 1]])
                    i += 1


def _lengths(segments: list) -> list[list[int]]:
    return [np.unique(Segment(*s.value).length).tolist() for s in segments]


def scan_documents(docs: DataFrame, segments: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted), spans (word ranges that were hit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    lengths = _lengths(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.symbol_separators()
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                cover, found = np.zeros(len(words) + 1, bool), {}
                if len(words):
                    _scan(words, words.hashes(), segments, lengths, cover, found)
                total = np.concatenate([[0], np.cumsum(cover[:-1])])
                hit = total[words.first[1:]] - total[words.first[:-1]]
                items = [sorted(found.get(d, ())) for d in range(words.n_docs)]
                spans = [_ranges(cover[words.first[d]:words.first[d + 1]]) if hit[d] else [] for d in range(words.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts, pa.int64()), pa.array(hit, pa.int64()),
                     pa.array(items, pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                    [id_col, "n_words", "n_hit", "items", "spans"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>")


def _ranges(cover: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def _without(text: bytes, words: W.Words, d: int, base: int, cover: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of every hit span."""
    out, at, first = [], 0, words.first[d]
    for r in _ranges(cover[words.first[d]:words.first[d + 1]]):
        out.append(text[at:int(words.start[first + r["first"]]) - base])
        at = int(words.end[first + r["last"]]) - base
    out.append(text[at:])
    return b"".join(out).decode("utf-8")


def decontaminate(docs: DataFrame, segments: list, text_col: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` without its contaminated documents, or without the contaminated spans of their texts.

    All columns pass through; ``remove`` is ``documents`` or ``spans``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    place, lengths = docs.columns.index(text_col), _lengths(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.symbol_separators()
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(place), sep, True):
                cover, found = np.zeros(len(words) + 1, bool), {}
                if len(words):
                    _scan(words, words.hashes(), segments, lengths, cover, found)
                part = batch.slice(lo, hi - lo)
                if remove == "documents":
                    keep = np.ones(words.n_docs, bool)
                    keep[list(found)] = False
                    yield part.filter(pa.array(keep))
                elif not found:
                    yield part
                else:
                    texts = part.column(place).to_pylist()
                    for d in found:
                        texts[d] = _without(texts[d].encode(), words, d, int(words.offsets[d]), cover)
                    columns = list(part.columns)
                    columns[place] = pa.array(texts, part.schema.field(place).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def items_digest(items: str = "items"):
    """sha256 of the comma-joined item ids."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
