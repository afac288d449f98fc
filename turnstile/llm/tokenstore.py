"""Token-id output: whole texts to ids, written as Simple-8b segments, and read back.

Documents are range-partitioned and sorted by id, so segment rows in
(partition, segment) order hold all documents in ascending id order.  A segment
(see ``simple8b``) holds whole documents until it has ``SEGMENT_IDS`` ids; its
row also carries the documents' ids and lengths, so a document is found without
decoding what lies before it, and the number of ids before the segment in its
partition.  The container is Parquet in a folder that all executors share:
Spark commits its files, so lost executors leave no half segments.

Tokenizing: the byte-level pre-tokenizer always ends a piece before a single
space between two characters that are not white space, and around a single
line feed between two such characters.  A text is cut there, in numpy over the
bytes of a run of texts; pieces of up to 16 bytes are looked up in a hash table
of the worker (their bytes as two 64-bit words, compared in full), longer ones
in a dict, and each distinct piece is encoded once per worker (both are
bounded).  The ids of a run are then gathered from one array.

Null text is the empty text: only the end id.  Rows that share an id are kept,
in the order of a hash of their texts, so they may spread over tasks; a null id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.worker import get_or_build
from . import simple8b
from . import words as W
from .tokencounts import KEY_BYTES, Keys, LengthTable

SEGMENT_IDS = 1 << 20
# Pieces a worker remembers (about 50 bytes each) and their ids; a run adds to them before they are emptied.
CACHE_PIECES, CACHE_IDS = 1 << 21, 1 << 24
END_ID = 2

_SPACE = "\u0120"          # how byte-level vocabularies write a space
_RUN = 200
# White space as any of the regular expression engines sees it: single bytes, and the first bytes of other such characters
# with the ranges of what follows.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WIDE = ((b"\xc2", (0x85, 0xA0), ()), (b"\xe1", (0x9A,), (0x80,)), (b"\xe2", (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
         (b"\xe2", (0x81,), (0x9F,)), (b"\xe3", (0x80,), (0x80,)))


def _white(data: np.ndarray) -> np.ndarray:
    """True for the bytes of white-space characters."""
    out = _WHITE[data]
    if (data >= 0xC2).any():
        after = np.concatenate([data[1:], np.zeros(2, np.uint8)])
        for lead, second, third in _WIDE:
            at = np.flatnonzero(data == lead[0])
            at = at[np.isin(after[at], second)]
            if third:
                at = at[np.isin(after[at + 1], third)]
            for step in range(3 if third else 2):
                out[at + step] = True
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the pieces of each text; together they are all bytes."""
    white = _white(data)
    alone = np.zeros(len(data), bool)               # a white byte between two others of the same text
    alone[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
    filled = offsets[1:] > offsets[:-1]
    alone[offsets[:-1][filled]] = False
    alone[offsets[1:][filled] - 1] = False
    cut = np.zeros(len(data) + 1, bool)
    line = np.flatnonzero(alone & (data == 0x0A))
    cut[np.flatnonzero(alone & (data == 0x20))] = True
    cut[line] = True
    cut[line + 1] = True
    cut[offsets[:-1][filled]] = True
    start = np.flatnonzero(cut[:-1])
    per_text = np.diff(np.searchsorted(start, offsets))
    return start, np.append(start[1:], len(data)), np.repeat(np.arange(len(filled)), per_text)


class PieceEncoder:
    """Ids of whole texts through a table of pieces."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)      # tokens that begin with the space
        self.opens[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = LengthTable(CACHE_PIECES, np.int32), {}
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 0             # ids of all pieces, one after the other
        self.first, self.count, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, found: list[np.ndarray]) -> np.ndarray:
        """Store the ids of new pieces; their numbers."""
        size = np.array([len(x) for x in found], np.int64)
        while self.n_ids + int(size.sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(found) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        if found:
            self.ids[self.n_ids:self.n_ids + int(size.sum())] = np.concatenate(found)
        number = np.arange(self.known, self.known + len(found))
        self.first[number] = self.n_ids + np.cumsum(size) - size
        self.count[number] = size
        self.n_ids, self.known = self.n_ids + int(size.sum()), self.known + len(found)
        return number

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Encode new pieces, those of a space and a word in runs: " a b c" has exactly the tokens of " a", " b" and " c"."""
        out: list = [None] * len(texts)
        words = [i for i, t in enumerate(texts) if t[0] == " " and len(t) > 1 and len(t.split()) == 1 and t[1:] == t.strip()]
        rest = set(range(len(texts))) - set(words)
        runs = [words[i:i + _RUN] for i in range(0, len(words), _RUN)]
        for run, ids in zip(runs, self._encode(["".join([texts[i] for i in run]) for run in runs])):
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(run):
                rest.update(run)
                continue
            for i, a, b in zip(run, at.tolist(), [*at[1:].tolist(), len(ids)]):
                out[i] = ids[a:b]
        singly = sorted(rest)
        for i, ids in zip(singly, self._encode([texts[i] for i in singly])):
            out[i] = ids
        return self._keep(out)

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if 4 * self.known > 3 * CACHE_PIECES or self.n_ids > CACHE_IDS:
            self._forget()
        start, end, text = pieces(data, offsets)
        number = np.zeros(len(start), np.int64)
        at = np.flatnonzero(end - start <= KEY_BYTES)
        keys = Keys.of_spans(np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)]), start[at], (end - start)[at])
        found = self.table.find(keys)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            one, which = keys.take(unknown).distinct()
            new = self._learn(one.strings())
            room = max(0, self.table.most - self.table.held)
            self.table.add(one.take(np.arange(min(room, len(new)))), new[:room])
            found[unknown] = new[which]
        number[at] = found
        far = np.flatnonzero(end - start > KEY_BYTES)
        if len(far):
            body = [data[a:b].tobytes() for a, b in zip(start[far].tolist(), end[far].tolist())]
            new = list(dict.fromkeys(p for p in body if p not in self.long))
            self.long.update(zip(new, self._learn([p.decode() for p in new]).tolist()))
            number[far] = [self.long[p] for p in body]
        size = self.count[number].astype(np.int64)
        place = np.arange(int(size.sum())) + np.repeat(self.first[number] - (np.cumsum(size) - size), size)
        per_text = np.bincount(text, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return self.ids[place], per_text

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, run by run of texts."""
        data, offsets = W.text_buffers(column)
        lo, rows = 0, len(offsets) - 1
        while lo < rows:
            hi = min(max(int(np.searchsorted(offsets, offsets[lo] + W.CHUNK_BYTES, "right")) - 1, lo + 1), rows)
            ids, n = self._run(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            edges = np.concatenate([[0], np.cumsum(n)]).tolist()
            for a, b in zip(edges, edges[1:]):
                yield ids[a:b]
            lo = hi


def _tokenizer(text: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the ids of all documents, each ended by ``end_id``, to a new folder ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = get_or_build(f"piece-encoder:{tokenizer_path}", lambda: PieceEncoder(_tokenizer(model.value)))
        ids, found, lengths, held, before = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            body = simple8b.encode(np.concatenate(found).astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([body], pa.binary())], ["part", "part_start", "n_ids", "doc_ids", "lengths", "segment"])

        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids.append(key)
                found += (tokens, end)
                lengths.append(len(tokens) + 1)
                held += len(tokens) + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    before += held
                    ids, found, lengths, held = [], [], [], 0
        if ids:
            yield close()

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text"))
    (ordered.mapInArrow(run, "part int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, segment binary")
     .write.parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) is what a reader may want; see ``read_digest`` for a summary."""
    return _read(spark, path, lambda ids, a, b: ids[a:b].astype(np.int64), "ids", "array<long>", pa.list_(pa.int64()))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of the ids as little-endian 32-bit integers."""
    return _read(spark, path, lambda ids, a, b: zlib.crc32(ids[a:b]), "ids_crc32", "long", pa.int64())


def _read(spark: SparkSession, path: str, take, name: str, kind: str, arrow_kind: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("part_start", "doc_ids", "lengths", "segment", "part")}
                ids = np.ascontiguousarray(simple8b.decode(row["segment"].as_buffer().to_pybytes()), "<u4")
                lengths = row["lengths"].values.to_numpy()
                edges = np.concatenate([[0], np.cumsum(lengths)])
                values = [take(ids, int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(edges[:-1] + row["part_start"].as_py(), pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(values, arrow_kind),
                     pa.array(np.full(len(lengths), row["part"].as_py(), np.int32))],
                    ["doc_id", "in_part", "n_tokens", name, "part"])

    store = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (store.groupBy("part").agg(F.sum("n_ids").alias("n"))       # one row per partition of the writer
               .select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    rows = store.select("part", "part_start", "doc_ids", "lengths", "segment").mapInArrow(
        run, f"doc_id long, in_part long, n_tokens long, {name} {kind}, part int")
    return (rows.join(offsets, F.col("part") == F.col("_p"))
            .select("doc_id", (F.col("_before") + F.col("in_part")).alias("start"), "n_tokens", name))
