"""Exact token counts of whole texts by a two-tier lookup of pre-token lengths; no pre-token is shuffled.

A byte-fallback BPE model of the sentencepiece library with the identity normalizer never merges across a space that
follows another character (no entry of its vocabulary holds such a pair, which is checked), so a text is cut before
such spaces and its count is the sum of its pre-tokens' counts.  A pre-token is encoded without its first space: the
library puts that space back in front of every text.

1. A first scan counts pre-tokens of at most ``KEY_BYTES`` bytes inside each task and keeps the ``TASK_KEYS`` most
   frequent of the task.  These summaries, of bounded size for each task, are added up and the most frequent pre-tokens
   of the corpus become a compact hash table (the bytes themselves as two 64-bit words, their number and the count of
   tokens), which is broadcast: at most ``TABLE_KEYS`` entries, 18 bytes each at half load.
2. The second scan looks every pre-token up in that table with a few numpy steps for a whole run of texts.  What it
   does not hold goes to a table of the same kind in the worker (longer ones: a dict of their bytes), and what that
   does not hold is encoded once by the library.

Keys are compared in full, so counts don't depend on either tier; the tiers only save work.  Other tokenizers (a
``.json`` file of the tokenizers library, a model that may merge across words) encode whole texts.

Null text is empty: 0 bytes and 0 tokens.  Rows are counted one by one, so repeated ids and null ids are kept; other
columns of the input are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worker import get_or_build
from ..session import materialize
from . import words as W

KEY_BYTES = 16
# Entries of the broadcast table and of a task's summary; entries of a worker's table; long pre-tokens a worker keeps.
TABLE_KEYS, TASK_KEYS, CACHE_KEYS, LONG_KEYS, LONG_BYTES = 1 << 17, 1 << 15, 1 << 19, 20_000, 256
OVER_LIMIT = 4096
_MARK = "▁"            # the model's own sign for a space
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1] * (KEY_BYTES + 1), np.uint64)


class Keys:
    """Short byte strings as numbers: first and second 8 bytes, length, hash."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size: np.ndarray):
        self.a, self.b, self.size = a, b, size
        self.hash = W.mix(a ^ W.mix(b + size.astype(np.uint64)))

    @classmethod
    def of_spans(cls, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Keys:
        """Keys of spans of at most KEY_BYTES bytes; ``data`` has that many bytes to spare at its end."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        return cls(eight[start] & _LOW[size], eight[start + 8] & _LOW[np.maximum(size - 8, 0)], size.astype(np.uint8))

    def take(self, at: np.ndarray) -> Keys:
        out = Keys.__new__(Keys)
        out.a, out.b, out.size, out.hash = self.a[at], self.b[at], self.size[at], self.hash[at]
        return out

    def distinct(self) -> tuple[Keys, np.ndarray]:
        """The distinct keys, and which of them each key is."""
        order = np.lexsort((self.size, self.b, self.a))
        a, b, size = self.a[order], self.b[order], self.size[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (size[1:] != size[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        return self.take(order[first]), which

    def strings(self) -> list[str]:
        body = np.stack([self.a, self.b], 1).astype("<u8").tobytes()
        return [body[KEY_BYTES * i:KEY_BYTES * i + n].decode() for i, n in enumerate(self.size.tolist())]


class LengthTable:
    """Open-addressing hash table from keys to token counts (or other numbers), probed for many keys at once."""

    def __init__(self, most: int, kind: type = np.uint8):
        slots = 1 << max(4, (2 * most - 1).bit_length())
        self.a, self.b = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.tokens = np.zeros(slots, np.uint8), np.zeros(slots, kind)     # size: bytes + 1; 0 is free
        self.most, self.held, self.mask = most, 0, np.uint64(slots - 1)

    def find(self, keys: Keys) -> np.ndarray:
        """Token count of each key, -1 where the table doesn't hold it."""
        out = np.full(len(keys.a), -1, np.int16 if self.tokens.itemsize == 1 else np.int64)
        slot, left, size = (keys.hash & self.mask).astype(np.int64), np.arange(len(keys.a)), keys.size + np.uint8(1)
        while len(left):
            there = self.size[slot]
            same = (there == size[left]) & (self.a[slot] == keys.a[left]) & (self.b[slot] == keys.b[left])
            out[left[same]] = self.tokens[slot[same]]
            on = ~same & (there > 0)
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, keys: Keys, tokens: np.ndarray) -> None:
        """Keys are distinct and not in the table; it is emptied first if they would fill it."""
        if self.held + len(keys.a) > self.most:
            self.size[:] = 0
            self.held = 0
            keys, tokens = keys.take(np.arange(min(len(keys.a), self.most))), tokens[:self.most]
        self.held += len(keys.a)
        slot, left = (keys.hash & self.mask).astype(np.int64), np.arange(len(keys.a))
        owner = np.full(len(self.size), -1, np.int32) if len(left) else None
        while len(left):
            free = self.size[slot] == 0
            owner[slot[free]] = left[free]
            won = free & (owner[slot] == left)
            at, mine = slot[won], left[won]
            self.a[at], self.b[at], self.size[at], self.tokens[at] = keys.a[mine], keys.b[mine], keys.size[mine] + 1, tokens[mine]
            left, slot = left[~won], (slot[~won] + 1) & int(self.mask)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts; the model's sign for a space is a space."""
    if column.null_count:
        column = column.fill_null("")
    if _MARK.encode() in W.text_buffers(column)[0].tobytes():
        column = pa.array([t.replace(_MARK, " ") for t in column.to_pylist()], column.type)
    data, offsets = W.text_buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + W.CHUNK_BYTES, "right")) - 1, lo + 1), rows)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the pre-tokens of each text, without the space before them; they may be empty."""
    space = data == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    filled = offsets[1:] > offsets[:-1]
    cut[offsets[:-1][filled]] = False
    cuts = np.flatnonzero(cut)
    start = np.sort(np.concatenate([offsets[:-1][filled], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:][filled], cuts]), kind="stable")
    per_text = filled + np.diff(np.searchsorted(cuts, offsets))
    return start, end, np.repeat(np.arange(len(filled)), per_text)


def _short(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Keys]:
    at = np.flatnonzero(end - start <= KEY_BYTES)
    padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
    return at, Keys.of_spans(padded, start[at], (end - start)[at])


def _cuts_at_spaces(model: bytes) -> bool:
    """Does the model encode a text as the sum of its pre-tokens?"""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    normal, train = m.normalizer_spec, m.trainer_spec
    plain = (normal.name == "identity" and not normal.precompiled_charsmap and not normal.normalization_rule_tsv
             and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces)
    bpe = train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
    return plain and bpe and not any(x != _MARK and y == _MARK for p in m.pieces for x, y in zip(p.piece, p.piece[1:]))


class PieceCounter:
    """Token counts of short texts that stand after a space, by the library."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))      # of a space with nothing behind it
        self.table, self.long = LengthTable(CACHE_KEYS), {}

    def encode(self, pieces: list[str]) -> np.ndarray:
        return np.array([len(x) if p else self.lone for p, x in zip(pieces, self.model.encode(pieces, num_threads=1))], np.int64)

    def _long(self, pieces: list[bytes]) -> list[int]:
        new = [p for p in set(pieces) if p not in self.long]
        found = dict(zip(new, self.encode([p.decode() for p in new]).tolist()))
        out = [found[p] if p in found else self.long[p] for p in pieces]
        if len(self.long) + len(found) > LONG_KEYS:
            self.long.clear()
        self.long.update((p, n) for p, n in list(found.items())[:LONG_KEYS] if len(p) <= LONG_BYTES)
        return out

    def counts(self, frequent: LengthTable, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a run."""
        start, end, text = pre_tokens(data, offsets)
        tokens = np.zeros(len(start), np.int64)
        at, keys = _short(data, start, end)
        found = frequent.find(keys)
        tokens[at] = found
        missing = np.flatnonzero(found < 0)
        if len(missing):
            rest = keys.take(missing)
            found = self.table.find(rest)
            unknown = np.flatnonzero(found < 0)
            if len(unknown):
                one, which = rest.take(unknown).distinct()
                n = self.encode(one.strings())
                self.table.add(one, n)
                found[unknown] = n[which]
            tokens[at[missing]] = found
        far = np.flatnonzero(end - start > KEY_BYTES)
        if len(far):
            tokens[far] = self._long([data[a:b].tobytes() for a, b in zip(start[far].tolist(), end[far].tolist())])
        return np.bincount(text, weights=tokens, minlength=len(offsets) - 1).astype(np.int64)


def frequent_lengths(docs: DataFrame, model: bytes, text_col: str = "text", table_keys: int = TABLE_KEYS,
                     task_keys: int = TASK_KEYS) -> LengthTable:
    """The table of the corpus's most frequent short pre-tokens with their token counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def fold(most: int) -> None:
            h, a, b, size, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((size, b, a, h))
            h, a, b, size, n = h[order], a[order], b[order], size[order], n[order]
            first = np.ones(len(h), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (size[1:] != size[:-1])
            edge = np.flatnonzero(first)
            n = np.add.reduceat(n, edge)
            if len(n) > most:
                top = np.sort(np.argpartition(-n, most)[:most])
                edge, n = edge[top], n[top]
            parts[:] = [(h[edge], a[edge], b[edge], size[edge], n)]

        for batch in batches:
            for _, _, data, offsets in _runs(batch.column(0)):
                start, end, _ = pre_tokens(data, offsets)
                keys = _short(data, start, end)[1]
                _, first, n = np.unique(keys.hash, return_index=True, return_counts=True)
                k = keys.take(first)
                parts.append((k.hash, k.a, k.b, k.size, n))
                if sum(len(p[0]) for p in parts) > 8 * task_keys:
                    fold(4 * task_keys)
        if parts:
            fold(task_keys)
            _, a, b, size, n = parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(a)), pa.array(W.signed(b)), pa.array(size.astype(np.int32)),
                                              pa.array(n.astype(np.int64))], ["a", "b", "size", "n"])

    found = (docs.select(text_col).mapInArrow(run, "a long, b long, size int, n long")
             .groupBy("a", "b", "size").agg(F.sum("n").alias("n")).where("n > 1"))
    top = W.most_frequent(materialize(found, "pre-token-summaries"), table_keys).toArrow()
    keys = Keys(*(W.unsigned(top[c].to_numpy()) for c in ("a", "b")), top["size"].to_numpy().astype(np.uint8))
    table = LengthTable(table_keys)
    table.add(keys, PieceCounter(model).encode(keys.strings()))
    return table


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = OVER_LIMIT, table_keys: int = TABLE_KEYS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes and tokens without begin, end or added specials."""
    with open(tokenizer_path, "rb") as f:
        model = f.read()
    spark, name = docs.sparkSession, f"{zlib.crc32(model)}-{len(model)}"
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(model)
    if tokenizer_path.endswith(".model") and _cuts_at_spaces(model):
        frequent = spark.sparkContext.broadcast(frequent_lengths(rows, model, "text", table_keys))

        def count(column: pa.Array) -> Iterator[np.ndarray]:
            counter = get_or_build(f"piece-counter:{name}", lambda: PieceCounter(shared.value))
            for _, _, data, offsets in _runs(column):
                yield counter.counts(frequent.value, data, offsets)
    else:
        kind = "sentencepiece" if tokenizer_path.endswith(".model") else "tokenizers"

        def build():
            if kind == "sentencepiece":
                import sentencepiece
                whole = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
                return lambda texts: [len(x) for x in whole.encode(texts, num_threads=1)]
            import tokenizers
            found = tokenizers.Tokenizer.from_str(shared.value.decode())
            found.no_truncation()
            found.no_padding()
            return lambda texts: [len(x.ids) for x in found.encode_batch_fast(texts, add_special_tokens=False)]

        def count(column: pa.Array) -> Iterator[np.ndarray]:
            counter = get_or_build(f"text-counter:{name}", build)
            for text in column:                     # one whole text at a time: the ids of a batch need not fit in memory
                yield np.array(counter([text.as_py()]), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(W.text_buffers(batch.column(1))[1])
            n = np.concatenate([np.zeros(0, np.int64), *count(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n),
                                              pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
