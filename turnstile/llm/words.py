"""Words, word hashes and word n-grams of whole texts, in numpy over Arrow buffers.

Every operator that looks at words inside a task uses these helpers.  A text
column arrives as an Arrow array; ``chunks`` cuts the batch into runs of whole
texts of about ``max_bytes`` (a longer text makes a run of its own), so the
arrays of a task stay small whatever the batch holds.  Separators are single
bytes below 0x80, so UTF-8 can be split byte by byte.

Hashes are 64-bit: a polynomial over a fixed random value per byte, finished
with a multiply-shift mix.  They are a function of the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
CHUNK_BYTES = 1 << 20


def _random_words(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values."""
    out, x = np.empty(n, np.uint64), seed
    for i in range(n):
        x = (x + _BASE) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out[i] = (z ^ (z >> 31)) | 1
    return out


_PLACE = _random_words(64, 7)
_BYTE_VALUE = _random_words(256, 11)


def space_separators() -> np.ndarray:
    """True for the bytes that end a word: 0x20 and 0x09 to 0x0D."""
    sep = np.zeros(256, bool)
    sep[0x20] = True
    sep[0x09:0x0E] = True
    return sep


def symbol_separators() -> np.ndarray:
    """True for every ASCII byte that is neither a digit nor a lower-case letter."""
    sep = np.zeros(256, bool)
    sep[0x00:0x30] = True
    sep[0x3A:0x61] = True
    sep[0x7B:0x80] = True
    return sep


def lower_ascii() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    low = np.arange(256, dtype=np.uint8)
    low[0x41:0x5B] += 32
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], np.uint64))[0])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a run of texts: ``start``/``end`` byte positions in ``data``,
    ``doc`` (text of each word), ``first`` (index of each text's first word, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.data = lower_ascii()[data] if lower else data
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        word = ~separators[self.data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        filled = offsets[1:] > offsets[:-1]
        edges = offsets[:-1][filled]
        begin[edges] = word[edges]
        edges = offsets[1:][filled] - 1
        end[edges] = word[edges]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self._word = word

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return span_hashes(self.data, self.start, self.end, self._word)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte span; spans ascend, don't overlap and hold a byte or more.

    ``inside`` marks the bytes that belong to spans (all bytes between the first start and the last end if None)."""
    low, high = int(start[0]), int(end[-1])
    span = np.diff(start, append=high)
    place = np.arange(high - low, dtype=np.int64) - np.repeat(start - low, span)
    longest = int((end - start).max())
    np.minimum(place, longest - 1, out=place)
    value = _BYTE_VALUE[data[low:high]]
    if inside is not None:
        value *= inside[low:high]
    powers = np.multiply.accumulate(np.full(longest, _BASE, np.uint64))
    value *= powers[place]
    total = np.add.reduceat(value, start - low)
    return mix(total ^ (end - start).astype(np.uint64))


def ngrams(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every window of n words inside one text."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total += word_hash[j:j + count] * _PLACE[j % len(_PLACE)]
    at = np.flatnonzero(doc[:count] == doc[n - 1:])
    return mix(total[at]), at


def chunks(column: pa.Array, separators: np.ndarray, lower: bool,
           max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of whole texts."""
    data, offsets = text_buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi, Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], separators, lower)
        lo = hi


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of (.., n) with the highest ``n``, at most ``most`` of them.

    A histogram of the counts (at most 16 levels for each power of two) gives the lowest level that still fits;
    nothing is sorted and no task meets more than its own rows.  ``counts`` is read twice: pass a stored table.
    """
    level = F.floor(F.log2("n") * 16)
    kept, lowest = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(),
                    key=lambda r: -r["level"]):
        if kept + r["rows"] > most:
            break
        kept, lowest = kept + r["rows"], r["level"]
    return counts.where(level >= lowest) if lowest is not None else counts.limit(0)


def signed(x: np.ndarray) -> np.ndarray:
    """Spark's bigint has no unsigned form."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def substring_hashes(data: np.ndarray, doc: np.ndarray, shortest: int,
                     longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash, start) of all substrings inside one text, length by length; equal bytes hash as words do."""
    total, power = np.zeros(len(data), np.uint64), _BASE
    value = _BYTE_VALUE[data]
    for n in range(1, min(longest, len(data)) + 1):
        total = total[:len(data) - n + 1] + value[n - 1:] * np.uint64(power)
        power = power * _BASE & _MASK
        if n >= shortest:
            at = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:])
            yield n, mix(total[at] ^ np.uint64(n)), at
