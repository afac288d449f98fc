"""Quality rules on repetition inside a text: coverage by duplicated n-grams and lines.

For several n-gram lengths, a rolling hash of the words marks every n-gram
that occurred before in the same text; the characters of the marked words,
over all word characters, are the text's coverage at that length (overlapping
n-grams count a character once).  Lines are compared whole.  A text is kept if
it passes the base rules and no coverage is above its limit.

Everything is computed in numpy inside the partition that holds the text; no
shuffle.  Null text has no words; a text without words fails ``min_words``.
Columns of the input other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits; the coverage limits per length follow published repetition filters for web text."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    coverage: dict = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_coverage: float = 0.20
    line_fraction: float = 0.30


def _marks(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, any): the key occurred before in the same text; the key occurs twice or more in it."""
    own = key ^ W.mix(doc.astype(np.uint64))
    ranked = np.sort(own)
    repeated = ranked[1:][ranked[1:] == ranked[:-1]]
    later = np.zeros(len(key), bool)
    if not len(repeated):
        return later, later
    again = np.isin(own, repeated)
    at = np.flatnonzero(again)
    order = np.argsort(own[at], kind="stable")        # equal keys stay in text order
    same = own[at][order][1:] == own[at][order][:-1]
    later[at[order[1:][same]]] = True
    return later, again


def _cover(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Words inside a window that starts at one of ``at``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def _per_doc(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _lines(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end, hash) of the lines that hold a word."""
    data, none = words.data, np.zeros(0, np.int64)
    if not len(words):
        return none, none, none, np.zeros(0, np.uint64)
    newline = np.flatnonzero(data == 0x0A)
    cuts = np.unique(np.concatenate([newline, words.offsets]))          # a line ends at \n or with its text
    line = np.unique(np.searchsorted(cuts, words.start, "right"))       # cuts[line-1] <= first byte < cuts[line]
    begin = cuts[line - 1]
    begin = np.where(data[np.minimum(begin, len(data) - 1)] == 0x0A, begin + 1, begin)
    end = cuts[line]
    doc = np.searchsorted(words.offsets, begin, "right") - 1
    # texts may start with a \n that is no line of theirs; hash exactly the bytes of each line
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    key = W.span_hashes(data, begin, end, np.cumsum(inside[:-1], dtype=np.int8).astype(bool))
    return doc, begin, end, key


def measure(words: W.Words, rules: Rules) -> dict[str, np.ndarray]:
    """Counts, coverages and verdicts of a run of texts."""
    first, n = words.first, len(words)
    lead = (words.data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    chars = points[words.end] - points[words.start]
    out = {"n_words": words.counts, "word_chars": _per_doc(chars, first)}
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    symbol = np.concatenate([[0], np.cumsum(marks[words.data], dtype=np.int64)])
    out["n_symbols"] = symbol[words.offsets[1:]] - symbol[words.offsets[:-1]]

    doc, begin, end, key = _lines(words)
    repeated, _ = _marks(key, doc)
    out["n_dup_lines"] = np.bincount(doc[repeated], minlength=words.n_docs)
    n_lines = np.bincount(doc, minlength=words.n_docs)
    length = points[end] - points[begin]
    dup_chars = np.bincount(doc[repeated], length[repeated], words.n_docs)
    line_chars = np.bincount(doc, length, words.n_docs)

    h = words.hashes()
    key, at = W.ngrams(h, words.doc, rules.repeat_window)
    _, twice = _marks(key, words.doc[at])
    out["n_repeat_words"] = _per_doc(_cover(n, at[twice], rules.repeat_window), first)
    out["base_failed"] = ((out["n_words"] < rules.min_words)
                          | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"]))

    bad = np.zeros(words.n_docs, bool)
    whole = np.maximum(out["word_chars"], 1)
    for size, limit in rules.coverage.items():
        key, at = W.ngrams(h, words.doc, size)
        again, _ = _marks(key, words.doc[at])
        share = _per_doc(np.where(_cover(n, at[again], size), chars, 0), first) / whole
        out[f"coverage_{size}"] = share
        bad |= share > limit
    out["line_coverage"] = dup_chars / np.maximum(line_chars, 1)
    out["line_fraction"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    bad |= (out["line_coverage"] > rules.line_coverage) | (out["line_fraction"] > rules.line_fraction)
    out["kept"] = ~(bad | out["base_failed"])
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every text: one row per input row."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [*(f"coverage_{n}" for n in rules.coverage), "line_coverage", "line_fraction"]
    names = [id_col, *longs, "base_failed", "kept", *shares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = W.space_separators()
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(1), sep, False):
                m = measure(words, rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(m[c], pa.int64()) for c in longs),
                     pa.array(m["base_failed"]), pa.array(m["kept"]), *(pa.array(m[c], pa.float64()) for c in shares)],
                    names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in longs), "base_failed boolean", "kept boolean",
                        *(f"{c} double" for c in shares)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
