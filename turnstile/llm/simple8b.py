"""Simple-8b coding of token ids, word aligned, in numpy.

A 64-bit word holds a 4-bit selector and 60 bits of data; the selector says
how many values the word packs and in how many bits each.  Values are coded in
blocks of ``BLOCK`` ids that start on a word of their own, so blocks decode
independently; ids are first mapped to their rank by frequency in the segment,
and ids outside the ``RANKS`` most frequent are *escapes*: value 0 in the
words, the id itself in a list of 32-bit values beside them.

Segment layout, little-endian:
  8 x uint32   magic, number of ids, of blocks, of words, of ranks, of escapes, ids per block, 0
  uint32       offset of the first word of each block, and the end
  uint32       offset of the first escape of each block, and the end
  uint32       id of each rank, from value 1
  uint32       escapes
  (pad to 8)   uint64 words
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x53384254
BLOCK, RANKS = 1024, 4095
# Values per word and bits per value of selectors 0 to 13.
PER_WORD = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20)
_FIRST = 2          # values are escapes or ranks: runs of 120 or 240 equal zeros aren't coded


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each id, id of each rank, escapes in order)."""
    count = np.bincount(ids) if len(ids) and ids.max() < (1 << 24) else None
    if count is None:
        known, inverse, n = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        known = np.flatnonzero(count)
        n = count[known]
        place = np.zeros(len(count), np.int32)
        place[known] = np.arange(len(known))
        inverse = place[ids]
    order = np.lexsort((known, -n))[:RANKS]
    value = np.zeros(len(known), np.uint16)
    value[order] = np.arange(1, len(order) + 1)
    values = value[inverse]
    return values, known[order].astype("<u4"), ids[values == 0].astype("<u4")


def encode(ids: np.ndarray) -> bytes:
    """One segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values, ranks, escapes = _ranked(ids)
    padded = np.zeros((blocks, BLOCK), np.uint16)
    padded.reshape(-1)[:n] = values
    # how many of the widths are too small for each value; 0 means the first width fits
    every = np.arange(RANKS + 1)
    need = sum(((every >> b) > 0).astype(np.uint8) for b in BITS[_FIRST:])[padded]
    # then the most of the next m values, by doubling, for every position
    best = np.full((blocks, BLOCK), len(BITS) - 1, np.uint8)
    wide, widths = {1: need}, 1
    for s in range(len(BITS) - 1, _FIRST - 1, -1):
        m = PER_WORD[s]
        while widths * 2 <= m:
            w = wide[widths]
            longer = w.copy()
            np.maximum(longer[:, :-widths], w[:, widths:], out=longer[:, :-widths])
            widths *= 2
            wide[widths] = longer
        w = wide[widths]
        top = w.copy()
        if m > widths:
            shift = m - widths
            np.maximum(top[:, :-shift], w[:, shift:], out=top[:, :-shift])
        best[top <= s - _FIRST] = s
    per_word = np.array(PER_WORD)
    # walk all blocks side by side: one word of each block a step
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    starts, rows = [], []
    while len(row):
        starts.append(at)
        rows.append(row)
        at = at + per_word[best[row, at]]
        going = at < BLOCK
        if blocks:
            going &= row * BLOCK + at < n
        at, row = at[going], row[going]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    selector = best[row, start].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    flat = np.concatenate([padded.reshape(-1), np.zeros(max(PER_WORD), np.uint16)]).astype(np.uint64)
    for s in range(_FIRST, len(BITS)):
        pick = np.flatnonzero(selector == s)
        if not len(pick):
            continue
        begin, left = row[pick] * BLOCK + start[pick], BLOCK - start[pick]
        for j in range(PER_WORD[s]):
            inside = j < left
            words[pick] |= np.where(inside, flat[begin + j], np.uint64(0)) << np.uint64(j * BITS[s])
    word_at = np.searchsorted(row, np.arange(blocks + 1)).astype("<u4")
    escape_at = np.concatenate([[0], np.cumsum(np.add.reduceat(values == 0, np.arange(0, n, BLOCK)))
                                if n else np.zeros(0)]).astype("<u4")
    head = np.array([MAGIC, n, blocks, len(words), len(ranks), len(escapes), BLOCK, 0], "<u4")
    body = b"".join(x.tobytes() for x in (head, word_at, escape_at, ranks, escapes))
    return body + bytes(-len(body) % 8) + words.astype("<u8").tobytes()


def decode(segment: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """Ids (uint32) of a segment, or of a run of its blocks."""
    magic, n, blocks, n_words, n_ranks, n_escapes, block, _ = np.frombuffer(segment, "<u4", 8).tolist()
    if magic != MAGIC:
        raise ValueError("not a token segment")
    last_block = blocks if last_block is None else last_block
    sizes = (blocks + 1, blocks + 1, n_ranks, n_escapes)
    ends = 8 + np.cumsum((0, *sizes))
    word_at, escape_at, ranks, escapes = (np.frombuffer(segment, "<u4", c, 4 * int(e)) for c, e in zip(sizes, ends))
    at = 4 * int(ends[-1])
    w0, w1 = int(word_at[first_block]), int(word_at[last_block])
    words = np.frombuffer(segment, "<u8", w1 - w0, at + -at % 8 + 8 * w0)
    selector = (words >> np.uint64(60)).astype(np.int64)
    ids_before = first_block * block
    total = min(n, last_block * block) - ids_before
    # a block's words add up to the block or more; what the last word holds beyond it is padding
    count = np.array(PER_WORD)[selector]
    home = np.repeat(np.arange(first_block, last_block), np.diff(word_at[first_block:last_block + 1].astype(np.int64)))
    run = np.cumsum(count) - count
    begin = run - run[(word_at[home] - w0).astype(np.int64)] + (home - first_block) * block if len(home) else run
    out = np.zeros(total + max(PER_WORD), np.uint64)
    for s in range(_FIRST, len(BITS)):
        pick = np.flatnonzero(selector == s)
        if not len(pick):
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        end = np.minimum((home[pick] - first_block + 1) * block, total)
        for j in range(PER_WORD[s]):
            to = begin[pick] + j
            inside = to < end
            out[to[inside]] = (words[pick[inside]] >> np.uint64(j * BITS[s])) & mask
    values = out[:total].astype(np.int64)
    table = np.concatenate([[0], ranks]).astype("<u4")
    ids = table[values]
    ids[values == 0] = escapes[int(escape_at[first_block]):int(escape_at[last_block])]
    return ids
