"""Conversation structure repair: the cheapest edits that give a conversation the form ``(system? (user assistant)+)?``.

The edits of a conversation are paths of a lattice: a node is (rows consumed, role of the last row kept or inserted) and
an edge is one edit.  Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty row) 5; a truncated row
that stays adds 5, a blank or repeated row must be deleted.  The audit is the string of the edits' initials; among the
cheapest paths the one with the ASCII-least audit is taken.

*Bidirectional Dijkstra*: one heap grows from the empty prefix, one from the end.  They have met when the sum of their
least keys exceeds the cheapest crossing found; every crossing of that cost has then been seen, since each node of a
cheapest path is settled from one side at least.  The least audit is read off by walking from the start over the nodes
that lie on cheapest paths, of all crossings at once, taking the least next initial.  (The cost of a path follows from
its audit, so no cheapest audit is the beginning of another one, and this walk finds the least concatenation without
writing out a string for each node.)

On Spark: one shuffle by conversation, sorted inside partitions by (conversation, turn, role, text), and one streaming
pass.  A conversation's rows need a few bytes each for the lattice and 16 bytes for the search for repeats; texts are
held up to ``HELD_BYTES``.  A conversation beyond that gets its audit in the first pass and its rows in a second one,
where the audit travels ahead of its rows and texts stream by, so a conversation of any length is repaired in bounded
memory.  Results are the same by either way.

Rows of one conversation follow their turn, a null turn first; ties go by role, then text (code points).  A null role or
text counts as one space.  A null conversation id is one conversation.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Texts of a conversation that a task holds before it leaves them to the second pass.
HELD_BYTES = 32 << 20
SPACES = " \t\n\x0b\x0c\r"

FINE, CUT_OFF, MUST_GO = 0, 1, 2            # what the lattice needs to know of a row's fault
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)   # the role that Insert and Rerole append
_BEFORE = ((), (), (_START, _SYSTEM, _ASSISTANT), (_USER,))
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_ADDS = {_USER: "u", _ASSISTANT: "a"}
_INF = 1 << 60


def _keeps(state: int, initial: str) -> int:
    """State after a kept row, -1 if it doesn't fit."""
    if _ADDS[_NEXT[state]] == initial:
        return _NEXT[state]
    return _SYSTEM if state == _START and initial == "s" else -1


def _forward(rows: list[str], faults: bytes | bytearray, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits (initial, cost, rows consumed, state) that leave a node."""
    yield "I", INSERT, at, _NEXT[state]
    if at < len(rows):
        yield "D", DELETE, at + 1, state
        if faults[at] != MUST_GO:
            extra = TRUNCATED if faults[at] == CUT_OFF else 0
            kept = _keeps(state, rows[at])
            if kept >= 0:
                yield "K", KEEP + extra, at + 1, kept
            yield "R", REROLE + extra, at + 1, _NEXT[state]


def _backward(rows: list[str], faults: bytes | bytearray, at: int, state: int) -> Iterator[tuple[int, int, int]]:
    """Edits (cost, rows consumed, state) that lead to a node."""
    for before in _BEFORE[state]:
        yield INSERT, at, before
    if at:
        yield DELETE, at - 1, state
        if faults[at - 1] != MUST_GO:
            extra = TRUNCATED if faults[at - 1] == CUT_OFF else 0
            for before in _BEFORE[state]:
                if _keeps(before, rows[at - 1]) == state:
                    yield KEEP + extra, at - 1, before
                yield REROLE + extra, at - 1, before
            if state == _SYSTEM and rows[at - 1] == "s":
                yield KEEP + extra, at - 1, _START


def cheapest_edits(rows: list[str], faults: bytes | bytearray) -> tuple[int, str]:
    """(cost, audit) of a conversation with these role initials and faults."""
    n = len(rows)
    fore, back = array("q", [_INF]) * (4 * n + 4), array("q", [_INF]) * (4 * n + 4)
    done_f, done_b = bytearray(4 * n + 4), bytearray(4 * n + 4)
    fore[_START] = 0
    ends = (4 * n + _START, 4 * n + _ASSISTANT)
    for e in ends:
        back[e] = 0
    heap_f, heap_b = [(0, _START)], [(0, e) for e in ends]
    heapq.heapify(heap_b)
    best = 0 if n == 0 else _INF
    while heap_f and heap_b and heap_f[0][0] + heap_b[0][0] <= best:
        if heap_f[0][0] <= heap_b[0][0]:
            cost, node = heapq.heappop(heap_f)
            if done_f[node]:
                continue
            done_f[node] = 1
            for _, step, at, state in _forward(rows, faults, node >> 2, node & 3):
                to = 4 * at + state
                if cost + step < fore[to]:
                    fore[to] = cost + step
                    heapq.heappush(heap_f, (cost + step, to))
                best = min(best, cost + step + back[to])
        else:
            cost, node = heapq.heappop(heap_b)
            if done_b[node]:
                continue
            done_b[node] = 1
            for step, at, state in _backward(rows, faults, node >> 2, node & 3):
                to = 4 * at + state
                if cost + step < back[to]:
                    back[to] = cost + step
                    heapq.heappush(heap_b, (cost + step, to))
                best = min(best, cost + step + fore[to])
    return best, _least_audit(rows, faults, best, fore, back, done_f, done_b)


def _least_audit(rows, faults, best: int, fore, back, done_f: bytearray, done_b: bytearray) -> str:
    """Least audit over all crossings of cost ``best`` between the two settled regions."""
    on_path, stack, ends = bytearray(len(fore)), [], {4 * len(rows) + _START, 4 * len(rows) + _ASSISTANT}
    for node in range(len(fore)):           # nodes settled from the start where a cheapest path crosses over or ends
        if done_f[node] and ((node in ends and fore[node] == best) or any(
                done_b[4 * at + state] and fore[node] + step + back[4 * at + state] == best
                for _, step, at, state in _forward(rows, faults, node >> 2, node & 3))):
            on_path[node] = 1
            stack.append(node)
    while stack:
        node = stack.pop()
        for step, at, state in _backward(rows, faults, node >> 2, node & 3):
            to = 4 * at + state
            if done_f[to] and not on_path[to] and fore[to] + step == fore[node]:
                on_path[to] = 1
                stack.append(to)
    audit, here, cost = [], {_START}, 0
    while not (cost == best and here & ends):
        found: dict[str, set[int]] = {}
        spent = {}
        for node in here:
            for initial, step, at, state in _forward(rows, faults, node >> 2, node & 3):
                to, c = 4 * at + state, cost + step
                if (on_path[to] and fore[to] == c) or (done_b[to] and c + back[to] == best):
                    found.setdefault(initial, set()).add(to)
                    spent[initial] = c
        least = min(found)
        audit.append(least)
        here, cost = found[least], spent[least]
    return "".join(audit)


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that stay or come new, in order; ``rows`` are (role, text)."""
    state = _START
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = next(rows) if edit != "I" else ("", "")
        state = _keeps(state, role[:1]) if edit == "K" else _NEXT[state]
        yield edit, (role if edit == "K" else _ROLE[state]), text


class _Conversation:
    """What one conversation needs while its rows stream by."""

    def __init__(self, key, most: int):
        self.key, self.most = key, most
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.held, self.bytes = [], 0
        self.blank = self.duplicate = self.truncated = self.distinct = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str, blank: bool, ended: bool, digest: bytes) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        repeat = digest in self.seen
        self.seen.add(digest)
        self.blank += blank
        self.duplicate += repeat and not blank
        self.truncated += not (blank or repeat or ended)
        self.initials.append(role[:1])
        self.faults.append(MUST_GO if blank or repeat else FINE if ended else CUT_OFF)
        if self.held is not None:
            self.held.append((role, text))
            self.bytes += len(role) + len(text) + 150
            if self.bytes > self.most:
                self.held = None

    def close(self) -> dict:
        cost, audit = cheapest_edits(self.initials, self.faults)
        pairs = zip(self.initials, self.initials[1:])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"key": self.key, "gaps": min(gaps, (1 << 63) - 1), "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
                "cost": cost, "audit": audit, "rows": len(self.initials)}


_FACTS = "key long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows long"
_ROWS = "key long, place long, edit string, role string, text string"


def _digest(rows: Iterator[tuple[str, str, str]]) -> str:
    total, first = hashlib.sha256(), True
    for _, role, text in rows:
        total.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    return total.hexdigest()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_FACTS_ARROW = pa.schema([("key", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                          ("audit", pa.string()), ("rows", pa.int64()), ("sha256", pa.string())])
_OUT_ROWS, _OUT_BYTES = 4096, 4 << 20


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def _prepared(rows: DataFrame, id_col: str, order_col: str, role_col: str, text_col: str, gone: Column) -> DataFrame:
    ended = F.rtrim(F.coalesce(F.col(text_col), F.lit(" ")), F.lit(SPACES))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(
        F.col(id_col).cast("long").alias("key"), gone.alias("gone"), F.col(order_col).cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), (ended == "").alias("blank"), F.right(ended, F.lit(1)).isin(".", "!", "?").alias("ended"),
        F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text))).alias("digest"))


def _ordered(rows: DataFrame, *keys) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *keys, F.asc_nulls_first("turn"), "role", "text")


def _first_pass(rows: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, talk, size = [], None, 0

        def close(talk: _Conversation) -> dict:
            facts = talk.close()
            return facts | {"sha256": None if talk.held is None else _digest(repaired_rows(facts["audit"], iter(talk.held)))}

        for key, gone, turn, role, text, blank, ended, digest in _values(batches):
            if talk is None or key != talk.key:
                if talk is not None:
                    out.append(close(talk))
                    size += len(out[-1]["audit"])
                    if len(out) >= _OUT_ROWS or size >= _OUT_BYTES:
                        yield _batch(out, _FACTS_ARROW)
                        out, size = [], 0
                talk = _Conversation(key, most)
            if not gone:
                talk.add(turn, role, text, blank, ended, digest)
        if talk is not None:
            out.append(close(talk))
        yield _batch(out, _FACTS_ARROW)

    return _ordered(rows, F.desc("gone")).mapInArrow(run, _FACTS + ", sha256 string")


def _second_pass(facts: DataFrame, rows: DataFrame, digest: bool) -> DataFrame:
    """Rows of the conversations of ``facts``, each behind its audit: their digest, or the repaired rows themselves."""
    ahead = facts.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"))
    wanted = facts.select(F.col("key").alias("_key"))
    there = rows.where("not gone").join(wanted, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    both = ahead.unionByName(there.select("key", F.lit(1).alias("kind"), "turn", "role", "text"))
    schema = pa.schema([("key", pa.int64()), ("sha256", pa.string())]) if digest else \
        pa.schema([("key", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, stream = [], 0, _values(batches)
        for key, _, _, _, audit in stream:          # the audit says how many rows of the stream follow it
            found = repaired_rows(audit, ((role, text) for _, _, _, role, text in stream))
            if digest:
                out.append({"key": key, "sha256": _digest(found)})
            else:
                for place, (edit, role, text) in enumerate(found):
                    out.append({"key": key, "place": place, "edit": edit, "role": role, "text": text})
                    size += len(text)
                    if len(out) >= _OUT_ROWS or size >= _OUT_BYTES:
                        yield _batch(out, schema)
                        out, size = [], 0
            if len(out) >= _OUT_ROWS:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)

    return _ordered(both, "kind").mapInArrow(run, "key long, sha256 string" if digest else _ROWS)


def repair_report(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", gone: Column | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows where ``gone`` holds only keep their conversation in the result.
    """
    rows = _prepared(rows, id_col, order_col, role_col, text_col, F.lit(False) if gone is None else gone)
    facts = materialize(_first_pass(rows, held_bytes), "repair-facts")
    long = facts.where("sha256 is null")
    done = facts.where("sha256 is not null")
    if not long.isEmpty():
        digests = _second_pass(long, rows, True).select(F.col("key").alias("_key"), F.col("sha256").alias("_sha256"))
        done = done.unionByName(long.join(digests, F.col("key").eqNullSafe(F.col("_key")))
                                .withColumn("sha256", F.col("_sha256")).drop("_key", "_sha256"))
    return done.select(F.col("key").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       F.col("sha256").alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired rows: id, place from 0, edit (K, R or I), role, text.  Conversations without any row left have none."""
    rows = _prepared(rows, id_col, order_col, role_col, text_col, F.lit(False) if gone is None else gone)
    facts = materialize(_first_pass(rows, 0).select("key", "audit"), "repair-facts")
    return _second_pass(facts, rows, False).select(
        F.col("key").alias(id_col), "place", "edit", F.col("role").alias(role_col), F.col("text").alias(text_col))


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20; adds ``dropped``.

    0: dropped; 1: empty text; 2: no ``.!?``; 3: twice; 4: role user.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    out = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    return out.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
