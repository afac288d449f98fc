"""Tokenizer comparison over vocabulary files (AGG4): characters for each token, one scan for all of them.

Encoding takes the time, so texts are cut where no token can lie across (before a space that follows a character that is
no white space), equal pieces of the whole corpus are brought together with their number, and every different piece is
encoded once by each tokenizer whose counts add up over such pieces (``adds_over_pieces`` looks at its file).  Other
tokenizers encode whole texts.  Each tokenizer is built once in a worker process from the bytes of its file, which travel
as a broadcast (vocabularies are a few megabytes; workers need not see the driver's files).  Results are kept by the *fingerprint* of a file and the fingerprint of the texts, not
by a name, so a changed file is measured again and a copy under another name is not.

Texts are encoded without special tokens; a null text is no text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worker import get_or_build

# Different pieces (and their characters) that a task holds before it passes them on.
TASK_PIECES, TASK_CHARS = 200_000, 1 << 24
# The sign that sentencepiece has for a space counts as one.
_CUT = re.compile(r"(?<=[^\s\u2581])(?= )")
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RESULT = "fingerprint string, corpus string, tokenizer string, vocab_size long, n_chars long, n_tokens long"


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file: ``.json`` (tokenizers), ``.model`` (sentencepiece) or ``.tiktoken`` ranks with their pattern."""

    name: str
    path: str
    pattern: str | None = None

    def content(self) -> bytes:
        with open(self.path, "rb") as f:
            return f.read()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.content() + self.path.rsplit(".", 1)[1].encode() + (self.pattern or "").encode()).hexdigest()


def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def counter_of(kind: str, content: bytes, pattern: str | None) -> tuple[int, Callable[[list[str]], list[int]]]:
    """(vocabulary size, token counts of a list of texts)."""
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer.get_vocab_size(), lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == "model":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_proto=content)
        return pieces.get_piece_size(), lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    if kind == "tiktoken":
        from tiktoken import Encoding

        ranks = _ranks(content)
        encoding = Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return len(ranks), lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    raise ValueError(f"vocabulary files end in .json, .model or .tiktoken, not .{kind}")


def adds_over_pieces(kind: str, content: bytes, pattern: str | None) -> bool:
    """Is a text's count the sum over its pieces?  Known splitters only: none has a match that runs on into a space."""
    if kind == "tiktoken":
        return pattern == _GPT2
    if kind == "model":
        from ..llm.tokencounts import _cuts_at_spaces

        return _cuts_at_spaces(content)
    if kind != "json":
        return False
    found = json.loads(content)
    splitter, normal, model = found.get("pre_tokenizer") or {}, found.get("normalizer"), found["model"]
    if (model.get("type") != "BPE" or model.get("dropout") or found.get("post_processor") is not None
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in found["added_tokens"])):
        return False
    if splitter.get("type") == "ByteLevel":
        return normal is None and splitter["use_regex"] and not splitter["add_prefix_space"]
    steps = splitter.get("pretokenizers") or []
    words = (len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": _WORDS}
             and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
             and steps[1].get("type") == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"])
    plain = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    return bool(words) and all(x in plain for x in (normal or {}).get("normalizers", [None] if normal else []))


def _piece_counts(kind: str, count: Callable[[list[str]], list[int]]) -> Callable[[list[str], list[bool]], list[int]]:
    """Token counts of pieces; ``first``: does the piece begin its text?"""
    if kind != "model":
        return lambda pieces, first: count(pieces)
    with_space, without = count(["a ", "a"])                # the library puts a space in front of every text

    def run(pieces: list[str], first: list[bool]) -> list[int]:
        bare = [p if f else p[1:] for p, f in zip(pieces, first)]
        return [n if b or f else with_space - without for n, b, f in zip(count(bare), bare, first)]

    return run


def text_pieces(df: DataFrame, text_col: str) -> DataFrame:
    """``first, piece, n``: the different pieces of all texts and how often they stand there; joined, they give the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, others, chars = Counter(), Counter(), 0

        def held() -> Iterator[pa.RecordBatch]:
            for first, found in ((True, begins), (False, others)):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([first] * len(found)), pa.array(found.keys(), pa.string()),
                                                      pa.array(found.values(), pa.int64())], ["first", "piece", "n"])
                found.clear()

        for batch in batches:
            for text in batch.column(0):
                pieces = _CUT.split(text.as_py())
                begins[pieces[0]] += 1
                others.update(pieces[1:])
                chars += len(pieces[0])
                if len(others) + len(begins) > TASK_PIECES or chars > TASK_CHARS:
                    yield from held()
                    chars = 0
        yield from held()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "first boolean, piece string, n long")
    # as many tasks as that, however small the pieces are: encoding takes much longer than reading them
    return found.repartition(n, "first", "piece").groupBy("first", "piece").agg(F.sum("n").alias("n"))


def corpus_fingerprint(df: DataFrame, text_col: str) -> str:
    """Of the texts, in any order: their number and the sum of their hashes."""
    n, h = df.where(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)), F.sum(F.xxhash64(text_col).cast("decimal(38,0)"))).first()
    return f"{n}-{h or 0}"


def measure_vocabularies(df: DataFrame, text_col: str, vocabularies: Sequence[Vocabulary], cache: DataFrame | None = None,
                         corpus: str | None = None) -> DataFrame:
    """``fingerprint, corpus, tokenizer, vocab_size, n_chars, n_tokens`` of the vocabularies that ``cache`` lacks.

    ``cache`` holds earlier results of this function; a result counts for a file and a corpus of the same fingerprints.
    """
    spark = df.sparkSession
    corpus = corpus_fingerprint(df, text_col) if corpus is None else corpus
    wanted = {v.fingerprint: v for v in reversed(vocabularies)}
    if cache is not None:
        done = cache.where((F.col("corpus") == corpus) & F.col("fingerprint").isin(list(wanted))).select("fingerprint").distinct()
        for row in done.collect():                      # at most one row a vocabulary
            wanted.pop(row["fingerprint"])
    if not wanted:
        return spark.createDataFrame([], RESULT)
    files = spark.sparkContext.broadcast([(mark, v.path.rsplit(".", 1)[1], v.content(), v.pattern) for mark, v in wanted.items()])

    additive = {mark for mark, kind, content, pattern in files.value if adds_over_pieces(kind, content, pattern)}

    def counters(pieces: bool) -> list:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return [(mark, kind, get_or_build(f"vocabulary:{mark}", lambda k=kind, c=content, p=pattern: counter_of(k, c, p))[1])
                for mark, kind, content, pattern in files.value if (mark in additive) == pieces]

    def summed(marks: list[str], chars: int, sums: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"fingerprint": marks, "n_chars": [chars] * len(marks), "n_tokens": sums},
                                          schema=pa.schema([("fingerprint", pa.string()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())]))

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(mark, _piece_counts(kind, count)) for mark, kind, count in counters(True)]
        sums, chars = [0] * len(found), 0
        for batch in batches:
            first, pieces, n = (c.to_pylist() for c in batch.columns)
            chars += sum(k * len(p) for k, p in zip(n, pieces))
            for i, (_, count) in enumerate(found):
                sums[i] += sum(k * x for k, x in zip(n, count(pieces, first)))
        yield summed([mark for mark, _ in found], chars, sums)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counters(False)
        sums, chars = [0] * len(found), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            chars += sum(map(len, texts))
            for i, (_, _, count) in enumerate(found):
                sums[i] += sum(count(texts))
        yield summed([mark for mark, _, _ in found], chars, sums)

    schema, parts = "fingerprint string, n_chars long, n_tokens long", []
    if additive:
        parts.append(text_pieces(df, text_col).mapInArrow(of_pieces, schema))
    if len(additive) < len(wanted):
        parts.append(df.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(of_texts, schema))
    parts = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).groupBy("fingerprint").agg(
        F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    names = spark.createDataFrame([(mark, v.name, counter_of(kind, content, pattern)[0]) for (mark, v), (_, kind, content, pattern)
                                   in zip(wanted.items(), files.value)], "fingerprint string, tokenizer string, vocab_size long")
    zero = F.lit(0).cast("long")
    return (names.join(parts, "fingerprint", "left")
            .select("fingerprint", F.lit(corpus).alias("corpus"), "tokenizer", "vocab_size", F.coalesce("n_chars", zero).alias("n_chars"),
                    F.coalesce("n_tokens", zero).alias("n_tokens")))


def efficiency(measured: DataFrame) -> DataFrame:
    """``tokenizer, vocab_size, n_chars, n_tokens, chars_per_token``, best first; no tokens give 0."""
    ratio = F.coalesce(F.col("n_chars") / F.nullif(F.col("n_tokens"), F.lit(0)), F.lit(0.0))
    return (measured.select("tokenizer", "vocab_size", "n_chars", "n_tokens", ratio.alias("chars_per_token"))
            .orderBy(F.desc("chars_per_token"), "tokenizer"))
