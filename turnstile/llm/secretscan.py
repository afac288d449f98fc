"""Secret scans: wide candidate patterns, then a random forest that removes false positives.

Candidates are known key formats, values assigned to a name that is or ends in
a word like ``password`` (quoted or not, blanks around the sign or not), and any
long run of key characters.  Each is described by its length, how
unusual its character transitions are in this corpus, how often its character
class changes, the share of its characters inside dictionary words (the most
frequent words of the corpus), its digits, repeats and words of a stand-in, its
path, and its neighbouring words.  The forest is trained on labelled findings,
at most ``SAMPLE`` of each class (those with the smallest hash), and scores all.

The labels are a table of lines in which the value is known to be a secret or
not (``secret_labels``: named, announced and bare secrets; digests, ids, long
words, versions, example keys, calls and prose).  They don't follow from the
pattern that finds a candidate, so assigned values can be turned down and bare
runs accepted.  The lines are described with the statistics of the corpus at
hand.  Other labels can be passed.

Parameters that bound what is looked at: the ``DICTIONARY`` most frequent words
of ``SHORTEST`` to ``LONGEST`` bytes, and the words that begin within
``CONTEXT`` characters of a candidate.

Statistics (transitions, words) are counted over all texts.  Null text has no
findings; a null path is the empty path; without labels of both classes every
candidate counts as a secret with a null score.  Repeated rows repeat their
findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import secret_labels
from . import words as W

SAMPLE, DICTIONARY = 4000, 20_000
SHORTEST, LONGEST = 3, 10              # bytes of dictionary words looked for inside a candidate
CONTEXT, LABELLED_LINES = 40, 6000
FLUSH_WORDS = 1 << 21
FEATURES = ("length", "transitions", "changes", "coverage", "path_depth", "path_sample", "named", "word_before", "word_after",
            "digits", "distinct", "hex", "parts", "stand_in", "announced", "public", "format")

# Public key formats and the names that announce a secret.
FORMAT = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})"
NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
# A name may end a longer one (DB_PASSWORD, conf/client.secret); the lookahead passes over words without a sign at once.
_NAME = (r"(?:(?<![\w.+/-])(?=[\w.+/-]*+[\"']?\s*+[=:])[\w.+/-]*?|(?<![A-Za-z0-9_]))" rf"(?i:{NAMES})")
_FORMAT = rf"(?<![A-Za-z0-9_])(?P<format>{FORMAT})(?![A-Za-z0-9])"
_RUN = r"(?<![A-Za-z0-9_])(?<![+/-])(?P<run>[A-Za-z0-9+/_-]{16,})"
_CANDIDATE = re.compile(rf"{_FORMAT}|(?P<name>{_NAME})[\"']?\s*[=:]\s*[\"']?(?P<value>[^\s\"',;]{{6,}})|{_RUN}")
_UNNAMED = re.compile(rf"{_FORMAT}|{_RUN}")
_STAND_IN = re.compile(r"(?i)example|sample|test|dummy|change|your|x{4}|\*{3}|[<>${}()\[\];]|\.[a-z]+\.")
_ANNOUNCE = re.compile(r"(?i)(?:key|token|bearer|auth|secret|credential|password|passwd|pwd|login|with|is)\W*$")
_PUBLIC = re.compile(r"(?i)(?:commit|sha\d*|md5|checksum|digest|hash|etag|revision|uuid|id|request|object|version|release|build|image|user)\W*$")


def _classes() -> np.ndarray:
    """Character class of every byte: 26 lower, 26 upper, 10 digits, space, other ASCII, non-ASCII (65 in all)."""
    out = np.full(256, 63, np.int64)
    out[0x61:0x7B] = np.arange(26)
    out[0x41:0x5B] = 26 + np.arange(26)
    out[0x30:0x3A] = 52 + np.arange(10)
    out[0x09:0x0E] = out[0x20] = 62
    out[0x80:] = 64
    return out


N_CLASSES = 65


def transitions(docs: DataFrame, text_col: str) -> np.ndarray:
    """log P(next class | class) over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, kind, total = W.space_separators(), _classes(), np.zeros(N_CLASSES * N_CLASSES, np.int64)
        for batch in batches:
            for _, _, words in W.chunks(batch.column(0), sep, False):
                c = kind[words.data]
                total += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["pair", "n"])

    found = docs.select(text_col).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.ones(N_CLASSES * N_CLASSES)
    table[found["pair"].to_numpy()] += found["n"].to_numpy()
    table = table.reshape(N_CLASSES, N_CLASSES)
    return np.log(table / table.sum(1, keepdims=True))


def dictionary(docs: DataFrame, text_col: str, size: int = DICTIONARY) -> np.ndarray:
    """Sorted hashes of the most frequent words of SHORTEST to LONGEST bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, held, n_held = W.symbol_separators(), [], 0
        sep[0x30:0x3A] = True                        # letters only

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(W.signed(key)), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            for _, _, words in W.chunks(batch.column(0), sep, True):
                length = words.end - words.start
                held.append(words.hashes()[(length >= SHORTEST) & (length <= LONGEST)])
                n_held += len(held[-1])
                if n_held >= FLUSH_WORDS:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    counts = materialize(docs.select(text_col).mapInArrow(run, "key long, n long").groupBy("key")
                         .agg(F.sum("n").alias("n")), "secret-words")
    found = W.most_frequent(counts, size).select("key").toArrow()
    return np.sort(W.unsigned(found["key"].to_numpy()))


def _member(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(key), bool)
    return words[np.minimum(np.searchsorted(words, key), len(words) - 1)] == key


def _coverage(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Share of each span's bytes that lie in a dictionary word."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    step = np.zeros(len(data) + 1, np.int64)
    for n, key, at in W.substring_hashes(data, doc, SHORTEST, LONGEST):
        hit = at[_member(key, words)]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + n, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return (inside[offsets[1:]] - inside[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _first_word_known(texts: list[str], words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    sep = W.symbol_separators()
    for lo, _, w in W.chunks(pa.array(texts, pa.string()), sep, True):
        some = w.counts > 0
        if some.any():
            out[lo + np.flatnonzero(some)] = _member(w.hashes()[w.first[:-1][some]], words)
    return out


def _describe(values: list[str], paths: list[str], named: list[bool], before: list[str], after: list[str],
              logs: np.ndarray, words: np.ndarray) -> np.ndarray:
    data, offsets = W.text_buffers(pa.array(values, pa.string()))
    kind = _classes()[data]
    group = np.digitize(kind, (26, 52, 62))
    edge = np.ones(max(len(data) - 1, 0), bool)
    edge[offsets[1:-1] - 1] = False                   # pairs across two candidates
    pair = np.concatenate([[0], np.cumsum(np.where(edge, logs[kind[:-1], kind[1:]], 0.0))])
    change = np.concatenate([[0], np.cumsum(edge & (group[:-1] != group[1:]))])
    size = np.diff(offsets)
    a, b = offsets[:-1], offsets[1:] - 1
    low = W.lower_ascii()[data]
    span = np.maximum(size, 1)
    digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    hexa = np.concatenate([[0], np.cumsum(((data >= 0x30) & (data <= 0x39)) | ((low >= 0x61) & (low <= 0x66)))])
    return np.stack([
        size, (pair[b] - pair[a]) / np.maximum(size - 1, 1), (change[b] - change[a]) / np.maximum(size - 1, 1),
        _coverage(low, offsets, words), [p.count("/") for p in paths],
        [bool(re.search(r"(?i)test|example|sample|doc", p)) for p in paths], named,
        _first_word_known(before, words), _first_word_known(after, words),
        (digit[offsets[1:]] - digit[a]) / span, [len(set(v)) / max(len(v), 1) for v in values], hexa[offsets[1:]] - hexa[a] == size,
        [len(re.findall(r"[-_/.]", v)) for v in values], [bool(_STAND_IN.search(v)) for v in values],
        [bool(_ANNOUNCE.search(w)) for w in before], [bool(_PUBLIC.search(w)) for w in before],
        [bool(re.fullmatch(FORMAT, v)) for v in values]], 1).astype(float)


def _candidates(text: str) -> Iterator[re.Match]:
    """Candidates that don't overlap; the words before a sign are searched too."""
    for m in _CANDIDATE.finditer(text):
        if m.lastgroup == "value":
            yield from _UNNAMED.finditer(text, m.start(), m.end("name"))
        yield m


def statistics(docs: DataFrame, text_col: str = "text"):
    """(transitions, dictionary) of the corpus, broadcast."""
    spark = docs.sparkSession
    return spark.sparkContext.broadcast(transitions(docs, text_col)), spark.sparkContext.broadcast(dictionary(docs, text_col))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", stats=None) -> DataFrame:
    """One row per candidate: id, start, end (characters), kind, value, features; ``stats`` are those of ``docs`` by default."""
    logs, words = stats or statistics(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for m in _candidates(text or ""):
                    kind = m.lastgroup
                    a, b = m.span(kind)
                    head = text[max(0, m.start() - CONTEXT):m.start()].split()
                    tail = text[b:b + CONTEXT].split()
                    ids.append(i)
                    found.append((a, b, kind, text[a:b], path or "", kind == "value",
                                  head[-1] if head else "", tail[0] if tail else ""))
            for lo in range(0, len(found), 4096):
                part = found[lo:lo + 4096]
                start, end, kind, value, path, named, before, after = map(list, zip(*part))
                f = _describe(value, path, named, before, after, logs.value, words.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids[lo:lo + 4096])), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                     pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(f.tolist(), pa.list_(pa.float64()))],
                    [id_col, "start", "end", "kind", "value", "features"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, end long, kind string, value string, features array<double>"
    return docs.select(id_col, text_col, F.col(path_col).cast("string")).mapInArrow(run, schema)


def labelled_findings(spark, stats, lines=None) -> DataFrame:
    """Findings of labelled lines (line, path, value, is it a secret) with ``secret`` 1.0 or 0.0.

    A candidate that holds the value, or most of it, has its label; any other candidate of the line is no secret.
    """
    lines = list(secret_labels.labelled_lines(LABELLED_LINES) if lines is None else lines)
    table = spark.createDataFrame([(i, t, p, v, float(s)) for i, (t, p, v, s) in enumerate(lines)],
                                  "_line long, text string, source string, _value string, _secret double")
    found = findings(table, "_line", "text", "source", stats).join(table.select("_line", "_value", "_secret"), "_line")
    about = F.contains("_value", "value") & (2 * F.length("value") >= F.length("_value")) | F.contains("value", "_value")
    return found.select("_line", "kind", "value", "features", F.when(about, F.col("_secret")).otherwise(0.0).alias("secret"))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 6,
          seed: int = 5) -> RandomForestClassificationModel | None:
    """Forest over a bounded sample of each class; None without both."""
    rows = []
    for secret in (0.0, 1.0):
        rows += (labelled.where(F.col("secret") == secret).select("features", "secret", F.xxhash64("value").alias("h"))
                 .orderBy("h", "features").limit(sample).collect())           # bounded by ``sample``
    if len({r["secret"] for r in rows}) < 2:
        return None
    few = (labelled.sparkSession.createDataFrame([(r["features"], r["secret"]) for r in rows], "features array<double>, secret double")
           .coalesce(1).select(array_to_vector("features").alias("vector"), "secret").cache())
    model = RandomForestClassifier(featuresCol="vector", labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed,
                                   probabilityCol="chance").fit(few)
    few.unpersist()
    return model


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
                 threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate with score and verdict: id, start, end, kind, value, score, is_secret.

    ``labelled`` has the columns value, features, secret; by default the lines of ``secret_labels``.
    """
    stats = statistics(docs, text_col)
    found = findings(docs, id_col, text_col, path_col, stats)
    model = train(labelled_findings(docs.sparkSession, stats) if labelled is None else labelled)
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn(
            "score", vector_to_array("chance")[1])
    return scored.select(id_col, "start", "end", "kind", "value", "score",
                         (F.col("score").isNull() | (F.col("score") >= threshold)).alias("is_secret"))


def redact(docs: DataFrame, secrets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mask: str = "[secret]") -> DataFrame:
    """``docs`` with the spans of its secrets replaced."""
    spans = (secrets.where("is_secret").groupBy(F.col(id_col).alias("_id"))
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")))
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("_id")), "left")
    cut = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
                      lambda s, x: F.struct(F.concat(s["out"], F.substr(F.col(text_col), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")),
                                                     F.lit(mask)).alias("out"), x["end"].alias("at")),
                      lambda s: F.concat(s["out"], F.substr(F.col(text_col), (s["at"] + 1).cast("int"), F.length(text_col))))
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
