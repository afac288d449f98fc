"""Language identification by Bayesian fusion of several kinds of evidence.

* Text: hashed byte trigrams of the lower-cased text under a multinomial model
  for each language, learned from the texts of all documents with a known
  language.  Trigrams are not independent, so a text counts as ``EVIDENCE``
  trigrams at most.
* Declared language (markup or a column) and address suffix: P(value | language).
* Host: P(language | host), smoothed towards the host's registered domain and
  that towards all rows.

The tables of the last three come from a first pass that labels every row by
its text alone, summed up by grouped aggregation; in the second pass a row's
own label is left out of the counts.

A row is rejected if its text has no letters, if no language reaches
``MIN_POSTERIOR``, or if the text is in none of the known languages: the mean
over its trigrams of the best language's log likelihood (less the mean of that
language) is ``RANGE`` deviations of its language or more below the lowest mean of
the labelled texts of a language, each measured with its own trigrams left out (a
mix of known languages lies between their means, so it stays at any length).  The deviation has a part between texts and one within,
which falls with the number of trigrams, so a short text is rarely rejected.

Null text is empty (rejected).  A null host, suffix or declared language is no
evidence.  Without any labelled document no language is known and all rows are
rejected.  Repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import words as W

BUCKETS = 1 << 13
EVIDENCE, MIN_POSTERIOR = 60.0, 0.35
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
# Overlapping trigrams are not independent: so many count as one.
RANGE, OVERLAP = 4.0, 3.0
_DIGITS_AND_SPACE = 0x20


def _trigrams(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of byte trigrams inside a text that hold a letter; a run of white space, digits and symbols is one space."""
    plain = np.full(256, _DIGITS_AND_SPACE, np.uint8)
    plain[0x61:0x7B] = np.arange(0x61, 0x7B)
    plain[0x80:] = np.arange(0x80, 0x100)
    data = plain[words.data]
    capital = np.zeros(len(data), bool)             # two-byte capitals of Latin-1; A-Z are lower-cased already
    capital[1:] = (words.data[:-1] == 0xC3) & (words.data[1:] >= 0x80) & (words.data[1:] <= 0x9E) & (words.data[1:] != 0x97)
    data[capital] += 0x20
    doc = np.repeat(np.arange(words.n_docs), np.diff(words.offsets))
    run = np.zeros(len(data), bool)
    run[1:] = (data[1:] == _DIGITS_AND_SPACE) & (data[:-1] == _DIGITS_AND_SPACE) & (doc[1:] == doc[:-1])
    data, doc = data[~run].astype(np.uint32), doc[~run]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    keep = (doc[:-2] == doc[2:]) & (code != (_DIGITS_AND_SPACE << 16 | _DIGITS_AND_SPACE << 8 | _DIGITS_AND_SPACE))
    code, doc = code[keep].astype(np.uint64), doc[:-2][keep]
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), doc


@dataclass
class TextModel:
    """log P(trigram | language), one row for each language."""

    languages: list[str]
    logs: np.ndarray
    ranges: np.ndarray      # mean, variance between texts and variance of a trigram's familiarity, by language

    @property
    def centred(self) -> np.ndarray:
        """Log likelihoods less the mean of each language's own trigrams."""
        return self.logs - (np.exp(self.logs) * self.logs).sum(1, keepdims=True)

    def familiar(self, words: W.Words, language: np.ndarray) -> np.ndarray:
        """True for texts within the range of the labelled texts of their language.

        A mix lies between the means of its languages, so the range is measured from the lowest mean.
        """
        bucket, doc = _trigrams(words)
        n = np.maximum(np.bincount(doc, minlength=words.n_docs), 1)
        mean = np.bincount(doc, self.centred.max(0)[bucket], words.n_docs) / n
        middle, between, within = self.ranges.T
        return mean >= middle.min() - RANGE * np.sqrt(between[language] + OVERLAP * within[language] / n)

    def likelihoods(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihood by text and language, number of trigrams by text)."""
        bucket, doc = _trigrams(words)
        n = np.bincount(doc, minlength=words.n_docs)
        out = np.stack([np.bincount(doc, row[bucket], words.n_docs) for row in self.logs], 1)
        return out * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None], n


def train_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Trigram counts of every labelled document, summed by language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, sums = W.space_separators(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                bucket, doc = _trigrams(words)
                names, index = np.unique(np.array(langs[lo:hi], dtype=str), return_inverse=True)
                counts = np.bincount(index[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names.tolist(), counts):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])

    counted = (docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
               .mapInArrow(run, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())    # languages x BUCKETS at most
    languages = sorted(set(counted["lang"].to_pylist()))
    table = np.ones((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    rows = np.array([place[x] for x in counted["lang"].to_pylist()], np.int64)
    table[rows, counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    model = TextModel(languages, np.log(table / table.sum(1, keepdims=True)), np.zeros((len(languages), 3)))
    return TextModel(languages, model.logs, _ranges(docs, text_col, lang_col, model, table.sum(1)))


def _ranges(docs: DataFrame, text_col: str, lang_col: str, model: TextModel, totals: np.ndarray) -> np.ndarray:
    """Ranges of familiarity by language; each labelled text's own trigrams are left out of its language's counts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.centred, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, (languages, logs, centred, total) = W.space_separators(), shared.value
        place = {name: i for i, name in enumerate(languages)}
        means = (logs - centred)[:, 0]
        sums = np.zeros((len(languages), 4))
        for batch in batches:
            langs = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, words in W.chunks(batch.column(1), sep, True):
                bucket, doc = _trigrams(words)
                lang = langs[lo:hi]
                bucket, doc = bucket[lang[doc] >= 0], doc[lang[doc] >= 0]
                n = np.bincount(doc, minlength=hi - lo)
                both, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
                d, b = both // BUCKETS, both % BUCKETS
                mine = lang[d]
                left = np.exp(logs[mine, b]) * total[mine] - times
                own = np.log(np.maximum(left, 1.0) / (total[mine] - n[d])) - means[mine]
                others = centred[:, b]
                others[mine, np.arange(len(b))] = -np.inf
                z = np.maximum(own, others.max(0))
                text = np.bincount(d, z * times, hi - lo)
                some = n > 0
                for k, x in enumerate((n[some], text[some], text[some] ** 2 / n[some])):
                    sums[:, k] += np.bincount(lang[some], x, len(languages))
                sums[:, 3] += np.bincount(mine, z * z * times, len(languages))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int32())] + [pa.array(c) for c in sums.T],
                                         ["lang", "n", "z", "texts", "squares"])

    sums = np.zeros((len(model.languages), 4))
    for row in (docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col)
                .mapInArrow(run, "lang int, n double, z double, texts double, squares double")
                .groupBy("lang").agg(*[F.sum(c) for c in ("n", "z", "texts", "squares")]).collect()):
        sums[row["lang"]] = row[1:]
    n = np.maximum(sums[:, 0], 1.0)
    mean = sums[:, 1] / n
    return np.stack([mean, np.maximum(sums[:, 2] / n - mean ** 2, 0.0), np.maximum(sums[:, 3] / n - mean ** 2, 0.0)], 1)


def domain_of(host: Column) -> Column:
    """Last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def _first_labels(rows: DataFrame, model) -> DataFrame:
    """declared, suffix, host, domain and the language by text alone (null without letters)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, m = W.space_separators(), TextModel(*model.value)
        for batch in batches:
            for lo, hi, words in W.chunks(batch.column(0), sep, True):
                logs, n = m.likelihoods(words)
                best = logs.argmax(1) if len(m.languages) else np.zeros(len(n), np.int64)
                label = pa.array(best, pa.int32(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(1, 5)), label],
                                                 ["declared", "suffix", "host", "domain", "label"])

    kinds = ", ".join(f"{c} string" for c in ("declared", "suffix", "host", "domain"))
    return rows.select("_text", "_declared", "_suffix", "_host", "_domain").mapInArrow(run, f"{kinds}, label int")


def _by(counts: DataFrame, key: str, languages: Sequence[str]) -> DataFrame:
    """One row for each value: the number of rows of each language."""
    sums = F.array(*[F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)) for i in range(len(languages))])
    return (counts.where((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(F.col(key).alias(f"_k_{key}"))
            .agg(sums.alias(f"_n_{key}")))


def identify(rows: DataFrame, model: TextModel, text: Column | str, host: Column, declared: Column,
             suffix: Column | None = None, min_posterior: float = MIN_POSTERIOR, keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` with language, posterior and accepted (these names replace columns of the input).

    ``text`` is a column of ``rows`` by name (then it is sent to the workers once) or an expression.  ``keep`` names the
    columns to return (all by default); others don't go through the workers.
    """
    own = [c for c in (rows.columns if keep is None else keep) if c not in ("language", "posterior", "accepted")]
    # the working columns go beside the row, so any name is free for the input
    place = own.index(text) if isinstance(text, str) and text in own else None
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
                        (F.col(f"`{text}`") if isinstance(text, str) else text).alias("_text"),
                        F.lower(declared).alias("_declared"), (suffix if suffix is not None else F.lit(None).cast("string")).alias("_suffix"),
                        host.alias("_host"), domain_of(host).alias("_domain"))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.logs, model.ranges))    # plain values: workers may lack this package
    n_languages = len(model.languages)
    if not n_languages:
        return keyed.select("_row.*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                            F.lit(False).alias("accepted"))
    # one pass gives all grouped counts: (declared, suffix, host, domain, label) -> n, then a sum for each kind
    counts = materialize(_first_labels(keyed, shared).where("label is not null")
                         .groupBy("declared", "suffix", "host", "domain", "label").agg(F.count(F.lit(1)).alias("n")),
                         "language-counts")
    total = [0] * n_languages
    for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect():        # one row for each language
        total[r["label"]] = r["n"]
    joined = keyed
    for key in ("declared", "suffix", "host", "domain"):
        table = _by(counts, key, model.languages)
        joined = joined.join(table, F.col(f"_{key}") == F.col(f"_k_{key}"), "left").drop(f"_k_{key}")
    names = ("declared", "suffix", "host", "domain")
    packed = joined.select("_row", *[f"_n_{k}" for k in names], *(["_text"] if place is None else []))
    schema = packed.schema["_row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, m = W.space_separators(), TextModel(*shared.value)
        whole = np.array(total, float)
        for batch in batches:
            texts = batch.column(5) if place is None else pc.struct_field(batch.column(0), [place])
            for lo, hi, words in W.chunks(texts, sep, True):
                logs, n = m.likelihoods(words)
                posterior = _fuse(logs, n, whole, [_counts(batch.column(1 + i).slice(lo, hi - lo), n_languages)
                                                   for i in range(4)])
                best = posterior.argmax(1)
                chance = np.where(n > 0, posterior.max(1), 0.0)
                language = pa.array([m.languages[b] if k else None for b, k in zip(best, n)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), language, pa.array(chance),
                     pa.array((n > 0) & (chance >= min_posterior) & m.familiar(words, best))], ["_row", "language", "posterior", "accepted"])

    out = packed.mapInArrow(run, _schema(schema))
    return out.select("_row.*", "language", "posterior", "accepted")


def _schema(row):
    return T.StructType([T.StructField("_row", row), T.StructField("language", T.StringType()),
                         T.StructField("posterior", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def _counts(column: pa.Array, width: int) -> np.ndarray:
    """Rows of counts; a null (no evidence) is a row of -1."""
    out = np.full((len(column), width), -1.0)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if there.any():
        out[there] = column.drop_null().flatten().to_numpy().reshape(-1, width)
    return out


def _fuse(logs: np.ndarray, n: np.ndarray, total: np.ndarray, evidence: list[np.ndarray]) -> np.ndarray:
    """Posterior by row and language; evidence: counts by declared, suffix, host, domain, own row included."""
    own = np.zeros_like(logs)
    some = n > 0
    own[some, logs[some].argmax(1)] = 1.0
    rest = np.maximum(total - own, 0.0)
    score = logs.copy()
    for counts in evidence[:2]:
        there = counts[:, 0] >= 0
        score[there] += np.log((counts[there] - own[there] + 1.0) / (rest[there] + 2.0))
    prior = (rest + 1.0) / (rest + 1.0).sum(1, keepdims=True)
    for counts, weight in ((evidence[3], DOMAIN_WEIGHT), (evidence[2], HOST_WEIGHT)):
        there = counts[:, 0] >= 0
        c = np.maximum(counts - own, 0.0)
        smoothed = (c + weight * prior) / (c.sum(1, keepdims=True) + weight)
        prior = np.where(there[:, None], smoothed, prior)
    score += np.log(prior)
    score -= score.max(1, keepdims=True)
    posterior = np.exp(score)
    return posterior / posterior.sum(1, keepdims=True)


def visible_text(html: str) -> Column:
    """Page text without scripts, styles, comments, tags and character references (``&amp;`` is no word)."""
    return F.regexp_replace(F.coalesce(F.col(html), F.lit("")),
                            r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?[0-9a-zA-Z]{1,31};", " ")


def markup_language(html: str) -> Column:
    """Primary subtag of the html element's lang attribute; null if there is none."""
    found = F.regexp_extract(F.col(html), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.when(found != "", found)
