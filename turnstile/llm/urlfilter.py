"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest.

A rule fits its host and all its subdomains if the path of the url starts with
the rule's path; the longest fitting rule decides.  Every other url is judged
by a logistic regression over hashed character n-grams of host and path,
trained from a small labelled table of urls (at most ``SAMPLE`` rows, half of
them of each class, those with the smallest hash; the classes weigh the same).
The query trains on the small table of ``url_labels`` and on the urls that the
rules decide (``labelled_by_rules``): what the rules say of the known part of the
web is carried over in a small part (at most ``RULED`` rows), and the table says
what hosts elsewhere look like.
Digits are one sign to the model: numbers of pages say nothing.

A null url, or one without ``://``, has an empty host and path.  With labels
of one class only, that class is the verdict; without labels, ``allow``.
Repeated urls are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, RULED, FEATURES, SIZES = 4000, 100, 1 << 14, (3, 4)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """(length, name, verdict) of the longest fitting rule, or null."""
    listed = F.array(*[F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"),
                                F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"),
                                F.lit(r.path).alias("path")) for r in rules])
    fits = F.filter(listed, lambda r: ((F.col(host) == r["host"]) | F.endswith(F.col(host), F.concat(F.lit("."), r["host"])))
                    & F.startswith(F.col(path), r["path"]))
    return F.array_max(fits)


def _grams(col: str, mark: str) -> list[Column]:
    """n-grams of a marked and closed string: ``^`` and ``$`` are its ends."""
    text = F.concat(F.lit("^"), F.regexp_replace(col, "[0-9]+", "0"), F.lit("$"))
    return [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1),
                                                    lambda i, n=n: F.concat(F.lit(mark), F.substr(text, i, F.lit(n)))))
            .otherwise(F.array().cast("array<string>")) for n in SIZES]


def featurize(urls: DataFrame) -> DataFrame:
    """Add the hashed n-grams of ``host`` and ``path`` as a sparse vector."""
    grams = F.concat(*_grams("host", "h:"), *_grams("path", "p:"))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashing.transform(urls.withColumn("_grams", grams)).drop("_grams")


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", sample: int = RULED) -> DataFrame:
    """host, path, block of urls that a rule decides: the ``sample`` distinct ones with the smallest hash."""
    urls = pages.select(host_of(url_col).alias("host"), path_of(url_col).alias("path")).withColumn("_rule", fitting_rule(rules))
    ruled = urls.where("_rule is not null")
    return ruled.select("host", "path", (F.col("_rule.verdict") == "block").cast("double").alias("block")).distinct().orderBy(
        F.xxhash64("host", "path"), "host", "path").limit(sample)


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[LogisticRegressionModel | None, float]:
    """Model of ``block`` on a bounded sample; without two classes, no model and the only class."""
    table = labelled.where("block is not null").select("host", "path", "block").distinct()
    order = (F.xxhash64("host", "path"), "host", "path", "block")
    rows = [r for block in (0.0, 1.0) for r in table.where(F.col("block") == block).orderBy(*order).limit(sample // 2).collect()]
    counts = {block: sum(r["block"] == block for r in rows) for block in {r["block"] for r in rows}}
    if len(counts) < 2:
        return None, (counts.popitem()[0] if counts else 0.0)
    weighted = [(*r, len(rows) / (2 * counts[r["block"]])) for r in rows]
    few = featurize(labelled.sparkSession.createDataFrame(weighted, "host string, path string, block double, _weight double").coalesce(1)).cache()
    model = LogisticRegression(featuresCol="_features", labelCol="block", weightCol="_weight", regParam=0.005, maxIter=50,
                               standardization=False, probabilityCol="_chance", rawPredictionCol="_raw",
                               predictionCol="_block").fit(few)
    few.unpersist()
    return model, 0.0


def judge_urls(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame, id_col: str = "page_id",
               url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict, score (chance of block by the model; null if a rule decides).

    ``labelled`` has columns host, path, block (1.0 or 0.0).
    """
    urls = pages.select(F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    model, only = train(labelled)
    ruled = urls.withColumn("_rule", fitting_rule(rules))
    if model is None:
        scored = ruled.withColumn("_p", F.lit(only))
    else:
        scored = model.transform(featurize(ruled)).withColumn("_p", vector_to_array("_chance")[1])
    verdict = F.when(F.col("_rule").isNotNull(), F.col("_rule.verdict")).when(F.col("_p") >= threshold, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", F.col("_rule.name").alias("rule"), verdict.alias("verdict"),
                         F.when(F.col("_rule").isNull(), F.col("_p")).alias("score"))
