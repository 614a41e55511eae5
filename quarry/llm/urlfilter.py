"""URL filter: allow and block rules, and a model for what no rule decides.

The model is a logistic regression on hashed character n-grams of host and path,
fitted on a small labelled URL table; scoring is one expression a row.  Rules
are a short list (they become one expression); the longest that fits wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.decontam import LOWER, UPPER

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """Host with A-Z lowered; empty for null and for urls without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def deciding_rule(rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits columns host and path."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):  # the longest is asked first
        fits = (F.concat(F.lit("."), "host").endswith("." + r.host) & F.col("path").startswith(r.path))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def grams(n: int = 3) -> Column:
    """Character n-grams of columns host and path, marked by their part."""
    def of(name: str) -> Column:
        whole = F.concat(F.lit("^"), F.col(name), F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(whole) - n + 1)),
                           lambda i: F.concat(F.lit(f"{name[0]}:"), F.substring(whole, i, n)))
    return F.concat(of("host"), of("path"))


def sample_labelled(labelled: DataFrame, max_per_class: int) -> DataFrame:
    """At most ``max_per_class`` different (host, path, block) rows of each
    class, the first by hash."""
    distinct = labelled.select("host", "path", F.col("block").cast("double").alias("block")).distinct()
    order = F.xxhash64("host", "path")
    return (distinct.where("block = 1").orderBy(order).limit(max_per_class)
            .union(distinct.where("block = 0").orderBy(order).limit(max_per_class)))


class UrlModel:
    """Logistic regression on hashed n-grams.  With labels of one class only it
    answers that class; with none it allows."""

    def __init__(self, labelled: DataFrame, n: int = 3, features: int = 4096,
                 max_per_class: int = 2000, reg: float = 1e-3):
        """``labelled``: host, path, block (0 or 1; null is left out).
        ``max_per_class`` bounds the training sample."""
        self.n, self.tf = n, HashingTF(numFeatures=features, inputCol="__grams", outputCol="__x")
        train = self._featured(sample_labelled(labelled.where("block is not null"), max_per_class))
        train = train.select("__x", "block").coalesce(1).cache()  # bounded: two classes of max_per_class
        try:
            counts = {r["block"]: r["count"] for r in train.groupBy("block").count().collect()}
            self.only = None if len(counts) == 2 else float(max(counts, default=0.0))
            self.model = None if self.only is not None else LogisticRegression(
                featuresCol="__x", labelCol="block", regParam=reg, maxIter=50,
                rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__y").fit(train)
        finally:
            train.unpersist()

    def _featured(self, urls: DataFrame) -> DataFrame:
        return self.tf.transform(urls.withColumn("__grams", grams(self.n)))

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (host, path) with ``score``, the probability of block."""
        if self.model is None:
            return urls.withColumn("score", F.lit(self.only))
        return (self.model.transform(self._featured(urls))
                .withColumn("score", vector_to_array("__p")[1])
                .drop("__grams", "__x", "__raw", "__p", "__y"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id",
          url_col: str = "url", threshold: float = 0.5, **options) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``.

    ``labelled`` has host, path and block; without it the urls that a rule
    decides serve as labelled ones.  Null urls and urls without ``://`` have an
    empty host and path and get the model's verdict.  Repeated rows and null
    ids are judged like others; no rows give none."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    ruled = (urls.withColumn("rule", deciding_rule(rules, str))
             .withColumn("decided", deciding_rule(rules, lambda r: r.verdict)))
    if labelled is None:
        labelled = ruled.where("decided is not null").withColumn(
            "block", (F.col("decided") == "block").cast("int"))
    scored = UrlModel(labelled, **options).score(ruled)
    verdict = F.coalesce("decided", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         verdict.alias("verdict"), "score")
