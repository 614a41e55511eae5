"""Exact sparse top-k by postings.

The vectors' entries are posting lists, with the greatest and least weight in each.
Rows are tiered by their number of entries (powers of two) and a bucket has a list
per tier: weights of unit vectors fall with their length, so a bound over short and
long rows together would fit neither. For a query, a list can add at most
u = max(0, qw * greatest, qw * least).

1. The lists of greatest u, until they hold some multiple of k rows, give
   candidates; the best by partial sum are scored in full, and the k-th score is
   the query's threshold: the true k-th score is at least that.
2. In each tier, lists are taken in falling order of u. Where the u of the last ones
   add up to less than the threshold, a row found in these alone can't reach it:
   they are skipped, for long rows often the whole tier. Rows of the other lists
   whose partial sum and what is left may reach the threshold are scored in full.

Queries with fewer than k rows of positive score (where rows that share no bucket
come in) take the exact block search, so the result always equals it.

A list is cut into blocks by id and a query's entry is copied to each of them, so a
hot bucket is spread over tasks. List statistics are at most ``dim`` rows a tier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.operators.knn import flat_knn, rank_window, rounded
from quarry.session import materialize

SLACK = 1e-6          # scores are compared rounded to six decimals
LIST_ROWS = 32_768    # rows of a block of a posting list


@dataclass
class Postings:
    rows: DataFrame    # bucket, tier, block, c_id, w
    lists: DataFrame   # bucket, tier, n, blocks, high, low
    vectors: DataFrame  # c_id, idx, val


def build(vectors: DataFrame, c_id: str) -> Postings:
    vectors = vectors.select(c_id, "idx", "val")
    tier = F.floor(F.log2(F.size("idx"))).cast("int")
    flat = vectors.select(c_id, tier.alias("tier"), F.explode(F.arrays_zip("idx", "val")).alias("x")).select(
        F.col("x.idx").alias("bucket"), "tier", c_id, F.col("x.val").cast("double").alias("w"))
    lists = materialize(flat.groupBy("bucket", "tier").agg(
        F.count("*").alias("n"), F.max("w").alias("high"), F.min("w").alias("low"))
        .withColumn("blocks", F.ceil(F.col("n") / LIST_ROWS).cast("int")), "lists")
    rows = materialize(flat.join(F.broadcast(lists.select("bucket", "tier", "blocks")), ["bucket", "tier"]).select(
        "bucket", "tier", F.pmod(F.xxhash64(c_id), F.col("blocks")).cast("int").alias("block"), c_id, "w"), "postings")
    return Postings(rows, lists, vectors)


@dataclass
class Search:
    hits: DataFrame     # q_id, rank, c_id, score
    touched: int        # entries of posting lists that were added up
    scored: int         # (query, row) pairs scored in full, the block search's included


def _partial(terms: DataFrame, index: Postings, q_id: str, c_id: str) -> DataFrame:
    """(q_id, tier, c_id, part): sums over the lists of ``terms``."""
    spread = terms.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (spread.join(index.rows, ["bucket", "tier", "block"])
            .groupBy(q_id, "tier", c_id).agg(F.sum(F.col("qw") * F.col("w")).alias("part")))


@F.pandas_udf(DoubleType())
def _dot(idx: pd.Series, val: pd.Series, qidx: pd.Series, qval: pd.Series) -> pd.Series:
    """Rounded inner products of sparse rows with ascending indices."""
    out = np.zeros(len(idx))
    for i, (a, x, b, y) in enumerate(zip(idx, val, qidx, qval, strict=True)):
        if len(a) and len(b):
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            out[i] = np.where(a[at] == b, x[at].astype(np.float64), 0.0) @ y.astype(np.float64)
    return pd.Series(rounded(out))


def _full(pairs: DataFrame, queries: DataFrame, index: Postings, q_id: str, c_id: str) -> DataFrame:
    q = queries.select(q_id, F.col("idx").alias("qidx"), F.col("val").alias("qval"))
    return (pairs.select(q_id, c_id).join(index.vectors, c_id).join(q, q_id)
            .select(q_id, c_id, _dot("idx", "val", "qidx", "qval").alias("score")))


def search(queries: DataFrame, index: Postings, k: int, *, q_id: str, c_id: str, dim: int,
           c_type: str = "string", first: int = 16, deep: int = 4) -> Search:
    """The exact k best rows per query (q_id bigint, idx, val): the same rows and
    scores as ``flat_knn``. ``first`` x k rows are looked at before the threshold
    is set, the ``deep`` x k best of them in full."""
    queries = materialize(queries.select(q_id, "idx", "val"), "posting-queries")
    terms = (queries.select(q_id, F.explode(F.arrays_zip("idx", "val")).alias("x"))
             .select(q_id, F.col("x.idx").alias("bucket"), F.col("x.val").cast("double").alias("qw"))
             .join(F.broadcast(index.lists), "bucket")
             .withColumn("u", F.greatest(F.lit(0.0), F.col("qw") * F.col("high"), F.col("qw") * F.col("low"))))
    # a query's lists: at most ``dim`` rows a tier
    before = (Window.partitionBy(q_id).orderBy(F.desc("u"), "bucket", "tier")
              .rowsBetween(Window.unboundedPreceding, -1))
    behind = (Window.partitionBy(q_id, "tier").orderBy(F.desc("u"), "bucket")
              .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    terms = materialize(terms.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
                        .withColumn("rest", F.sum("u").over(behind)), "posting-terms")

    some = _partial(terms.where(F.col("seen") < first * k), index, q_id, c_id)
    # few rows, written: they are broadcast to the vectors, which stay where they are
    top = materialize(rank_window(some.withColumnRenamed("part", "score"), deep * k, q_id, c_id)
                      .select(q_id, c_id), "posting-top")
    sure = materialize(rank_window(_full(top, queries, index, q_id, c_id), k, q_id, c_id), "posting-first")
    least = sure.groupBy(q_id).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    need = F.coalesce("least", F.lit(float("-inf"))) - SLACK
    terms = terms.join(least, q_id, "left").withColumn("need", need)
    needed = materialize(terms.where(F.col("rest") >= F.col("need")), "posting-needed")
    left = (terms.where(F.col("rest") < F.col("need")).groupBy(q_id, "tier")
            .agg(F.max("rest").alias("left")))
    goal = needed.groupBy(q_id, "tier").agg(F.first("need").alias("need")).join(left, [q_id, "tier"], "left")
    pairs = materialize(
        _partial(needed, index, q_id, c_id).join(goal, [q_id, "tier"])
        .where(F.col("part") + F.coalesce("left", F.lit(0.0)) >= F.col("need")).select(q_id, c_id), "posting-pairs")
    hits = materialize(rank_window(_full(pairs, queries, index, q_id, c_id), k, q_id, c_id)
                       .select(q_id, "rank", c_id, "score"), "posting-hits")
    whole = hits.where("score > 0").groupBy(q_id).count().where(F.col("count") >= k).select(q_id)
    few = materialize(queries.join(whole, q_id, "left_anti"), "posting-few")
    n_few, rest = few.count(), hits.limit(0)
    if n_few:
        rest = flat_knn(few, index.vectors, k, q_id=q_id, c_id=c_id, kind="sparse", dim=dim, c_type=c_type)
    touched = needed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + terms.where(
        F.col("seen") < first * k).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = pairs.count() + (n_few * index.vectors.count() if n_few else 0)
    return Search(hits.join(whole, q_id).unionByName(rest), int(touched), int(scored))
