"""Failure analysis of a ranked result.

Classification of each judged query on its top-10 predictions, in this
order:
  1. no Exact and no Substitute found        -> complete_miss
  2. no Exact found, the query has Exact     -> substitute_only
  3. an Exact found                          -> success (low_rank if its
                                                rank > 5)
  4. otherwise (only Substitutes judged, one found) -> unclassified
Queries without any E/S judgment are skipped.

All per-query values are aggregates keyed by query; the only bounded
lists are the three smallest relevant ids (a window limit, never a
collect of a whole group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import prefix, word_count
from quarry.operators.prepare import SAMPLE_SEED

TOP = 10
LOW_RANK = 5
FAILURE_EXAMPLES = 20
RELEVANT_SAMPLE = 3


def classify(preds: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """preds (query_id, rank, product_id); judged rows (query_id,
    product_id, esci_label); queries (query_id, query). One row per
    judged query: outcome, low_rank, first_exact_rank (0 = none),
    query_words, n_relevant, n_exact, relevant_sample."""
    labels = (judged.where(F.col("esci_label").isin("E", "S"))
              .select("query_id", "product_id", F.col("esci_label").alias("label")).distinct())
    rel_ids = labels.select("query_id", "product_id").distinct()
    w = Window.partitionBy("query_id").orderBy("product_id")
    sample = (rel_ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= RELEVANT_SAMPLE)
              .groupBy("query_id")
              .agg(F.concat_ws(",", F.array_sort(F.collect_list("product_id"))).alias("relevant_sample")))
    stats = (labels.groupBy("query_id")
             .agg(F.countDistinct("product_id").alias("n_relevant"),
                  F.countDistinct(F.when(F.col("label") == "E", F.col("product_id"))).alias("n_exact")))
    hits = (preds.where(F.col("rank") <= TOP).join(labels, ["query_id", "product_id"])
            .groupBy("query_id")
            .agg(F.min(F.when(F.col("label") == "E", F.col("rank"))).alias("fe"),
                 F.max(F.when(F.col("label") == "S", 1).otherwise(0)).alias("fs")))
    rows = (queries.join(stats, "query_id").join(hits, "query_id", "left").join(sample, "query_id"))
    found_e = F.col("fe").isNotNull()
    found_s = F.coalesce(F.col("fs"), F.lit(0)) == 1
    outcome = (F.when(~found_e & ~found_s, "complete_miss")
               .when(~found_e & (F.col("n_exact") > 0), "substitute_only")
               .when(found_e, "success").otherwise("unclassified"))
    return rows.select(
        "query_id", outcome.alias("outcome"),
        (found_e & (F.col("fe") > LOW_RANK)).alias("low_rank"),
        F.coalesce(F.col("fe"), F.lit(0)).cast("int").alias("first_exact_rank"),
        word_count("query").alias("query_words"),
        F.col("n_relevant").cast("int").alias("n_relevant"),
        F.col("n_exact").cast("int").alias("n_exact"),
        F.when(~found_e & ~found_s, F.col("relevant_sample")).otherwise(F.lit("")).alias("relevant_sample"))


def breakdown(rows: DataFrame) -> DataFrame:
    """Counts per class, the reference's success / miss rates
    (denominator successes + complete misses) and the rate over all judged
    queries; percentages with one decimal, null when undefined."""
    c = lambda name: F.count(F.when(F.col("outcome") == name, 1))
    agg = rows.agg(c("success").alias("n_success"), c("complete_miss").alias("n_complete_miss"),
                   c("substitute_only").alias("n_substitute_only"),
                   c("unclassified").alias("n_unclassified"),
                   F.count(F.when(F.col("low_rank"), 1)).alias("n_low_rank"),
                   F.count(F.lit(1)).alias("n_judged"))
    analyzed = F.col("n_success") + F.col("n_complete_miss")
    pct = lambda num, den: F.when(den > 0, F.round(num * 100.0 / den, 1))
    return agg.select("*", analyzed.alias("n_analyzed"),
                      pct(F.col("n_success"), analyzed).alias("success_pct"),
                      pct(F.col("n_complete_miss"), analyzed).alias("miss_pct"),
                      pct(F.col("n_success"), F.col("n_judged")).alias("success_pct_all"))


def miss_length_profile(rows: DataFrame) -> DataFrame:
    """Mean words of complete misses and a 3-bin histogram."""
    m = rows.where(F.col("outcome") == "complete_miss")
    wd = F.col("query_words")
    return m.agg(F.count(F.lit(1)).alias("n_misses"),
                 F.round(F.avg(wd), 6).alias("mean_words"),
                 F.count(F.when(wd <= 2, 1)).alias("words_1_2"),
                 F.count(F.when((wd >= 3) & (wd <= 4), 1)).alias("words_3_4"),
                 F.count(F.when(wd >= 5, 1)).alias("words_5_plus"))


def success_rank_hist(rows: DataFrame) -> DataFrame:
    """Success ranks 1, 2-3, 4-5, 6-10 and the share at rank 1."""
    s = rows.where(F.col("outcome") == "success")
    r = F.col("first_exact_rank")
    return s.agg(F.count(F.lit(1)).alias("n_success"),
                 F.count(F.when(r == 1, 1)).alias("rank_1"),
                 F.count(F.when((r >= 2) & (r <= 3), 1)).alias("rank_2_3"),
                 F.count(F.when((r >= 4) & (r <= 5), 1)).alias("rank_4_5"),
                 F.count(F.when((r >= 6) & (r <= 10), 1)).alias("rank_6_10"),
                 F.when(F.count(F.lit(1)) > 0,
                        F.round(F.count(F.when(r == 1, 1)) * 100.0 / F.count(F.lit(1)), 1))
                 .alias("rank_1_pct"))


def failure_examples(rows: DataFrame, judged_rows: DataFrame, preds: DataFrame,
                     texts: DataFrame, queries: DataFrame, n: int = FAILURE_EXAMPLES,
                     seed: int = SAMPLE_SEED) -> DataFrame:
    """Complete misses of queries that have Exact products: the
    title of the first judged Exact row and the first 100 characters of the
    top prediction's text ('None' without predictions); the first ``n`` in
    sample order."""
    misses = rows.where((F.col("outcome") == "complete_miss") & (F.col("n_exact") > 0)).select("query_id")
    exact_ids = (judged_rows.where(F.col("esci_label") == "E").select("query_id", "product_id").distinct())
    first_exact = (judged_rows.join(exact_ids, ["query_id", "product_id"], "left_semi")
                   .groupBy("query_id")
                   .agg(F.min_by("product_title", "example_id").alias("expected")))
    top1 = (preds.where(F.col("rank") == 1).join(texts, "product_id", "left")
            .select("query_id", prefix(F.coalesce(F.col("text"), F.lit("")), 100).alias("got")))
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col("query_id").cast("string")))
    return (misses.join(queries, "query_id").join(first_exact, "query_id", "left")
            .join(top1, "query_id", "left")
            .select("query_id", "query", "expected", F.coalesce("got", F.lit("None")).alias("got"))
            .orderBy(h, F.col("query_id")).limit(n))


def coverage(preds: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct products in the top-10 results of the analysed queries."""
    return (preds.where(F.col("rank") <= TOP).join(rows.select("query_id"), "query_id", "left_semi")
            .agg(F.countDistinct("product_id").alias("unique_products")))


def insights(rows: DataFrame, preds: DataFrame) -> DataFrame:
    """The three rule outcomes as columns."""
    miss = miss_length_profile(rows).select("n_misses", "mean_words")
    b = breakdown(rows).select("n_low_rank", "n_complete_miss")
    cov = coverage(preds, rows)
    # three one-row aggregates folded into one row by a union + max
    # (no join of one-row frames, hence no cartesian product in the plan)
    u = (miss.unionByName(b, allowMissingColumns=True)
         .unionByName(cov, allowMissingColumns=True))
    out = u.agg(*[F.max(c).alias(c) for c in
                  ("n_misses", "mean_words", "n_low_rank", "n_complete_miss", "unique_products")])
    return out.select(
        ((F.col("n_misses") > 0) & (F.col("mean_words") < 3)).alias("short_queries_fail"),
        (F.col("n_low_rank") > F.col("n_complete_miss")).alias("ranked_low"),
        F.col("unique_products"))
