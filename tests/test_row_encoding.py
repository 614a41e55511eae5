"""Vectors made within their row, texts moved once, small query blocks broadcast, pair
scores per distinct query text."""

from __future__ import annotations

import re

import pytest

from quarry.operators import encode as enc
from quarry.operators import knn, postings
from quarry.operators import prepare as P
from quarry.plans import search as S

TEXTS = [("a", "red ring red"), ("b", "blue ring, a very blue one"), ("c", ""), ("d", None), (None, "red ring"),
         ("e", "ring " * 40 + "é x1 x2"), ("f", " ;, "), ("g", "x2 x2 new words here")]


def _vectors(df):
    return {r.product_id: (r.idx, pytest.approx(r.val, abs=1e-6)) for r in df.collect()}


@pytest.mark.parametrize("dim", [4, 64])
@pytest.mark.parametrize("table", [0, 1, 3, 1 << 19])
def test_rows_are_encoded_as_joined_terms(spark, monkeypatch, table, dim):
    monkeypatch.setattr(enc, "TABLE", table)
    df = spark.createDataFrame(TEXTS, "product_id string, text string").repartition(3)
    fitted = df.where("product_id <> 'g' OR product_id IS NULL")  # g's own tokens are unseen
    model = enc.fit(fitted, "product_id", dim=dim, terms=enc.term_counts(fitted, "product_id", unique=True))
    want = enc.encode(df, model, "product_id", terms=enc.term_counts(df, "product_id"))
    got = enc.encode(df, model, "product_id")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert len(got.collect()) == len(TEXTS)
    assert {r.product_id: (r.idx, r.val) for r in got.collect()} == _vectors(want)


def test_entries_of_frequent_tokens_are_not_shuffled(spark):
    df = spark.createDataFrame([(str(i), " ".join(f"w{j}" for j in range(i % 7, 300))) for i in range(40)],
                               "product_id string, text string")
    counts = S.build_text_index(df, 64).counts
    model = enc.fit(df, "product_id", dim=64, terms=enc.term_counts(counts, "product_id"))
    out = enc.encode_rows(counts, model, "product_id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "token#" in plan  # rows stay rows
    assert out.count() == 40


def test_texts_move_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.createDataFrame([(1, "a", "us")], "example_id long, product_id string, product_locale string")
        c = spark.createDataFrame([("a", "us", "t", "b", "c", "p", "d"), ("a", "gb", "no", "b", "c", "p", "d")],
                                  "product_id string, product_locale string, product_title string, product_brand string, "
                                  "product_color string, product_bullet_point string, product_description string")
        found = P.judged_products(j, c)
        plan = found._jdf.queryExecution().executedPlan().toString()
        join = plan.index("SortMergeJoin")
        assert not re.search("Exchange", plan[:join])   # none above the join
        assert [r.product_title for r in found.collect()] == ["t"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_small_query_block_meets_the_corpus_in_place(spark):
    df = spark.createDataFrame([(f"p{i}", f"ring w{i % 7} w{i % 5} x{i}") for i in range(300)], "product_id string, text string")
    idx = S.build_text_index(df, 64)
    q = spark.createDataFrame([(1, "ring w1"), (2, "w3 x9"), (3, "none"), (4, "ring w1"), (5, None)], "query_id long, query string")
    qv, _ = S.encode_queries(q, idx.model)
    args = dict(q_id="tkey", c_id="product_id", kind="sparse", dim=64)
    here = knn.flat_knn(qv, idx.vectors, 9, **args)
    assert "CoGroups" not in here._jdf.queryExecution().executedPlan().toString()
    there = knn.flat_knn(qv, idx.vectors, 9, corpus_rows=64, **args)
    assert "CoGroups" in there._jdf.queryExecution().executedPlan().toString()
    pick = lambda d: sorted((r["rank"], r.product_id, r.score) for r in d.collect())
    assert pick(here) == pick(there)


def test_each_query_text_is_scored_once(spark, monkeypatch):
    df = spark.createDataFrame([(f"p{i}", f"ring w{i % 7} w{i % 5} x{i}") for i in range(120)], "product_id string, text string")
    idx = S.build_text_index(df, 64)
    q = spark.createDataFrame([(i, ["ring w1", "w3 x9", "none"][i % 3]) for i in range(30)] + [(99, None)],
                              "query_id long, query string")
    sizes = []
    bm25 = S.rr.bm25
    monkeypatch.setattr(S.rr, "bm25", lambda pairs, *a, **k: sizes.append(pairs.count()) or bm25(pairs, *a, **k))
    got = S.bm25_candidates(q, idx, 10)
    top = S.search_reranked(q, idx, 4, 10)
    assert sizes == [40, 40]   # three texts and the null one, ten candidates each
    cands = S.retrieve_candidates(q, idx, 10)
    rows = lambda d: sorted(repr((r.query_id, r.product_id, round(r.score, 9))) for r in d.collect())
    assert rows(got) == rows(S.bm25_candidates(q, idx, 10, cands))
    assert rows(top) == rows(S.search_reranked(q, idx, 4, 10, cands))


def test_first_candidates_of_postings_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(f"p{i}", f"ring w{i % 7} w{i % 5} x{i}") for i in range(300)], "product_id string, text string")
    idx = S.build_text_index(df, 64)
    q = spark.createDataFrame([(1, "ring w1"), (2, "w3 x9")], "query_id long, query string")
    qv, _ = S.encode_queries(q, idx.model)
    plans, full = [], postings._full

    def seen(*args):
        out = full(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(postings, "_full", seen)
    args = dict(q_id="tkey", c_id="product_id", dim=64)
    got = postings.search(qv, postings.build(idx.vectors, "product_id"), 4, **args).hits
    assert "Exchange hashpartitioning" not in plans[0] and "Window" not in plans[0]
    pick = lambda d: sorted((r["rank"], r.product_id, r.score) for r in d.collect())
    assert pick(got) == pick(knn.flat_knn(qv, idx.vectors, 4, kind="sparse", **args))
