"""Texts joined once per product, tokens counted in their row, idf of common tokens
broadcast, sparse training rows, indexes that share their terms."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quarry.operators import encode as enc
from quarry.operators import ivf
from quarry.operators import prepare as P
from quarry.plans import runs as RUNS
from quarry.plans import search as S

JUDGED = ("example_id long, query_id long, query string, product_id string, product_locale string, "
          "esci_label string, small_version int, large_version int, split string")
CATALOG = ("product_id string, product_locale string, product_title string, product_brand string, "
           "product_color string, product_bullet_point string, product_description string")


def _judgments(spark):
    rows = [(e, 1 + (e or 0) % 3, "red ring", p, loc, "ESCI"[(e or 0) % 4], int(v), 1, s) for e, p, loc, v, s in [
        (7, "a", "us", True, "train"), (3, "a", "us", True, "test"), (3, "a", "us", True, "test"),
        (9, "b", "us", True, "test"), (None, "b", "us", True, "train"), (4, "c", "us", False, "test"),
        (5, "d", "es", True, "test"), (6, None, "us", True, "test"), (8, "e", "us", True, "train"),
        (1, "f", "es", True, "train"), (2, "f", "us", True, "test")]]
    return spark.createDataFrame(rows, JUDGED)


def _catalog(spark):
    rows = [("a", "us", "ring red", "x", None, None, "long text of a"), ("a", "us", "ring two", None, "red", " b ", "other"),
            ("b", "us", None, "", None, None, "text of b"), ("f", "us", "f us", None, None, None, None),
            ("f", "es", "f es", None, None, None, "texto"), ("e", "gb", "elsewhere", None, None, None, None)]
    return spark.createDataFrame(rows, CATALOG)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_judged_products_are_the_products_of_the_joined_tables(spark):
    j, c = _judgments(spark), _catalog(spark)
    assert _rows(P.judged_products(j, c)) == _rows(P.unique_products(P.join_catalog(j, c)))
    narrow, merged = P.prepare_judgments(j), P.prepare_dataset(j, c)
    assert _rows(P.join_catalog(narrow, c)) == _rows(merged)
    for text in ("basic", "enhanced"):
        assert _rows(S.judged_texts(narrow, c, text)) == _rows(S.product_texts(merged, text))


def test_each_text_meets_one_row_of_its_product(spark, tmp_path):
    """The texts leave the catalogue join once per product, not once per judgment."""
    j, c = _judgments(spark), _catalog(spark)
    many = j.crossJoin(spark.range(50)).drop("id")
    plan = P.judged_products(many, c)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert "Aggregate" in plan[:join] and "Aggregate" in plan[join:]  # below the join as well
    assert _rows(P.judged_products(many, c)) == _rows(P.judged_products(j, c))


def test_tokens_are_counted_in_their_row(spark):
    texts = ["b a B c a a", "", None, " ,;", "one", "Ä ä 1 1 01", "x " * 500 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "product_id long, text string")
    got = enc.term_counts(df, "product_id", unique=True)
    assert _rows(got) == _rows(enc.term_counts(df, "product_id"))
    assert {r.token: r.tf for r in got.where("product_id = 0").collect()} == Counter("b a b c a a".split())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_are_counted_together(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "c"), (None, "c")], "product_id long, text string")
    idx = S.build_text_index(df, 64)
    assert {(r.product_id, r.token): r.tf for r in idx.terms.collect()} == {(1, "a"): 2, (1, "b"): 1, (None, "c"): 2}


@pytest.mark.parametrize("common", [1, 3, 1 << 16])
def test_idf_reaches_common_and_rare_tokens(spark, monkeypatch, common):
    monkeypatch.setattr(enc, "COMMON", common)
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "new", 1), (3, "c", 1)],
                                  "product_id long, token string, tf long")
    idf = spark.createDataFrame([("a", 9, 0.5), ("b", 1, 2.5), ("c", 2, 1.5)], "token string, df long, idf double")
    got = {(r.product_id, r.token, r.tf): r.idf for r in enc._with_idf(terms, idf).collect()}
    assert got == {(1, "a", 2): 0.5, (1, "b", 1): 2.5, (2, "a", 1): 0.5, (2, "new", 1): None, (3, "c", 1): 1.5}


def test_another_dimension_shares_texts_and_terms(spark):
    texts = spark.createDataFrame([("a", "red ring red"), ("b", "blue ring"), ("c", "")], "product_id string, text string")
    base = S.build_text_index(texts, 64)
    other = S.build_text_index(texts, 16, base=base)
    assert other.terms is base.terms and other.model.dim == 16
    assert _rows(other.vectors) == _rows(S.build_text_index(texts, 16).vectors)


def test_sparse_rows_are_added_as_dense_ones(spark):
    rng = np.random.default_rng(1)
    dim, centres = 512, ivf._unit_rows(rng.normal(size=(6, 512)))
    rows = [np.sort(rng.choice(dim, size=n, replace=False)) for n in (1, 2, 0, 2, 40, 300, 1, 3)]
    pdf = pd.DataFrame({"idx": rows, "val": [rng.normal(size=len(r)) for r in rows]})
    total = np.zeros((6, dim))
    best = ivf._add_sparse(total, centres, np.ascontiguousarray(centres.T), pdf)
    x = ivf.corpus_matrix(pdf, "sparse", dim)
    assert best.tolist() == (centres @ x).argmax(axis=0).tolist()
    want = np.zeros((6, dim))
    np.add.at(want, best, ivf._unit_rows(x.T))
    assert np.allclose(total, want, atol=1e-12)


def test_a_sweep_builds_terms_once_per_text_strategy(spark, monkeypatch):
    made = []
    counts = enc.term_counts
    monkeypatch.setattr(enc, "term_counts", lambda *a, **k: made.append(a[1]) or counts(*a, **k))
    j, c = _judgments(spark), _catalog(spark)
    runs = [RUNS.RunConfig(str(n), "basic", "flat", dim=n) for n in (16, 32, 64)]
    alone = [RUNS.evaluate(j, c, r).first() for r in runs]
    made.clear()
    got = RUNS.sweep(j, c, runs).orderBy("seq").collect()
    assert made.count("product_id") == 1
    assert [repr(tuple(r)[1:]) for r in got] == [repr(tuple(r)) for r in alone]
