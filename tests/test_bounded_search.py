"""Searches that skip rows by bounds return the rows of the exact search."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bounded, ivf, postings
from quarry.operators.knn import flat_knn


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def dense(spark, n, dim, seed, groups=12, spread=0.15):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    x[:3] = 0
    x[3:9] = x[9]  # ties
    x[10] *= 5     # not of unit length
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))],
                                 "id long, vec array<float>")


@pytest.mark.parametrize("k", [1, 7, 500])
def test_ivf_bounds_equal_exact_search(spark, k):
    corpus = dense(spark, 400, 8, 1)
    queries = dense(spark, 60, 8, 2).select(F.col("id").alias("q"), "vec")
    cent = ivf.train(corpus, "id", "dense", 8, nlist=20, iterations=4)
    index = ivf.assign(corpus, cent, "id", "dense", 8)
    got = bounded.search(queries, index, cent, k, q_id="q", c_id="id", kind="dense", dim=8, c_type="long", first=2)
    want = flat_knn(queries, corpus, k, q_id="q", c_id="id", kind="dense", dim=8, c_type="long")
    assert rows(got.hits) == rows(want)
    scored = sum(r["scored"] for r in got.rounds)
    assert scored <= 400 * 60 and (k > 7 or scored < 0.5 * 400 * 60)
    none = bounded.search(queries.limit(0), index, cent, k, q_id="q", c_id="id", kind="dense", dim=8, c_type="long")
    assert none.hits.count() == 0


def test_bounds_are_never_below_a_member(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(500, 5)), rng.normal(size=(5, 40))
    centres = rng.normal(size=(6, 5))
    cell = (x @ centres.T).argmax(axis=1)
    cos = np.array([min((x[cell == c] @ centres[c]) / np.linalg.norm(x[cell == c], axis=1)) / np.linalg.norm(centres[c])
                    for c in range(6)])
    norm = np.array([np.linalg.norm(x[cell == c], axis=1).max() for c in range(6)])
    b = bounded.bounds(q, centres, cos, norm)
    for c in range(6):
        assert ((x[cell == c] @ q).max(axis=0) <= b[:, c] + 1e-9).all()


def sparse(spark, n, dim, seed, name, longest=12):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        idx = np.unique((dim * rng.random(rng.integers(0, longest + 1)) ** 2).astype(int))
        val = rng.choice([-1, 1], len(idx), p=[.3, .7]) * rng.random(len(idx))
        val = val / max(np.linalg.norm(val), 1e-9)
        out.append((i, idx.tolist(), val.astype(np.float32).tolist()))
    out[1:6] = [(i, *out[7][1:]) for i in range(1, 6)]  # ties
    return spark.createDataFrame(out, f"{name} long, idx array<int>, val array<float>")


@pytest.mark.parametrize("k, rows_", [(1, 32_768), (5, 20), (300, 7)])
def test_postings_equal_exact_search(spark, monkeypatch, k, rows_):
    monkeypatch.setattr(postings, "LIST_ROWS", rows_)
    corpus, queries = sparse(spark, 260, 40, 1, "id"), sparse(spark, 50, 48, 2, "q", 5)
    got = postings.search(queries, postings.build(corpus, "id"), k, q_id="q", c_id="id", dim=48, c_type="long", first=4)
    want = flat_knn(queries, corpus, k, q_id="q", c_id="id", kind="sparse", dim=48, c_type="long")
    assert rows(got.hits) == rows(want)
    assert k > 1 or got.scored < 0.5 * 260 * 50
    none = postings.search(queries.limit(0), postings.build(corpus, "id"), k, q_id="q", c_id="id", dim=48, c_type="long")
    assert none.hits.count() == 0
    empty = postings.search(queries, postings.build(corpus.limit(0), "id"), k, q_id="q", c_id="id", dim=48, c_type="long")
    assert empty.hits.count() == 0
