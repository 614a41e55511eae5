"""kNN kernels against brute force, IVF / LSH properties, unit norms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import l2_normalize
from quarry.operators import ivf, lsh
from quarry.operators.knn import (QueryBlock, block_topk, bucketed_knn, flat_knn, score_matrix,
                                  corpus_matrix, topk_select)


def brute(qv, cv, k):
    """(query, rank, cand) by rounded score desc, id asc."""
    out = []
    for qi, q in qv.items():
        sc = sorted(((-round(float(np.dot(q, c)), 6), cid) for cid, c in cv.items()))
        out += [(qi, r + 1, cid) for r, (_, cid) in enumerate(sc[:k])]
    return sorted(out)


def _dense_frames(spark, nq=13, nc=200, dim=8, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(nq, dim))
    c = rng.normal(size=(nc, dim))
    if ties:       # exact duplicates force id tie-breaks
        c[10:20] = c[0]
    q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
    c = (c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32)
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(nq)], "qid long, vec array<float>")
    cdf = spark.createDataFrame([(1000 + i, c[i].tolist()) for i in range(nc)],
                                "cid long, vec array<float>").repartition(5)
    return qdf, cdf, {i: q[i].astype(np.float64) for i in range(nq)}, \
        {1000 + i: c[i].astype(np.float64) for i in range(nc)}


def test_flat_knn_dense_matches_brute_force(spark):
    qdf, cdf, qv, cv = _dense_frames(spark)
    got = flat_knn(qdf, cdf, 7, q_id="qid", c_id="cid", kind="dense", dim=8, c_type="long")
    rows = sorted((r["qid"], r["rank"], r["cid"]) for r in got.collect())
    assert rows == brute(qv, cv, 7)


def test_flat_knn_query_blocks(spark):
    """Cutting both sides into small blocks changes nothing."""
    qdf, cdf, qv, cv = _dense_frames(spark, nq=21)
    got = flat_knn(qdf, cdf, 5, q_id="qid", c_id="cid", kind="dense", dim=8, c_type="long",
                   query_rows=4, corpus_rows=30)
    rows = sorted((r["qid"], r["rank"], r["cid"]) for r in got.collect())
    assert rows == brute(qv, cv, 5)


def test_sparse_scores_match_dense():
    rng = np.random.default_rng(3)
    dim = 64
    qs = [(np.sort(rng.choice(dim, size=s, replace=False)), rng.normal(size=s)) for s in (0, 3, 10)]
    pdf = pd.DataFrame({"qid": [1, 2, 3], "idx": [a for a, _ in qs], "val": [b for _, b in qs]})
    qb = QueryBlock.from_pandas(pdf, "qid", "sparse", dim)
    cs = [(np.sort(rng.choice(dim, size=5, replace=False)), rng.normal(size=5)) for _ in range(9)]
    cpdf = pd.DataFrame({"idx": [a for a, _ in cs], "val": [b for _, b in cs]})
    dt = corpus_matrix(cpdf, "sparse", dim)
    dense_q = np.zeros((3, dim))
    for i, (a, b) in enumerate(qs):
        dense_q[i, a] = b
    assert np.allclose(score_matrix(qb, dt), dense_q @ dt)


def test_topk_select_ties_by_column():
    s = np.array([[0.5, 0.5, 0.5, 0.9, 0.5]])
    m = topk_select(s, 3)
    assert m.tolist() == [[True, True, False, True, False]]


def test_unit_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    r = [x["n"] for x in df.select(l2_normalize("v").alias("n")).collect()]
    assert np.allclose(r[0], [0.6, 0.8]) and r[1] == [0.0, 0.0]


def test_ivf_all_cells_equals_flat_and_recall_monotone(spark):
    qdf, cdf, qv, cv = _dense_frames(spark, nq=20, nc=300, ties=False, seed=7)
    cent = ivf.train(cdf, "cid", "dense", 8, nlist=6)
    assert cent.count() == 6
    norms = [float(np.linalg.norm(np.asarray(r["vec"]))) for r in cent.collect()]
    assert np.allclose(norms, 1.0, atol=1e-5)
    cells = ivf.assign(cdf, cent, "cid", "dense", 8)
    assert cells.count() == 300                      # every vector assigned once
    exact = set(brute(qv, cv, 10))
    recalls = []
    for nprobe in (1, 2, 4, 6):
        got = ivf.search(qdf, cells, cent, 10, q_id="qid", c_id="cid", kind="dense", dim=8,
                         nprobe=nprobe, c_type="long")
        rows = {(r["qid"], r["rank"], r["cid"]) for r in got.collect()}
        recalls.append(len({(a, c) for a, _, c in rows} & {(a, c) for a, _, c in exact}))
        if nprobe == 6:
            assert rows == exact
    assert recalls == sorted(recalls)


def test_salted_buckets_equal_unsalted(spark):
    """A hot bucket split into many salted groups gives the same answer."""
    qdf, cdf, qv, cv = _dense_frames(spark, nq=9, nc=150)
    c = cdf.withColumn("bucket", F.lit(0))          # one bucket holds everything
    p = qdf.withColumn("bucket", F.lit(0))
    a = bucketed_knn(c, p, 6, q_id="qid", c_id="cid", kind="dense", dim=8, c_type="long",
                     query_rows=4, corpus_rows=10)
    rows = sorted((r["qid"], r["rank"], r["cid"]) for r in a.collect())
    assert rows == brute(qv, cv, 6)


def test_lsh_candidates_are_rescored_exactly(spark):
    qdf, cdf, qv, cv = _dense_frames(spark, nq=10, nc=120, ties=False)
    got = lsh.search(qdf, cdf, 5, q_id="qid", c_id="cid", kind="dense", dim=8, bands=6, rows=3,
                     c_type="long")
    for r in got.collect():
        assert abs(r["score"] - round(float(np.dot(qv[r["qid"]], cv[r["cid"]])), 6)) < 1e-6
    # ranks are dense per query
    per = got.groupBy("qid").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(x["m"] == x["n"] for x in per)


def test_lsh_planes_deterministic():
    a, b = lsh.planes(4, 5), lsh.planes(4, 5)
    assert (a == b).all() and set(np.unique(a)) <= {-1.0, 1.0}


def test_default_nprobe_rule():
    assert ivf.default_nprobe(256) == 32
    assert ivf.default_nprobe(10) == 2
    assert ivf.default_nprobe(3) == 1
    assert ivf.default_nprobe(256, 8) == 8


def test_small_blocks_agree(spark):
    """IVF and LSH give identical rows however both sides are cut."""
    qdf, cdf, qv, cv = _dense_frames(spark, nq=15, nc=160, ties=False, seed=11)
    cent = ivf.train(cdf, "cid", "dense", 8, nlist=5)
    cells = ivf.assign(cdf, cent, "cid", "dense", 8)
    kw = dict(q_id="qid", c_id="cid", kind="dense", dim=8, c_type="long")
    rows = lambda df: sorted((r["qid"], r["rank"], r["cid"], r["score"]) for r in df.collect())  # noqa
    probes = ivf.assign(qdf, cent, "qid", "dense", 8, 2)
    assert rows(ivf.search(qdf, cells, cent, 6, nprobe=2, **kw)) == rows(
        bucketed_knn(cells, probes, 6, query_rows=2, corpus_rows=7, **kw))


def test_half_way_scores_do_not_depend_on_partitions(spark):
    """Scores half-way between two 6-decimal values are rounded once."""
    values = [0.1234565, 0.1234575, 0.1234555, 0.1234545, 0.1234535, 0.1234561]
    c = spark.createDataFrame([(i, [v]) for i, v in enumerate(values)], "cid long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0])], "qid long, vec array<double>")
    kw = dict(q_id="qid", c_id="cid", kind="dense", dim=1, c_type="long")
    a = flat_knn(q, c.coalesce(1), 3, **kw).collect()
    b = flat_knn(q, c.repartition(7), 3, corpus_rows=1, **kw).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_sparse_block_memory_is_bounded():
    """50,000 sparse rows and one query: no dense matrix of all rows."""
    import tracemalloc
    n, dim = 50_000, 4096
    pdf = pd.DataFrame({"cid": np.arange(n), "idx": [[i % dim] for i in range(n)], "val": [[1.0]] * n})
    qb = QueryBlock.from_pandas(pd.DataFrame({"qid": [1], "idx": [[5]], "val": [[1.0]]}), "qid", "sparse", dim)
    tracemalloc.start()
    best = block_topk(qb, pdf, "cid", "sparse", 3, "qid")
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert best["cid"].tolist() == [5, 5 + dim, 5 + 2 * dim]


def test_seeds_find_every_group_and_training_lowers_the_distance(spark):
    """Groups of very unequal size: draws by distance reach the small ones."""
    rng = np.random.default_rng(7)
    centre = np.eye(12)
    group = np.r_[np.zeros(900, int), rng.integers(1, 12, 100), np.arange(1, 12)]
    x = centre[group] + 0.02 * rng.normal(size=(len(group), 12))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9_000, [0.0] * 12), (9_001, None)]
    df = spark.createDataFrame(data, "id long, vec array<float>")
    first = ivf.seeds(df, "id", "dense", 12, nlist=12)
    assert first.shape == (12, 12) and sorted(first.argmax(axis=1)) == list(range(12))
    again = ivf.seeds(df.repartition(7), "id", "dense", 12, nlist=12)
    assert np.allclose(first, again)

    def far(centres):
        near = ivf.nearest(df.where("id < 9000"), centres, "id", "dense", 12)
        return near.agg(F.avg("far")).first()[0]

    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    new = ivf.step(df.where("id < 9000").select("vec"), first, "dense", 12)
    assert abs(far(first) - (1 - (unit @ first.T).max(axis=1)).mean()) < 1e-6 and far(new) <= far(first)
    assert ivf.seeds(df.limit(0), "id", "dense", 12).shape == (0, 12)
    few = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, vec array<float>")
    assert len(ivf.seeds(few, "id", "dense", 2, nlist=8)) == 1
