"""The neighbour graph: lists, pruning, beam search against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.knn import flat_knn


def clustered(n, dim, seed, groups=30, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<float>")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def recall(got, want):
    a, b = {(r[0], r[2]) for r in got}, {(r[0], r[2]) for r in want}
    return len(a & b) / len(b)


@pytest.fixture(scope="module")
def built(spark):
    x = clustered(1500, 16, 1)
    return x, graph.build(frame(spark, x, "id"), "id", "dense", 16, block=64)


def test_lists_near_the_true_neighbours(spark, built):
    x, g = built
    lists = graph.neighbour_lists(g.nodes, "dense", 16, size=16, block=64)  # many blocks: rounds have work
    sim = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(sim, -9)
    good = 0
    for r in lists.collect():
        true = set(np.argsort(-sim[r["node"]])[:16].tolist())
        others = [e["other"] for e in r["near"]]
        assert len(others) == len(set(others)) == 16 and r["node"] not in others
        assert all(abs(-e["gap"] - sim[r["node"], e["other"]]) < 1e-5 for e in r["near"])
        good += len(true & set(others))
    assert good >= 0.95 * 16 * 1500


def test_degrees_are_bounded_and_search_finds_the_neighbours(spark, built):
    x, g = built
    assert g.links.agg(F.max(F.size("out"))).first()[0] <= 2 * graph.M
    assert g.starts.count() == 64
    q = frame(spark, clustered(80, 16, 1)[:80], "q")
    got = rows(graph.search(q, g, 10, q_id="q", c_id="id", kind="dense", dim=16, beam=48).hits)
    want = rows(flat_knn(q, g.nodes, 10, q_id="q", c_id="node", kind="dense", dim=16, c_type="long"))
    assert recall(got, want) >= 0.95
    exact = {(r[0], r[2]): r[3] for r in rows(flat_knn(q, g.nodes, 1500, q_id="q", c_id="node", kind="dense",
                                                       dim=16, c_type="long"))}
    assert all(abs(exact[r[0], r[2]] - r[3]) < 2e-6 for r in got)


def test_all_nodes_as_starts_is_exact_with_copies_ties_and_zeros(spark):
    x = clustered(300, 8, 3)
    x[:5], x[5:60], x[60:63] = 0, x[70], x[100]
    q = frame(spark, np.vstack([x[68:110], np.zeros((1, 8))]), "q")
    corpus = frame(spark, x, "id")
    g = graph.build(corpus, "id", "dense", 8, starts=10_000)
    assert g.members.count() == 300 and g.nodes.count() == 300 - 4 - 55 - 3
    for k in (10, 400):
        got = graph.search(q, g, k, q_id="q", c_id="id", kind="dense", dim=8).hits
        assert rows(got) == rows(flat_knn(q, corpus, k, q_id="q", c_id="id", kind="dense", dim=8, c_type="long"))


def test_sparse_vectors_string_ids_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(5)
    out = []
    for i in range(200):
        idx = np.unique(rng.integers(0, 50, 6))
        val = rng.random(len(idx))
        out.append((f"p{i:03}", idx.tolist(), (val / np.linalg.norm(val)).tolist()))
    corpus = spark.createDataFrame(out, "pid string, idx array<int>, val array<float>")
    g = graph.build(corpus, "pid", "sparse", 50)
    g = graph.Graph.load(spark, g.save(str(tmp_path / "g")))
    q = corpus.limit(40).select(F.substring("pid", 2, 3).cast("long").alias("q"), "idx", "val")
    got = rows(graph.search(q, g, 5, q_id="q", c_id="pid", kind="sparse", dim=50).hits)
    want = rows(flat_knn(q, corpus, 5, q_id="q", c_id="pid", kind="sparse", dim=50))
    assert recall(got, want) >= 0.95


def test_empty_single_and_null_rows(spark):
    schema = "id long, vec array<float>"
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vec array<float>")
    for data, want in (([], []), ([(4, None)], []), ([(4, [0.6, 0.8]), (5, None)], [(1, 1, 4, 0.6)])):
        g = graph.build(spark.createDataFrame(data, schema), "id", "dense", 2)
        got = rows(graph.search(q, g, 3, q_id="q", c_id="id", kind="dense", dim=2).hits)
        assert [(a, b, c, round(s, 6)) for a, b, c, s in got] == want
        assert graph.search(q.limit(0), g, 3, q_id="q", c_id="id", kind="dense", dim=2).hits.count() == 0


def test_pruning_keeps_directions():
    score = np.array([0.9, 0.8, 0.7])
    sim = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    assert graph.keep_links(score, sim, 5).tolist() == [0, 2]
    assert graph.keep_links(score, np.eye(3), 2).tolist() == [0, 1]
    assert graph.keep_links(np.array([]), np.zeros((0, 0)), 2).tolist() == []


def test_run_with_a_saved_graph_index(spark, tmp_path):
    """A run over a graph index that is saved, found and loaded again."""
    from quarry.plans import index_store as STORE
    from quarry.plans import runs as RUNS

    texts = spark.createDataFrame([(f"p{i}", f"word{i % 7} item{i % 11} part{i}") for i in range(60)],
                                  "product_id string, text string")
    cfg = RUNS.RunConfig("graph", index_type="graph", dim=1024, k=5)
    RUNS.index_for(texts, cfg, str(tmp_path))
    index = RUNS.index_for(texts, cfg, str(tmp_path))
    assert index.graph is not None and index.graph.members.count() == 60
    queries = spark.createDataFrame([(1, "word3 part3"), (2, "item4")], "query_id long, query string")
    got, want = (rows(RUNS.predictions(queries, index, RUNS.RunConfig("x", index_type=t, dim=1024, k=5)))
                 for t in ("graph", "flat"))
    assert recall(got, want) == 1.0
    assert STORE.find_index(spark, str(tmp_path), "nothing") is None
