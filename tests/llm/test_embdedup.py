import numpy as np
import pytest

from quarry.llm import embdedup as E


def brute(rows, threshold):
    """id -> (links, component) by all pairs."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in ok], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    ids = np.array([i for i, _ in ok])
    label = ids.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    out = {i: (0, i) for i, _ in rows}
    return out | {int(i): (int(near[k].sum()) - 1, int(label[k])) for k, i in enumerate(ids)}


def test_links_and_components(spark):
    rng = np.random.default_rng(0)
    rows = [rng.standard_normal(32) for _ in range(500)]
    rows += [rows[i] + rng.standard_normal(32) * .05 for i in range(60)]           # pairs
    rows += [rows[400] + rng.standard_normal(32) * .12 for _ in range(150)]        # a dense group
    rows += [rows[450]] * 40                                                       # copies
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, nid int, n int")
    got = {r.vec_id: r for r in E.near_duplicates(df, audit=100).collect()}
    want = brute(rows, .95)
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= .98 * links
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > .98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(odd)))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(df).count() == 0


def _pairs_beside_a_dense_group():
    """(vec_id, embedding) of a dense group and of 300 isolated pairs at cosine .955."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(rng.standard_normal((300, 64))), rng.standard_normal((300, 64))
    y = unit(y - (x * y).sum(1, keepdims=True) * x)
    group = unit(rng.standard_normal((1, 64)) + rng.standard_normal((1000, 64)) * .02)
    rest = unit(rng.standard_normal((1400, 64)))
    rows = np.concatenate([group, x, .955 * x + (1 - .955**2)**.5 * y, rest])
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def test_a_dense_group_does_not_hide_lost_pairs(spark):
    df = spark.createDataFrame(_pairs_beside_a_dense_group(), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_duplicates(df, orders=1, pivots=2, audit=64).collect()}
    assert np.mean([got[1000 + i].component_id == got[1300 + i].component_id for i in range(300)]) >= .98
    assert np.mean([got[i].n_links for i in range(1000)]) >= .99 * 999


def test_recall_below_the_target_raises(spark):
    df = spark.createDataFrame(_pairs_beside_a_dense_group(), "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="links found"):
        E.near_duplicates(df, orders=1, pivots=2, audit=64, audits=1)
