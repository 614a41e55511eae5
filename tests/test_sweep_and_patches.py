"""A sweep scores each distinct query text once and weighs a strategy's entries once; small
query blocks meet their cells in place; a patched index moves only what changed."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.tokens import tokens
from quarry.operators import encode as enc
from quarry.operators import ivf, knn
from quarry.operators import prepare as P
from quarry.plans import index_change as CHANGE
from quarry.plans import index_store as STORE
from quarry.plans import runs as RUNS
from quarry.plans import search as S
from quarry.session import scratch_path
from quarry.sources.schemas import TEXT_FIELDS

PRODUCTS = "product_id string, text string"


def _index(spark, n=120):
    df = spark.createDataFrame([(f"p{i}", f"ring w{i % 7} w{i % 5} x{i}") for i in range(n)], PRODUCTS)
    return S.build_text_index(df, 64)


def test_a_run_scores_each_query_text_once(spark, monkeypatch):
    idx = _index(spark)
    q = spark.createDataFrame([(i, ["ring w1", "w3 x9", "none"][i % 3]) for i in range(30)], "query_id long, query string")
    sizes, bm25 = [], S.rr.bm25
    monkeypatch.setattr(S.rr, "bm25", lambda pairs, *a, **k: sizes.append(pairs.count()) or bm25(pairs, *a, **k))
    cfg = RUNS.RunConfig("r", "basic", "ivf", True, dim=64, k=4, depth=10, nlist=4, nprobe=4)
    got = RUNS.predictions(q, idx, cfg)
    assert sizes == [30]  # three texts, ten candidates each
    want = S.search_reranked(q, idx, 4, 10, S.retrieve_candidates(q, idx, 10))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_sweep_weighs_entries_once_per_text_strategy(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "red ring red"), ("b", "blue ring"), ("c", ""), (None, "ring"), ("d", None)], PRODUCTS)
    base = S.build_text_index(texts, 64, share=True)
    made, entries = [], enc.row_entries
    monkeypatch.setattr(enc, "row_entries", lambda *a: made.append(1) or entries(*a))
    other = S.build_text_index(texts, 24, base=base)
    assert made == []
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(other.vectors) == rows(S.build_text_index(texts, 24).vectors)


@pytest.mark.parametrize("nprobe", [1, 3, 6])
def test_few_queries_meet_the_cells_in_place(spark, monkeypatch, nprobe):
    idx = _index(spark, 300)
    q = spark.createDataFrame([(1, "ring w1"), (2, "w3 x9"), (3, "none"), (5, "")], "query_id long, query string")
    qv, _ = S.encode_queries(q, idx.model)
    cent = ivf.train(idx.vectors, "product_id", "sparse", 64, nlist=6, written=True)
    cells = ivf.assign(idx.vectors, cent, "product_id", "sparse", 64)
    find = lambda: ivf.search(qv, cells, cent, 9, q_id="tkey", c_id="product_id", kind="sparse", dim=64, nprobe=nprobe)
    here = find()
    assert "CoGroups" not in here._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(knn, "BROADCAST_ITEMS", -1)
    there = find()
    assert "CoGroups" in there._jdf.queryExecution().executedPlan().toString()
    pick = lambda d: sorted((r["rank"], r.tkey, r.product_id, r.score) for r in d.collect())
    assert [r[:1] + r[2:] for r in pick(here)] == [r[:1] + r[2:] for r in pick(there)]


def test_sparse_scores_are_products(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ivf, "BLOCK_BYTES", 8 * 512 * 3)
    wide = rng.normal(size=(512, 5))
    size = np.array([0, 2, 40, 1, 0, 300, 7, 2, 0])
    idx = np.concatenate([np.sort(rng.choice(512, n, replace=False)) for n in size]).astype(np.int64)
    val = rng.normal(size=len(idx))
    x = np.zeros((len(size), 512))
    x[np.repeat(np.arange(len(size)), size), idx] = val
    assert np.allclose(ivf._sparse_scores(wide, size, idx, val), x @ wide)


def test_words_are_cut_as_in_the_session(spark, monkeypatch):
    monkeypatch.setattr(enc, "PIECE_BYTES", 20)
    texts = ["Plain TEXT, plain\ttext\n9 a-b_c", None, "", " ,;", "İstanbul ÉTÉ été x", "Σίσυφος ΣΊΣΥΦΟΣ", "a\x00b\x7fc",
             "東京 tower 東京", "no break   line", "²½ x² é", "@[`{ Z z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {r.id: r.counts for r in enc.row_counts(df, "id").collect()}
    want = {r.id: r.t for r in df.select("id", tokens(F.col("text")).alias("t")).collect()}
    for i, words in want.items():
        found = None if got[i] is None else [(c.token, c.tf) for c in got[i]]
        assert found == (sorted(((w, words.count(w)) for w in set(words)), key=lambda p: p[0].encode()) if words else None), i


def test_states_are_the_products_of_each_selection(spark):
    judged = spark.createDataFrame(
        [(7, "a", "us", "train"), (3, "a", "gb", "test"), (9, "b", "us", "test"), (None, "b", "us", "train"), (4, "c", "us", "dev"),
         (6, None, "us", "test"), (8, "e", "us", "train")], "example_id long, product_id string, product_locale string, split string")
    catalog = spark.createDataFrame(
        [("a", "us", "ring", "x", None, None, "long a"), ("a", "gb", "other", None, None, None, "gb a"), ("b", "us", None, "", None, None, None),
         ("b", "us", "twice", None, None, None, None)], "product_id string, product_locale string, " + ", ".join(f"{c} string" for c in TEXT_FIELDS))
    of = {"first": F.col("split") == "train", "second": F.col("split") == "test", "last": F.lit(True)}
    held = P.judged_states(judged, catalog, of)
    for name, chosen in of.items():
        want = P.judged_products(judged.where(chosen), catalog)
        assert sorted(map(repr, P.state_products(held, name, "last").collect())) == sorted(map(repr, want.collect())), name


def _df(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), PRODUCTS)


def _tables(index):
    vec = {r.product_id: (r.idx, [round(x, 5) for x in r.val]) for r in index.vectors.collect()}
    return (vec, {r.token: r.df for r in index.model.idf.collect()}, sorted(map(tuple, index.terms.collect())),
            {r.product_id: r.text for r in index.texts.collect()}, index.model.n_docs, index.total_tokens())


@pytest.mark.parametrize("bound", [0, 1 << 18])
def test_an_index_built_in_its_folder_follows_its_texts(spark, monkeypatch, bound):
    monkeypatch.setattr(CHANGE, "BROADCAST_IDS", bound)
    rows = {str(i): f"{w} number {i}" for i, w in enumerate(["red mug", "blue cup", "tea pot", "", "glass"])}
    path = scratch_path(spark, f"follow-{uuid.uuid4().hex[:8]}")
    built = S.build_text_index(_df(spark, rows), 64, at=path)
    STORE.save_index(built, path, {}, "fp")
    assert not STORE._fs_exists(spark, f"{path}/terms")  # the tables were written once, by the build
    assert {r.table: r.n_rows for r in STORE.index_stats(spark, path).collect()}["terms"] == built.terms.count()
    assert _tables(STORE.load_index(spark, path)) == _tables(built)
    steps = [{k: v + " more" for k, v in rows.items()}, {"1": "blue cup number 1 more", "2": "tea", "8": "mug"}]
    for n, step in enumerate(steps, 1):
        assert CHANGE.patch(spark, path, _df(spark, step)) == n
        assert _tables(CHANGE.load(spark, path)) == _tables(S.build_text_index(_df(spark, step), 64))


def test_long_texts_stay_where_all_or_none_changed(spark):
    rows = {str(i): f"word{i} number" for i in range(30)}
    path = scratch_path(spark, f"stay-{uuid.uuid4().hex[:8]}")
    STORE.save_index(S.build_text_index(_df(spark, rows), 64, at=path), path, {}, "fp")
    CHANGE.patch(spark, path, _df(spark, {k: v + " x" for k, v in rows.items()}))
    plan = CHANGE.load(spark, path).texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
