"""Sources, preparation, cache, index store, runs and plan shape."""

import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import cache as CACHE
from quarry.operators import prepare as P
from quarry.plans import index_store as STORE
from quarry.plans import registry as R
from quarry.plans import runs as RUNS
from quarry.plans import search as S
from quarry.session import scratch_path
from quarry.sources import tables
from quarry.sources.schemas import MissingColumns


def _scratch(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex[:8]}")


def test_missing_input_and_columns(spark, tmp_path):
    with pytest.raises(Exception):
        tables.read_judgments(spark, str(tmp_path / "absent.parquet"))
    p = str(tmp_path / "bad.parquet")
    spark.createDataFrame([(1, "q")], "query_id long, query string").write.parquet(p)
    with pytest.raises(MissingColumns):
        tables.read_judgments(spark, p)


def test_read_real_layout(spark, tmp_path):
    """S1/S2 on files shaped like the reference's inputs (optional text
    columns absent read as null)."""
    ex = tables.fixture_examples(spark, SF_SMALL)
    cat = tables.fixture_products(spark, SF_SMALL).drop("product_color")
    ex.write.parquet(str(tmp_path / "ex"))
    cat.write.parquet(str(tmp_path / "cat"))
    j = tables.read_judgments(spark, str(tmp_path / "ex"))
    c = tables.read_catalog(spark, str(tmp_path / "cat"))
    assert j.count() == ex.count()
    assert c.where(F.col("product_color").isNotNull()).count() == 0


def test_unknown_parameters_raise(spark):
    m = tables.fixture_examples(spark, SF_SMALL)
    with pytest.raises(ValueError):
        P.filter_version_locale(m, "tiny")
    with pytest.raises(ValueError):
        RUNS.RunConfig("x", index_type="hnsw").validate()
    with pytest.raises(ValueError):
        S.product_texts(m, "fancy")
    with pytest.raises(ValueError):
        P.sample_fraction(m, 0.0)


def test_sample_independent_of_partitioning(spark):
    ex = tables.fixture_examples(spark, SF_SMALL)
    a = {r[0] for r in P.sample_fraction(ex.repartition(1), 0.3).select("example_id").collect()}
    b = {r[0] for r in P.sample_fraction(ex.repartition(7), 0.3).select("example_id").collect()}
    assert a == b and 0 < len(a) < ex.count()


def test_first_per_query_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "b", None), (1, 3, "c", "z")],
                               "query_id long, example_id long, a string, b string")
    r = P.first_per_query(df).first()
    assert (r["example_id"], r["a"], r["b"]) == (1, "b", "x")


def test_ground_truth_keeps_duplicates_and_order(spark):
    df = spark.createDataFrame([(1, 10, "p2", "E"), (1, 11, "p1", "E"), (1, 12, "p2", "S"),
                                (1, 13, "p3", "X")],
                               "query_id long, example_id long, product_id string, esci_label string")
    gt = P.ground_truth(df).orderBy("label", "example_id").collect()
    assert [(r["label"], r["product_id"]) for r in gt] == [("E", "p2"), ("E", "p1"), ("S", "p2")]
    assert P.relevant_set(df).count() == 2


def test_cache_second_pass_encodes_nothing_and_clear(spark):
    prep = R._prepared(spark, SF_SMALL)
    idx = S.build_text_index(S.product_texts(prep, "basic"), 256)
    path = _scratch(spark, "cache")
    key = CACHE.model_key(idx.model, "t")
    v1, m1 = CACHE.encode_cached(idx.texts, idx.model, key, path)
    v2, m2 = CACHE.encode_cached(idx.texts, idx.model, key, path)
    assert m1.count() > 0 and m2.count() == 0
    norm = lambda df: sorted((r["product_id"], tuple(r["idx"])) for r in df.collect())  # noqa
    assert norm(v1) == norm(v2) == norm(idx.vectors)
    other = CACHE.model_key(idx.model, "other")
    CACHE.encode_cached(idx.texts.limit(3), idx.model, other, path)
    CACHE.clear(spark, path, key)
    inv = {r["model"]: r["entries"] for r in CACHE.inventory(spark, path).collect()}
    assert key not in inv and inv[other] == 3


def test_index_roundtrip_and_reuse(spark):
    prep = R._prepared(spark, SF_SMALL)
    idx = S.build_text_index(S.product_texts(prep, "basic"), 512)
    root = _scratch(spark, "index")
    cfg = {"text_strategy": "basic", "dim": 512}
    fp = STORE.fingerprint(cfg, STORE.corpus_hash(idx.texts))
    assert STORE.find_index(spark, root, fp) is None
    STORE.save_index(idx, f"{root}/{fp}", cfg, fp)
    assert STORE.find_index(spark, root, fp) == f"{root}/{fp}"
    # another determinant -> another fingerprint -> no reuse
    fp2 = STORE.fingerprint({**cfg, "sample_frac": 0.1}, STORE.corpus_hash(idx.texts))
    assert fp2 != fp and STORE.find_index(spark, root, fp2) is None
    back = STORE.load_index(spark, f"{root}/{fp}")
    a = sorted((r["product_id"], tuple(r["idx"]), tuple(r["val"])) for r in idx.vectors.collect())
    b = sorted((r["product_id"], tuple(r["idx"]), tuple(r["val"])) for r in back.vectors.collect())
    assert a == b and back.model.n_docs == idx.model.n_docs
    stats = {r["table"]: r["n_rows"] for r in STORE.index_stats(spark, f"{root}/{fp}").collect()}
    assert stats["vectors"] == stats["texts"] == idx.texts.count()


def test_run_and_results_sink(spark):
    j, c = tables.fixture_examples(spark, SF_SMALL), tables.fixture_products(spark, SF_SMALL)
    row = RUNS.run(j, c, RUNS.BASELINE).first()
    assert row["config_name"] == "Baseline" and row["Total_Time"] > 0
    out = RUNS.save_results(RUNS.run(j, c, RUNS.BASELINE), _scratch(spark, "results"))
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 1 and "MRR" in back.columns


def test_best_run_first_on_ties(spark):
    df = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.7), (2, "c", 0.7), (3, "d", None)],
                               "seq int, name string, MRR double")
    assert RUNS.best(df).first()["name"] == "b"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    prep = R._prepared(spark, SF_SMALL)
    # locale filter reaches both scans
    plan = prep._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("product_locale") >= 2
    # no Python UDF in text preparation
    txt = S.product_texts(prep, "enhanced")
    assert "PythonUDF" not in _plan(txt) and "BatchEvalPython" not in _plan(txt)
    # exact search merges with a window group limit, not a full sort per query
    knn = R.q_knn_flat(spark, SF_SMALL)
    knn.collect()
    assert "WindowGroupLimit" in knn._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in _plan(knn)
    # no cartesian products anywhere in the analysis
    ins = R.q_error_insights(spark, SF_SMALL)
    ins.collect()
    p = _plan(ins)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


SUBSET = ["scan_judgments", "join_catalog", "text_basic", "text_enhanced", "embed_hashed",
          "knn_flat", "knn_ivf", "knn_lsh", "search_flat", "eval_metrics", "bm25_pairs",
          "search_reranked", "error_breakdown_rows", "failure_examples", "sample_queries_n",
          "result_coverage", "passage_relevance"]


def test_oracle_subset_sf0001(spark):
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tools.check_oracle import TABLES, digest
    orc = R.oracle()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in SUBSET:
        s = R.QUERIES[name](spark, SF_SMALL).toPandas()
        o = con.execute(orc[name]).df()
        assert sorted(s.columns) == sorted(o.columns), name
        assert len(s) == len(o), name
        assert digest(s) == digest(o), name


def test_run_with_lsh_index(spark):
    """C6 with the approximate-index slot: a metrics row, metrics in range."""
    j, c = tables.fixture_examples(spark, SF_SMALL), tables.fixture_products(spark, SF_SMALL)
    cfg = RUNS.RunConfig("lsh", "enhanced", "lsh", True, dim=1024, lsh_bands=8, lsh_rows=4)
    row = RUNS.evaluate(j, c, cfg).first()
    assert row["name"] == "lsh" and 0.0 <= row["MRR"] <= 1.0 and row["Num_Queries"] > 0
