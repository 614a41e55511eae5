"""Saved indexes: cells and centroids survive, runs reuse, ties are stable."""

import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import ivf
from quarry.operators import prepare as P
from quarry.plans import index_store as STORE
from quarry.plans import runs as RUNS
from quarry.session import ensure_checkpoint_dir, scratch_path


def _texts(spark, extra=""):
    words = ["red mug", "blue cup", "green tea pot", "tall glass", "red tea cup"]
    return spark.createDataFrame([(str(i), f"{words[i % 5]} number {i}{extra}") for i in range(40)],
                                 "product_id string, text string")


def test_ivf_index_is_reused_and_prunes_cells(spark):
    root = scratch_path(spark, f"reuse-{uuid.uuid4().hex[:8]}")
    cfg = RUNS.RunConfig("x", index_type="ivf", dim=64, nlist=4)
    index = RUNS.index_for(_texts(spark), cfg, root)
    assert index.cells.count() == 40 and index.centroids.count() == 4
    before = index.cells.inputFiles()
    again = RUNS.index_for(_texts(spark), cfg, root)
    assert sorted(again.cells.inputFiles()) == sorted(before)
    other = RUNS.index_for(_texts(spark, " more"), cfg, root)  # same size, other texts
    assert not set(other.cells.inputFiles()) & set(before)
    one = again.cells.where(F.col("bucket") == 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [isnotnull(cell" in plan
    hits = ivf.search(again.vectors.select(F.col("product_id").cast("long").alias("q"), "idx", "val"),
                      again.cells, again.centroids, 1, q_id="q", c_id="product_id", kind="sparse",
                      dim=64, nprobe=4)
    assert hits.where(F.col("score") > 0.999).count() == 40


def test_fingerprints_differ_for_equal_sized_corpora(spark):
    a, b = _texts(spark), _texts(spark, "!")
    assert a.count() == b.count() and STORE.corpus_hash(a) != STORE.corpus_hash(b)


def test_repeated_catalogue_keys_give_one_stable_row(spark):
    rows = [(1, "p", t, "d", None, None, None) for t in ("b title", "a title", "c title")]
    cols = ("example_id long, product_id string, product_title string, product_description string, "
            "product_bullet_point string, product_brand string, product_color string")
    seen = {tuple(P.unique_products(spark.createDataFrame(rows, cols).repartition(n)).collect())
            for n in (1, 2, 3)}
    assert len(seen) == 1


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
