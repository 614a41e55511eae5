"""Streaming index append and scan-partitioning helpers."""

import uuid

import pytest
from conftest import SF_SMALL
from quarry.operators import prepare as P
from quarry.plans import registry as R
from quarry.plans import search as S
from quarry.session import scratch_path, spread
from quarry.streaming.index_append import append_stream, read_part


def test_append_stream_is_incremental_and_never_retrains(spark):
    prep = R._prepared(spark, SF_SMALL)
    base = P.unique_products(P.split(prep, "train"))
    idx = S.build_text_index(S.product_texts(P.split(prep, "train"), "basic"), 256)
    root = scratch_path(spark, f"test-append-{uuid.uuid4().hex[:8]}")
    new = P.unique_products(prep).join(base.select("product_id"), "product_id", "left_anti")
    # one product of the index arrives again, and the new ones arrive twice
    new.union(base.limit(1)).repartition(2).write.parquet(f"{root}/source")
    new.repartition(1).write.mode("append").parquet(f"{root}/source")
    q = append_stream(spark, f"{root}/source", f"{root}/index", idx.model, f"{root}/_ck",
                      known=idx.texts, max_files_per_trigger=1)
    q.awaitTermination()
    first = read_part(spark, f"{root}/index", "vectors")
    assert first.count() == new.count()
    # a second start with the same checkpoint finds nothing new: no duplicates
    q = append_stream(spark, f"{root}/source", f"{root}/index", idx.model, f"{root}/_ck",
                      known=idx.texts)
    q.awaitTermination()
    assert read_part(spark, f"{root}/index", "vectors").count() == new.count()
    assert read_part(spark, f"{root}/index", "texts").count() == new.count()
    assert read_part(spark, f"{root}/index", "terms").select("product_id").distinct().count() <= new.count()
    # the model was not refitted: vectors equal a batch encode with the same model
    from quarry.operators import encode as enc
    texts = new.select("product_id", S.product_text("basic").alias("text"))
    batch = enc.encode(texts, idx.model, "product_id")
    a = sorted((r["product_id"], tuple(r["idx"])) for r in first.collect())
    b = sorted((r["product_id"], tuple(r["idx"])) for r in batch.collect())
    assert a == b


@pytest.mark.parametrize("size", ["128MB", "256k", "134217728b"])
def test_spread_with_any_size_setting(spark, tmp_path, size):
    par = spark.sparkContext.defaultParallelism
    one = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(one)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert spread(spark.read.parquet(one)).rdd.getNumPartitions() == par
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_containment_matches_brute_force(spark):
    from quarry.operators.containment import containing_pairs
    line = "zeta eta theta iota kappa lambda mu nu"
    docs = [(5, " ".join([line] * 20)), (6, "one two three"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
            (2, "xxalpha beta gamma delta epsilon zeta eta theta iota kappayy tail"),
            (3, "alpha beta gamma delta epsilon zeta eta theta iota"),
            (4, "pre  alpha beta gamma delta  epsilon zeta eta theta iota kappa")]
    passages = [(10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
                (11, "beta gamma delta"), (12, "one two"), (13, "beta"), (14, "gamma delta"),
                (15, "zeta eta theta iota kappa lambda mu nu")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(passages, "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in containing_pairs(p, d).collect()}
    want = {(i, j) for i, pt in passages for j, dt in docs if pt in dt}
    assert got == want and (10, 2) in got and (10, 4) not in got
