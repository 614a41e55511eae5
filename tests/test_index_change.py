"""A patched index equals one built from the present texts."""

import uuid

import pytest
from pyspark.sql import functions as F

from quarry.plans import index_change as CHANGE
from quarry.plans import index_store as STORE
from quarry.plans import search as S
from quarry.session import scratch_path

SCHEMA = "product_id string, text string"


def _df(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), SCHEMA)


def _rows(index):
    vec = {r.product_id: (list(r.idx), [round(x, 5) for x in r.val]) for r in index.vectors.collect()}
    idf = {r.token: (r.df, round(r.idf, 9)) for r in index.model.idf.collect()}
    terms = sorted(tuple(r) for r in index.terms.select("product_id", "token", "tf").collect())
    texts = {r.product_id: r.text for r in index.texts.collect()}
    return vec, idf, terms, texts, index.model.n_docs, index.total_tokens()


@pytest.fixture()
def saved(spark):
    rows = {str(i): f"{w} number {i}" for i, w in enumerate(["red mug", "blue cup", "tea pot", "", "glass"])}
    path = scratch_path(spark, f"change-{uuid.uuid4().hex[:8]}")
    STORE.save_index(S.build_text_index(_df(spark, rows), 64), path, {}, "fp")
    return path, rows


def test_patches_equal_a_rebuild(spark, saved):
    path, rows = saved
    steps = [
        {**rows, "0": "red red mug", "7": "new kettle"},      # changed, added
        {"7": "new kettle", "4": "", "9": "red mug number 0"},  # deleted, emptied, added
        rows,                                                 # ids that were buried come back
        {},                                                   # nothing left
        {"0": "mug"},
    ]
    for n, step in enumerate(steps, 1):
        now = _df(spark, step)
        assert CHANGE.patch(spark, path, now) == n
        assert _rows(CHANGE.load(spark, path)) == _rows(S.build_text_index(now, 64))
    assert CHANGE.patch(spark, path, _df(spark, steps[-1])) == len(steps)  # no change, no generation
    out = CHANGE.compact(spark, path, path + "-compact", {"dim": 64})
    assert _rows(STORE.load_index(spark, out)) == _rows(CHANGE.load(spark, path))


def test_diff_names_each_change_once(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "z"), (None, "n")], SCHEMA)
    new = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", ""), ("e", None), (None, "m")], SCHEMA)
    got = {r.product_id: r.change for r in CHANGE.diff(old, new).collect()}
    assert got == {"b": "changed", "d": "deleted", "e": "added"}


def test_a_broken_patch_does_not_exist(spark, saved):
    path, rows = saved
    half = f"{path}/patches/gen=1"
    _df(spark, rows).select("product_id").write.parquet(f"{half}/dead")  # no meta: broken off
    assert CHANGE.generations(spark, path) == [] and CHANGE.load(spark, path).vectors.count() == 5
    now = {**rows, "1": "green cup"}
    assert CHANGE.patch(spark, path, _df(spark, now)) == 1
    assert _rows(CHANGE.load(spark, path)) == _rows(S.build_text_index(_df(spark, now), 64))


def test_index_stats_give_the_files_bytes(spark, saved):
    path, _ = saved
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in STORE.index_stats(spark, path).collect():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{row.table}")
        files = [s for s in at.getFileSystem(conf).listStatus(at) if s.getPath().getName().startswith("part-")]
        rows = spark.read.parquet(f"{path}/{row.table}")
        held = {f.rsplit("/", 1)[1] for f in rows.select(F.col("_metadata.file_path")).distinct()
                .toPandas()["file_path"]}
        assert row.n_rows == rows.count()
        assert row.bytes == sum(s.getLen() for s in files if s.getPath().getName() in held)
