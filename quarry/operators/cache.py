"""Embedding cache.

A Parquet table partitioned by ``model`` and keyed by ``(model,
text_hash)`` with ``text_hash = sha2(text, 256)`` -- one entry per
distinct text, so a changed text can never be served a stale vector
(unlike a key built from a count and the first and last texts).
Encoding with the cache: join the texts to the cache, encode only the
``left_anti`` remainder, append it, and union the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import encode as enc
from quarry.session import materialize

SCHEMA = "text_hash string, idx array<int>, val array<float>, model string"


def model_key(model: enc.HashedModel, corpus_fp: str) -> str:
    """The encoder's identity: dimension plus the corpus statistics it was
    fitted on (the same text encodes differently under another idf)."""
    return f"hashed-{model.dim}-{corpus_fp}"


def _read(spark: SparkSession, path: str, key: str) -> DataFrame:
    from quarry.plans.index_store import _fs_exists
    if not _fs_exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("model") == key)


def encode_cached(texts: DataFrame, model: enc.HashedModel, key: str, path: str,
                  id_col: str = "product_id", use_cache: bool = True):
    """(vectors (id, idx, val), misses (text_hash) encoded now).
    Misses are appended to the cache before the result is assembled."""
    spark = texts.sparkSession
    keyed = texts.select(id_col, "text", F.sha2(F.col("text"), 256).alias("text_hash"))
    cached = _read(spark, path, key) if use_cache else spark.createDataFrame([], SCHEMA)
    misses = (keyed.join(cached.select("text_hash"), "text_hash", "left_anti")
              .select("text_hash", "text").dropDuplicates(["text_hash"]))
    misses = materialize(misses, "cache-misses")
    if not misses.isEmpty():
        fresh = enc.encode(misses, model, "text_hash")
        (fresh.select("text_hash", "idx", "val", F.lit(key).alias("model"))
         .write.mode("append").partitionBy("model").parquet(path))
    table = _read(spark, path, key)
    vectors = keyed.join(table, "text_hash").select(id_col, "idx", "val")
    return vectors, misses.select("text_hash")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Entries and payload bytes (4-byte index + 4-byte value per
    non-zero) per model."""
    t = spark.read.schema(SCHEMA).parquet(path)
    return t.groupBy("model").agg(F.count(F.lit(1)).alias("entries"),
                                  (F.coalesce(F.sum(F.size("idx")), F.lit(0)) * 8).alias("bytes"))


def clear(spark: SparkSession, path: str, key: str) -> None:
    """Drop one model's partition, leaving every other model intact."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/model={key}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)
