"""Incremental index append with Structured Streaming (A3: repeated
``add`` appends and never retrains).

New catalogue rows arriving as Parquet files are turned into product texts and
encoded with the *fixed* model of a built index (its idf table), optionally
assigned to fixed IVF cells, and appended to the index's texts, terms and
vectors. A product that the index or an earlier batch holds is not written
again. Each micro-batch writes its own ``batch_id=<n>`` folders with overwrite,
so a batch replayed after a failure replaces its earlier output; the stream's
checkpoint lives in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import product_text
from quarry.operators import encode as enc
from quarry.operators import ivf
from quarry.plans.index_store import _fs_exists
from quarry.sources.schemas import CATALOG


PARTS = ("texts", "terms", "vectors")


def append_stream(spark: SparkSession, source: str, root: str, model: enc.HashedModel,
                  checkpoint: str, strategy: str = "basic", known: DataFrame | None = None,
                  centroids: DataFrame | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    """Start the append stream into ``root``/texts, terms and vectors; returns
    the StreamingQuery. ``known`` holds the product ids of the index."""
    expr = product_text(strategy)
    reader = spark.readStream.schema(CATALOG)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source)
    texts = rows.select("product_id", expr.alias("text"))

    def write_batch(df: DataFrame, batch_id: int) -> None:
        new = df.groupBy("product_id").agg(F.min("text").alias("text"))
        if known is not None:
            new = new.join(known.select("product_id"), "product_id", "left_anti")
        if batch_id and _fs_exists(spark, f"{root}/texts"):
            earlier = spark.read.parquet(f"{root}/texts").where(F.col("batch_id") < batch_id)
            new = new.join(earlier.select("product_id"), "product_id", "left_anti")
        at = {part: f"{root}/{part}/batch_id={batch_id}" for part in PARTS}
        new.write.mode("overwrite").parquet(at["texts"])
        new = spark.read.schema("product_id string, text string").parquet(at["texts"])
        enc.term_counts(new, "product_id", unique=True).write.mode("overwrite").parquet(at["terms"])
        vec = enc.encode(new, model, "product_id")
        if centroids is not None:
            vec = ivf.assign(vec, centroids, "product_id", "sparse", model.dim) \
                     .withColumnRenamed("bucket", "cell")
        vec.write.mode("overwrite").parquet(at["vectors"])

    w = (texts.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_part(spark: SparkSession, root: str, part: str) -> DataFrame:
    """Appended texts, terms or vectors."""
    return spark.read.parquet(f"{root}/{part}").drop("batch_id")
