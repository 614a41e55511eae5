"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quarry
from quarry.llm import (
    alignment,
    collocations,
    decontam,
    embdedup,
    langid,
    linededup,
    lmscore,
    packing,
    secrets,
    sharding,
    simhash,
    suffixdedup,
    urlfilter,
)
from quarry.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    """Register ``f`` by its name; ship the package to the Python workers."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        quarry.ship(spark)
        return f(spark, sf_dir)
    QUERIES[f.__name__] = run
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query
def op7_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op2_decontam(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark")).drop("th")


ORACLE["op2_decontam"] = decontam.ORACLE


@query
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_linededup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


ORACLE["op6_linededup"] = linededup.ORACLE


@query
def op4_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


ORACLE["op4_sharding"] = sharding.ORACLE


@query
def op1_urlfilter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


@query
def op9_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op8_embdedup(spark, sf_dir):
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_suffixdedup(spark, sf_dir):
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_lmscore(spark, sf_dir):
    return lmscore.evaluate(table(spark, sf_dir, "documents"))


@query
def op12_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = collocations.oracle()
ORACLE["op3_suffixdedup"] = suffixdedup.ORACLE
ORACLE["op9_secrets"] = secrets.oracle()
