"""A training-data pipeline over ``documents``: language ID, line dedup, SimHash
near-dedup, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quarry
from quarry.llm import decontam, langid, linededup, packing, simhash
from quarry.session import ensure_checkpoint_dir, materialize


def _prepare(spark: SparkSession) -> None:
    """Workers need the package, intermediate tables the shared folder."""
    ensure_checkpoint_dir(spark)
    quarry.ship(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; ``lang`` becomes
    the predicted language."""
    _prepare(spark)
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    lang, score = langid.free_name("lang_out", docs), langid.free_name("score_out", docs)
    judged = langid.predict(docs, model, lang_out=lang, score_out=score)
    return (judged.where(F.col(lang) != langid.UNKNOWN)
            .withColumn("lang", F.col(lang)).select(*(F.col(f"`{c}`") for c in docs.columns)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, and documents that lose all lines;
    ``n_chars`` follows the text."""
    out = linededup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays, the one with the least id."""
    _prepare(spark)
    return simhash.one_per_group(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    _prepare(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]

# Language ID and packing have no SQL form; the stages are tested against
# brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
