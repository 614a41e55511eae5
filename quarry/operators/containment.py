"""Which documents contain a passage verbatim (known-item relevance for
passage retrieval) -- without comparing every passage with every document.

A passage of n whitespace tokens that occurs inside a document shows its
inner tokens 2 .. n-1 unchanged among the document's tokens (only its first
and last token can fuse with neighbouring characters). So the key of
``m = min(8, n - 2)`` inner tokens is an exact candidate filter: every
document window of m tokens is keyed the same way, an equi-join on
(m, key) yields candidate pairs, and ``contains`` verifies each one.
Documents are tokenised once; windows with other keys are dropped in the scan
where the keys are few enough to broadcast. Passages of one or two tokens have
no inner tokens: these few are a stated query set that every document is
searched for, in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WS, strip_ws
from quarry.session import materialize

SHINGLE = 8
MAX_BROADCAST_KEYS = 500_000
SHORT_BLOCK = 256


def _tokens(c):
    return F.split(strip_ws(c), f"{WS}+")


def _key(tok: str, at, m) -> Column:
    return F.xxhash64(F.array_join(F.slice(tok, at, m), " "))


def passage_keys(passages: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, text, m, key); m < 1 for passages without inner tokens."""
    return (passages.select(id_col, F.col(text_col).alias("p_text"), _tokens(F.col(text_col)).alias("tok"))
            .where(F.col("p_text").isNotNull())
            .withColumn("m", F.least(F.lit(shingle), F.size("tok") - 2))
            .select(id_col, "p_text", "m", F.when(F.col("m") >= 1, _key("tok", 2, F.greatest(
                F.col("m"), F.lit(0)))).alias("key")))


def document_windows(docs: DataFrame, lengths: list[int], id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc id, m, key) for every window of m consecutive tokens."""
    def of(m: int) -> Column:
        starts = F.when(F.size("tok") >= m, F.sequence(F.lit(1), F.size("tok") - (m - 1)))
        found = F.transform(starts, lambda i: F.struct(F.lit(m).alias("m"), _key("tok", i, m).alias("key")))
        return F.coalesce(found, F.array().cast("array<struct<m:int,key:bigint>>"))

    return (docs.select(id_col, _tokens(F.col(text_col)).alias("tok"))
            .select(id_col, F.explode(F.concat(*[of(m) for m in lengths])).alias("w"))
            .select(id_col, "w.m", "w.key"))


def containing_pairs(passages: DataFrame, docs: DataFrame, p_id: str = "item_id",
                     d_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(p_id, d_id) for every document whose text contains the passage."""
    pk = materialize(passage_keys(passages, p_id, text_col), "passage-keys")
    lengths = sorted({r["m"] for r in pk.where("m >= 1").select("m").distinct().collect()})  # <= SHINGLE
    texts = docs.select(d_id, F.col(text_col).alias("d_text"))
    found = passages.sparkSession.createDataFrame([], docs.select(d_id).schema).select(
        F.lit(None).cast(pk.schema[p_id].dataType).alias(p_id), d_id)
    if lengths:
        keys = pk.where("m >= 1").select(p_id, "m", "key")
        if keys.count() <= MAX_BROADCAST_KEYS:
            keys = F.broadcast(keys)
        cands = document_windows(docs, lengths, d_id, text_col).join(keys, ["m", "key"]).select(
            p_id, d_id).distinct()
        found = found.union(cands.join(pk.select(p_id, "p_text"), p_id).join(texts, d_id)
                            .where(F.contains("d_text", "p_text")).select(p_id, d_id))
    short = pk.where("m < 1").select(p_id, "p_text")
    blocks = -(-short.count() // SHORT_BLOCK)
    for b in range(blocks):
        part = short.where(F.pmod(F.xxhash64(p_id, "p_text"), F.lit(blocks)) == b)
        held = [F.struct(F.lit(r[p_id]).alias("id"), F.lit(r["p_text"]).alias("t")) for r in part.collect()]
        if held:
            found = found.union(texts.select(d_id, F.explode(F.filter(
                F.array(*held), lambda x: F.contains(F.col("d_text"), x["t"]))).alias("x"))
                .select(F.col("x.id").alias(p_id), d_id).distinct())
    return found
