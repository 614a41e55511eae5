"""Text encoder (A10, A11): signed, hashed, idf-weighted term vectors.

Weight of a token in a text = sign(token) * (1 + ln tf) * idf(token),
summed per hashed bucket, then L2-normalised. ``idf = ln((1 + N) /
(1 + df)) + 1`` is fitted on the corpus and stored with the index so
queries are weighted with the corpus statistics (tokens unseen in the
corpus get df = 0). Vectors are sparse: ``idx array<int>`` (ascending
bucket) and ``val array<float>``; an empty text gives empty arrays.

Plan where ids are unique: tokens are counted within their row, the TABLE most
frequent tokens are broadcast, and a row's buckets are summed within the row.
Only entries of tokens beyond that table are shuffled, to their idf and back to
their row, which travels as token numbers. Where ids repeat: tf per (id, token)
-> idf by token (a bounded table of common tokens is broadcast, the entries of
other tokens are shuffled) -> one shuffle on id serves both the per-bucket sum
and the per-id norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.tokens import TOKEN_SPLIT, bucket_of, hash_of, sign_of, tokens
from quarry.session import spread

DEFAULT_DIM = 4096
COMMON = 1 << 16      # at most so many tokens' idf are broadcast to a join
TABLE = 1 << 19       # at most so many tokens' weights are broadcast to the rows
PIECE_BYTES = 8 << 20  # of text whose words are counted at once


def _pieces(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of at most PIECE_BYTES, or of one row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right"))
        yield at, max(upto - at, 1)
        at = max(upto, at + 1)


# ASCII letters in lower case, other ASCII characters but digits as spaces; bytes of other letters stay
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts with their ASCII characters mapped by _PLAIN."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_PLAIN[held]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text, or words between spaces where it has other letters than ASCII):
    the distinct words with their counts, in the order of their bytes; null where there
    is none."""
    for batch in batches:
        for at, n in _pieces(pc.binary_length(batch.column(1))):
            row, word = _flat(pc.split_pattern(_plain(batch.column(1).slice(at, n)), " "))
            word = word.cast(pa.string())
            some = pc.not_equal(word, "")
            row, coded = row[some.to_numpy(zero_copy_only=False)], word.filter(some).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key, tf = np.unique(row * len(order) + place[coded.indices.to_numpy()], return_counts=True)
            owner = key // max(len(order), 1)
            ends = np.searchsorted(owner, np.arange(n + 1))
            words = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[key - owner * len(order)])),
                                                pa.array(tf.astype(np.int64))], ["token", "tf"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), words, mask=pa.array(np.diff(ends) == 0))], ["id", "counts"])


def row_counts(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, counts array<struct<token, tf>>): the terms of each text in its row, sorted.
    Texts are cut into words as ``tokens`` does, ASCII ones in Python, by a table of
    bytes; the words are counted there."""
    kind, text = texts.schema[id_col].dataType.simpleString(), F.col(text_col)
    words = (F.when(F.octet_length(text) == F.char_length(text), text)
             .otherwise(F.regexp_replace(F.lower(text), TOKEN_SPLIT, " ")))
    return (spread(texts.select(id_col, text_col)).select(F.col(id_col).alias("id"), words.alias("words"))
            .mapInArrow(_count_words, f"id {kind}, counts array<struct<token:string,tf:bigint>>")
            .withColumnRenamed("id", id_col))


def term_counts(texts: DataFrame, id_col: str, text_col: str = "text", unique: bool = False) -> DataFrame:
    """(id, token, tf) for every distinct token of every text. ``unique`` says that no
    two rows have the same id: tokens are then counted within their row, without a
    shuffle of all tokens. ``texts`` may be a table of ``row_counts``."""
    if "counts" in texts.columns:
        return texts.select(id_col, F.explode("counts").alias("t")).select(id_col, "t.token", "t.tf")
    if unique:
        return term_counts(row_counts(texts, id_col, text_col), id_col)
    return (spread(texts.select(id_col, text_col))
            .select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("token"))
            .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf")))


@dataclass
class HashedModel:
    """A fitted encoder: dimension, corpus size and the idf table."""
    dim: int
    n_docs: int
    idf: DataFrame  # token string, df long, idf double

    def unseen_idf(self) -> float:
        import math
        return math.log((1.0 + self.n_docs) / 1.0) + 1.0


def fit(corpus_texts: DataFrame, id_col: str, text_col: str = "text",
        dim: int = DEFAULT_DIM, terms: DataFrame | None = None) -> HashedModel:
    """Corpus statistics: N and df per token (a partial+final hash
    aggregate, so a token in every document is one row per map task)."""
    if terms is None:
        terms = term_counts(corpus_texts, id_col, text_col)
    n_docs = corpus_texts.select(id_col).count()
    idf = (terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
           .withColumn("idf", F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df")))
                       + F.lit(1.0)))
    return HashedModel(dim=dim, n_docs=n_docs, idf=idf)


def _with_idf(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """``terms`` with the idf of their token (null if unseen). Tokens that hold more
    than one in COMMON of the corpus's entries are at most COMMON, and most entries
    are theirs: these meet a broadcast table, only the others are shuffled."""
    idf = idf.select("token", "df", "idf")
    total = idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    often = F.col("df") * F.lit(COMMON) > F.lit(total)
    common = F.broadcast(idf.where(often).select("token", "idf"))
    rest = terms.join(common.select("token"), "token", "left_anti")
    return terms.join(common, "token").unionByName(
        rest.join(idf.where(~often).select("token", "idf"), "token", "left"))


def _least_df(idf: DataFrame) -> int:
    """The df that the tokens of the broadcast table exceed: 0 if it holds them all.
    Distinct values of df are few (their sum is at most that of all entries)."""
    left = TABLE
    for r in sorted(idf.groupBy("df").count().collect(), key=lambda r: -r["df"]):
        left -= r["count"]
        if left < 0:
            return int(r["df"])
    return 0


def _number(batches: Iterator[pa.RecordBatch], tokens: pa.Array, others: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (id, counts): the tokens as numbers in ``tokens`` with their counts, in
    their row; or the other tokens, a row each."""
    for batch in batches:
        lists, n = batch.column(1), batch.num_rows
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        owner, flat = np.repeat(np.arange(n), size), lists.flatten()
        token, tf = flat.field("token"), flat.field("tf")
        at = pc.fill_null(pc.index_in(token, value_set=tokens), -1)
        hit = at.to_numpy(zero_copy_only=False) >= 0
        if others:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[~hit])), token.filter(pa.array(~hit)),
                                              tf.filter(pa.array(~hit))], ["id", "token", "tf"])
        else:
            ends, hit = pa.array(np.searchsorted(owner[hit], np.arange(n + 1)), pa.int32()), pa.array(hit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, at.filter(hit)),
                 pa.ListArray.from_arrays(ends, tf.filter(hit))], ["id", "token", "tf"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and value of each item of a list column (a null list is empty)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), size), lists.flatten()


def _unit_vectors(batches: Iterator[pa.RecordBatch], hashed: np.ndarray, weight: np.ndarray,
                  dim: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, token numbers, tf, other entries (hash, w)) as unit vectors."""
    bucket = hashed % dim
    for batch in batches:
        n = batch.num_rows
        row, token = _flat(batch.column(1))
        token, tf = (x.to_numpy(zero_copy_only=False) for x in (token, batch.column(2).flatten()))
        far_row, far = _flat(batch.column(3))
        key = np.concatenate([row * dim + bucket[token],
                              far_row * dim + far.field("hash").to_numpy(zero_copy_only=False) % dim]).astype(np.int64)
        w = np.concatenate([weight[token] * (1.0 + np.log(tf.astype(np.float64))),
                            far.field("w").to_numpy(zero_copy_only=False)])
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, w = key[first], np.add.reduceat(w, first) if len(first) else w
        norm = np.sqrt(np.bincount(key // dim, w * w, n))[key // dim]
        val = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
        ends = pa.array(np.searchsorted(key, np.arange(n + 1) * dim), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, pa.array((key % dim).astype(np.int32))),
             pa.ListArray.from_arrays(ends, pa.array(val.astype(np.float32)))], ["id", "idx", "val"])


@dataclass
class Entries:
    """The weighted entries of a corpus's rows, of which vectors of any dimension are made."""
    rows: DataFrame   # id, token array<int>, tf array<long>, far array<struct<hash, w>>
    weights: object   # broadcast (hash, weight) of each token number
    id_col: str


def row_entries(counts: DataFrame, model: HashedModel, id_col: str) -> Entries:
    """The entries of ``row_counts`` with unique ids."""
    sc, kind = counts.sparkSession.sparkContext, counts.schema[id_col].dataType.simpleString()
    least = _least_df(model.idf)
    tok = F.col("token")
    table = model.idf.where(F.col("df") > F.lit(least)).select(
        "token", hash_of(tok).alias("hash"), (sign_of(tok) * F.col("idf")).alias("w")).toArrow()
    names = sc.broadcast(table["token"].combine_chunks().cast(pa.string()))
    weights = sc.broadcast((table["hash"].to_numpy().astype(np.int64), table["w"].to_numpy()))

    def numbered(batches):
        return _number(batches, names.value, False)

    def others(batches):
        return _number(batches, names.value, True)

    # a row without an id has an empty vector
    rows = counts.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNotNull(), F.col("counts")).alias("counts"))
    known = rows.mapInArrow(numbered, f"id {kind}, token array<int>, tf array<long>")
    far = rows.mapInArrow(others, f"id {kind}, token string, tf long")
    far = (far.join(model.idf.where(F.col("df") <= F.lit(least)).select("token", "idf"), "token", "left")
           if least else far.withColumn("idf", F.lit(None).cast("double")))
    far = far.groupBy("id").agg(F.collect_list(F.struct(
        hash_of(tok).alias("hash"),
        (sign_of(tok) * (F.lit(1.0) + F.log(F.col("tf").cast("double")))
         * F.coalesce(F.col("idf"), F.lit(model.unseen_idf()))).alias("w"))).alias("far"))
    return Entries(known.join(far, "id", "left"), weights, id_col)


def unit_vectors(entries: Entries, dim: int) -> DataFrame:
    """(id, idx, val) in ``dim`` buckets."""
    weights, kind = entries.weights, entries.rows.schema["id"].dataType.simpleString()

    def vectors(batches):
        return _unit_vectors(batches, *weights.value, dim)

    return (entries.rows.mapInArrow(vectors, f"id {kind}, idx array<int>, val array<float>")
            .withColumnRenamed("id", entries.id_col))


def encode_rows(counts: DataFrame, model: HashedModel, id_col: str) -> DataFrame:
    """``encode`` of ``row_counts`` with unique ids."""
    return unit_vectors(row_entries(counts, model, id_col), model.dim)


def encode(texts: DataFrame, model: HashedModel, id_col: str, text_col: str = "text",
           terms: DataFrame | None = None) -> DataFrame:
    """(id, idx array<int>, val array<float>) for every input id; ids must
    be unique in ``texts`` (one text per id) unless ``terms`` are given."""
    if terms is None:
        return encode_rows(row_counts(texts, id_col, text_col), model, id_col)
    tok = F.col("token")
    weighted = (_with_idf(terms, model.idf).select(
        F.col(id_col), bucket_of(tok, model.dim).alias("bucket"),
        (sign_of(tok) * (F.lit(1.0) + F.log(F.col("tf").cast("double")))
         * F.coalesce(F.col("idf"), F.lit(model.unseen_idf()))).alias("w")))
    per_bucket = (weighted.repartition(id_col)
                  .groupBy(id_col, "bucket").agg(F.sum("w").alias("w")))
    vec = (per_bucket.groupBy(id_col)
           .agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("e"),
                F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    vec = vec.select(
        F.col(id_col),
        F.transform("e", lambda x: x["bucket"]).alias("idx"),
        F.transform("e", lambda x: F.when(F.col("norm") > 0, x["w"] / F.col("norm"))
                    .otherwise(F.lit(0.0)).cast("float")).alias("val"))
    # ids whose text has no token keep an empty (zero) vector
    empty = F.array().cast("array<int>"), F.array().cast("array<float>")
    return (texts.select(id_col).join(vec, id_col, "left")
            .select(id_col, F.coalesce("idx", empty[0]).alias("idx"),
                    F.coalesce("val", empty[1]).alias("val")))


def encode_long(vecs: DataFrame, id_col: str) -> DataFrame:
    """Sparse vectors in long form (id, bucket, w) -- the SQL-oracle shape."""
    return vecs.select(id_col, F.explode(F.arrays_zip("idx", "val")).alias("e")) \
               .select(id_col, F.col("e.idx").alias("bucket"), F.col("e.val").alias("w"))


def distinct_texts(queries: DataFrame, id_col: str = "query_id", text_col: str = "query"):
    """Encode each distinct query text once. Returns (texts keyed by
    text hash, mapping id -> text hash)."""
    keyed = queries.select(id_col, text_col, F.sha2(F.col(text_col), 256).alias("text_hash"))
    uniq = keyed.select("text_hash", text_col).dropDuplicates(["text_hash"])
    return uniq, keyed.select(id_col, "text_hash")
