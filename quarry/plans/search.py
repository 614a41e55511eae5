"""Index build and batch search.

An index here is a set of tables: product texts, sparse vectors and the
encoder's idf table (plus IVF cells / LSH bands when built). Queries are
encoded with the corpus statistics, once per distinct text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import product_text
from quarry.operators import encode as enc
from quarry.operators import rerank as rr
from quarry.operators.graph import Graph
from quarry.operators.knn import flat_knn
from quarry.operators.prepare import judged_products, unique_products
from quarry.session import materialize as materialize_df

RERANK_DEPTH = 50


@dataclass
class TextIndex:
    texts: DataFrame      # product_id, text
    vectors: DataFrame    # product_id, idx, val
    model: enc.HashedModel
    terms: DataFrame      # product_id, token, tf (corpus statistics, reused by BM25)
    n_tokens: int | None = None
    cells: DataFrame | None = None      # product_id, idx, val, bucket (IVF)
    centroids: DataFrame | None = None  # cell, vec (IVF)
    graph: Graph | None = None          # neighbour graph over the vectors
    counts: DataFrame | None = None     # product_id, counts: the terms in one row, where ids are unique
    entries: enc.Entries | None = None  # weighted entries, shared by the dimensions of a sweep
    at: str | None = None               # the folder that holds the tables under their names

    def total_tokens(self) -> int:
        """Corpus length in tokens (for BM25's average document length)."""
        if self.n_tokens is None:
            self.n_tokens = int(self.terms.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])
        return self.n_tokens


def product_texts(merged: DataFrame, strategy: str = "basic", limits: bool = False) -> DataFrame:
    """T1/T2 over the de-duplicated products of the prepared data, whole
    unless the recipes' ``limits`` are asked for."""
    expr = product_text(strategy, limits)  # validates the strategy first
    return unique_products(merged).select("product_id", expr.alias("text"))


def judged_texts(judgments: DataFrame, catalog: DataFrame, strategy: str = "basic",
                 limits: bool = False) -> DataFrame:
    """``product_texts`` of prepared judgments that are not joined to the catalogue yet."""
    expr = product_text(strategy, limits)
    return judged_products(judgments, catalog).select("product_id", expr.alias("text"))


def build_text_index(texts: DataFrame, dim: int = enc.DEFAULT_DIM,
                     materialize: bool = True, id_col: str = "product_id",
                     base: TextIndex | None = None, share: bool = False, at: str | None = None) -> TextIndex:
    """Tokens -> corpus statistics -> vectors. ``texts`` is (id_col,
    text) with unique ids; the index tables are keyed by ``id_col``.

    With ``materialize`` every table of the index is written once as
    Parquet to the shared checkpoint folder: the lineage is cut, a lost
    executor re-reads files instead of re-running the preparation, the term
    table -- used by the idf fit, the encoder and BM25 -- is computed once,
    and later joins see real table sizes. ``base`` is an index of the same texts in
    another dimension: only the vectors are made anew, from its weighted entries, which
    an index with ``share`` writes. ``at`` names the folder of an index that is to be
    saved: its tables are written there, packed, and not copied by ``save_index``."""
    def written(df: DataFrame, name: str) -> DataFrame:
        if not materialize:
            return df
        return materialize_df(df, name, at and f"{at}/{name}", packed=at is not None)

    if base is not None:
        model = enc.HashedModel(dim=dim, n_docs=base.model.n_docs, idf=base.model.idf)
        if base.entries is not None:
            vectors = enc.unit_vectors(base.entries, dim)
        else:
            vectors = (enc.encode_rows(base.counts, model, id_col) if base.counts is not None
                       else enc.encode(base.texts, model, id_col, terms=base.terms))
        return TextIndex(texts=base.texts, vectors=written(vectors, "vectors"), model=model, terms=base.terms,
                         n_tokens=base.total_tokens() if share else base.n_tokens, counts=base.counts,
                         entries=base.entries)
    texts = written(texts, "texts")
    # a written table tells at the cost of its ids whether each row has its own
    unique = materialize and texts.select(id_col).distinct().count() == texts.count()
    counts = written(enc.row_counts(texts, id_col), "counts") if unique else None
    terms = enc.term_counts(texts if counts is None else counts, id_col)
    if counts is None:
        terms = written(terms, "terms")
    model = enc.fit(texts, id_col, dim=dim, terms=terms)
    model.idf = written(model.idf, "idf")
    entries = None
    if counts is None:
        vectors = enc.encode(texts, model, id_col, terms=terms)
    else:
        made = enc.row_entries(counts, model, id_col)
        if share:
            made.rows = written(made.rows, "entries")
            entries = made
        vectors = enc.unit_vectors(made, dim)
    return TextIndex(texts=texts, vectors=written(vectors, "vectors"), model=model, terms=terms, counts=counts,
                     entries=entries, at=at if materialize else None)


def encode_query_texts(queries: DataFrame, model: enc.HashedModel, q_id: str = "query_id",
                       text_col: str = "query"):
    """Vectors keyed by ``tkey``, mapping q_id -> tkey, and the distinct texts."""
    uniq, mapping = enc.distinct_texts(queries, q_id, text_col)
    # a bigint key per distinct text for the kernels; written, so that it is fixed
    uniq = materialize_df(uniq.withColumn("tkey", F.monotonically_increasing_id()), "query-texts")
    vec = enc.encode(uniq, model, "tkey", text_col)
    return vec, mapping.join(uniq.select("text_hash", "tkey"), "text_hash").select(q_id, "tkey"), uniq


def encode_queries(queries: DataFrame, model: enc.HashedModel, q_id: str = "query_id",
                   text_col: str = "query"):
    """Distinct query texts are encoded once. Returns (vectors keyed
    by ``tkey``, mapping q_id -> tkey)."""
    return encode_query_texts(queries, model, q_id, text_col)[:2]


def search_flat(queries: DataFrame, index: TextIndex, k: int = 10) -> DataFrame:
    """C3 without rerank: (query_id, rank, product_id, score). Retrieval
    runs once per distinct query text."""
    qv, mapping = encode_queries(queries, index.model)
    hits = flat_knn(qv, index.vectors, k, q_id="tkey", c_id="product_id",
                    kind="sparse", dim=index.model.dim)
    return mapping.join(hits, "tkey").select("query_id", "rank", "product_id", "score")


def candidate_texts(cands: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach the product text, '' when the product has none."""
    return (cands.join(texts, "product_id", "left")
            .withColumn("text", F.coalesce(F.col("text"), F.lit(""))))


def retrieve_candidates(queries: DataFrame, index: TextIndex, depth: int = RERANK_DEPTH) -> DataFrame:
    """First stage of a reranked search: (query_id, retrieval_rank, product_id)."""
    return (search_flat(queries, index, depth)
            .select("query_id", F.col("rank").alias("retrieval_rank"), "product_id"))


def _candidate_terms(cands: DataFrame, index: TextIndex) -> DataFrame:
    """The terms of the candidates alone. Their ids are written first, so that few of
    them are broadcast and the corpus's terms are not shuffled."""
    ids = materialize_df(cands.select("product_id").distinct(), "candidate-ids")
    if index.counts is None:
        terms = index.terms.join(ids, "product_id", "left_semi")
    else:
        terms = enc.term_counts(index.counts.join(ids, "product_id", "left_semi"), "product_id")
    return materialize_df(terms, "candidate-terms")


def _bm25(cands: DataFrame, queries: DataFrame, index: TextIndex, q_id: str) -> DataFrame:
    # the candidate list feeds the branches of the BM25 plan (pairs, keys, terms):
    # written once instead of re-running the first-stage search in each branch
    cands = materialize_df(cands, "candidates")
    return rr.bm25(cands, queries, _candidate_terms(cands, index), index.model.idf, index.model.n_docs,
                   index.total_tokens(), q_id=q_id)


def _scored_hits(hits: DataFrame, uniq: DataFrame, index: TextIndex) -> DataFrame:
    """Pair score of each distinct query text's hits (tkey, rank, product_id): (tkey,
    retrieval_rank, product_id, score) as a written table."""
    cands = hits.select("tkey", F.col("rank").alias("retrieval_rank"), "product_id")
    return materialize_df(_bm25(cands, uniq, index, "tkey"), "scored")


def _scored_texts(queries: DataFrame, index: TextIndex, depth: int) -> tuple[DataFrame, DataFrame]:
    """First stage and pair score of each distinct query text, and the mapping query_id -> tkey."""
    qv, mapping, uniq = encode_query_texts(queries, index.model)
    hits = flat_knn(qv, index.vectors, depth, q_id="tkey", c_id="product_id",
                    kind="sparse", dim=index.model.dim)
    return _scored_hits(hits, uniq, index), mapping


def rerank_hits(hits: DataFrame, uniq: DataFrame, mapping: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """The first k by pair score of each distinct query text's hits, given to its queries."""
    top = materialize_df(rr.rerank_topk(_scored_hits(hits, uniq, index), k, q_id="tkey"), "reranked")
    return mapping.join(top, "tkey").select("query_id", "rank", "product_id", F.round("score", 6).alias("score"))


def bm25_candidates(queries: DataFrame, index: TextIndex, depth: int = RERANK_DEPTH,
                    cands: DataFrame | None = None) -> DataFrame:
    """A13 over the first-stage candidates: adds the BM25 pair score. Without given
    candidates each distinct query text is scored once."""
    if cands is not None:
        return _bm25(cands, queries, index, "query_id")
    scored, mapping = _scored_texts(queries, index, depth)
    return mapping.join(scored, "tkey").drop("tkey")


def reranked(queries: DataFrame, index: TextIndex, k: int = 10, depth: int = RERANK_DEPTH,
             cands: DataFrame | None = None) -> DataFrame:
    """The first k of ``bm25_candidates`` by pair score, with their ``rank``."""
    if cands is not None:
        return rr.rerank_topk(_bm25(cands, queries, index, "query_id"), k)
    scored, mapping = _scored_texts(queries, index, depth)
    top = materialize_df(rr.rerank_topk(scored, k, q_id="tkey"), "reranked")
    return mapping.join(top, "tkey").drop("tkey")


def search_reranked(queries: DataFrame, index: TextIndex, k: int = 10,
                    depth: int = RERANK_DEPTH, cands: DataFrame | None = None) -> DataFrame:
    """C3 with rerank: retrieve ``depth``, rerank by pair score, keep k
    (so k > depth still yields at most depth rows)."""
    return (reranked(queries, index, k, depth, cands)
            .select("query_id", "rank", "product_id", F.round("score", 6).alias("score")))
