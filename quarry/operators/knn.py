"""Nearest-neighbour search kernels.

One distributed path for every search. Queries and corpus rows carry a bucket
(exact search: one bucket; IVF: the cell; LSH: the band key). A bucket's sides
are cut into blocks of at most ``QUERY_ROWS`` and ``CORPUS_ROWS`` rows; each pair
of blocks is one ``cogroup`` group that numpy scores in slices of bounded bytes,
and only k rows per query leave it. Both sides of a hot bucket are split, nothing
goes through the driver, and no query x corpus pair ever becomes a row.

Ranking everywhere: the score rounded to 6 decimals (half away from zero, once,
in the kernel) descending, then corpus id ascending, so results do not depend on
the partitioning.

Vector layouts
  sparse: ``idx array<int>`` ascending + ``val array<float>`` (hashed text)
  dense:  ``vec array<float>`` (given embeddings, centroids)
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

ROUND = 6
# rows of one block of either side
QUERY_ROWS = 2048
CORPUS_ROWS = 16384
# bytes of one dense corpus slice or score matrix inside a task
SCORE_SLICE_BYTES = 32 << 20
# entries of a block of queries that is broadcast
BROADCAST_ITEMS = 1 << 20


def rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero at 6 decimals, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**ROUND + 0.5) / 10.0**ROUND


@dataclass
class QueryBlock:
    """Queries as numpy arrays: ids plus either a dense matrix or CSR."""
    ids: np.ndarray
    dim: int
    dense: np.ndarray | None = None
    indptr: np.ndarray | None = None
    idx: np.ndarray | None = None
    val: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.ids)

    @staticmethod
    def from_pandas(pdf: pd.DataFrame, q_id: str, kind: str, dim: int) -> "QueryBlock":
        ids = pdf[q_id].to_numpy(dtype=np.int64)
        if kind == "dense":
            mat = (np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
                   if len(pdf) else np.zeros((0, dim)))
            return QueryBlock(ids=ids, dim=dim, dense=mat)
        lens = np.fromiter((len(a) for a in pdf["idx"]), dtype=np.int64, count=len(pdf))
        indptr = np.concatenate([[0], np.cumsum(lens)])
        idx = (np.concatenate([np.asarray(a, dtype=np.int64) for a in pdf["idx"]])
               if lens.sum() else np.zeros(0, dtype=np.int64))
        val = (np.concatenate([np.asarray(a, dtype=np.float64) for a in pdf["val"]])
               if lens.sum() else np.zeros(0))
        return QueryBlock(ids=ids, dim=dim, indptr=indptr, idx=idx, val=val)

    def rows(self, sel: np.ndarray) -> "QueryBlock":
        """Sub-block of the queries at positions ``sel``."""
        if self.dense is not None:
            return QueryBlock(ids=self.ids[sel], dim=self.dim, dense=self.dense[sel])
        starts, ends = self.indptr[sel], self.indptr[sel + 1]
        lens = ends - starts
        take = (np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])
                if lens.sum() else np.zeros(0, dtype=np.int64))
        return QueryBlock(ids=self.ids[sel], dim=self.dim,
                          indptr=np.concatenate([[0], np.cumsum(lens)]),
                          idx=self.idx[take], val=self.val[take])


def corpus_matrix(pdf: pd.DataFrame, kind: str, dim: int) -> np.ndarray:
    """Corpus batch as a (dim x n) float64 matrix (sparse rows scattered)."""
    n = len(pdf)
    if kind == "dense":
        if n == 0:
            return np.zeros((dim, 0))
        return np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]]).T.copy()
    dt = np.zeros((dim, n))
    lens = np.fromiter((len(a) for a in pdf["idx"]), dtype=np.int64, count=n)
    if lens.sum():
        rows = np.repeat(np.arange(n), lens)
        idx = np.concatenate([np.asarray(a, dtype=np.int64) for a in pdf["idx"]])
        val = np.concatenate([np.asarray(a, dtype=np.float64) for a in pdf["val"]])
        dt[idx, rows] = val
    return dt


def score_matrix(qb: QueryBlock, dt: np.ndarray) -> np.ndarray:
    """(Q x n) inner products of the query block with corpus columns."""
    if qb.dense is not None:
        return qb.dense @ dt
    n = dt.shape[1]
    out = np.zeros((qb.n, n))
    lens = np.diff(qb.indptr)
    nz = np.nonzero(lens)[0]
    if len(nz) == 0 or n == 0:
        return out
    # gather the corpus rows named by query buckets, in query chunks whose
    # gathered slice stays under SCORE_SLICE_BYTES
    per_chunk = max(1, SCORE_SLICE_BYTES // (8 * n))
    i = 0
    while i < len(nz):
        j = i
        total = 0
        while j < len(nz) and (total + lens[nz[j]] <= per_chunk or j == i):
            total += lens[nz[j]]
            j += 1
        qs = nz[i:j]
        s0, s1 = qb.indptr[qs[0]], qb.indptr[qs[-1] + 1]
        g = dt[qb.idx[s0:s1]] * qb.val[s0:s1, None]
        starts = qb.indptr[qs] - s0
        out[qs] = np.add.reduceat(g, starts, axis=0)
        i = j
    return out


def topk_select(scores: np.ndarray, k: int) -> np.ndarray:
    """Boolean mask of the k best columns per row by (rounded score desc,
    column asc); columns must already be in corpus-id order."""
    r = rounded(scores)
    q, n = r.shape
    if n <= k:
        return np.ones_like(r, dtype=bool)
    thr = np.partition(r, n - k, axis=1)[:, n - k]
    gt = r > thr[:, None]
    need = k - gt.sum(axis=1)
    eq = r == thr[:, None]
    return gt | (eq & (np.cumsum(eq, axis=1) <= need[:, None]))


def merge_topk(frames: list[pd.DataFrame], q_id: str, c_id: str, k: int) -> pd.DataFrame:
    """Best k rows per query of frames whose scores are rounded."""
    if not frames:
        return pd.DataFrame({q_id: pd.Series(dtype="int64"), c_id: pd.Series(dtype="object"),
                             "score": pd.Series(dtype="float64")})
    df = pd.concat(frames, ignore_index=True)
    df = df.sort_values([q_id, "score", c_id], ascending=[True, False, True], kind="stable")
    return df.groupby(q_id, sort=False).head(k)


def block_topk(qb: QueryBlock, corpus: pd.DataFrame, c_id: str, kind: str, k: int,
               q_id: str) -> pd.DataFrame:
    """Top-k per query of a corpus block, in slices bounded by the bytes of the
    dense slice (rows x dim) and of the scores (rows x queries)."""
    corpus = corpus.sort_values(c_id, kind="stable").reset_index(drop=True)
    n = len(corpus)
    if n == 0 or qb.n == 0:
        return merge_topk([], q_id, c_id, k)
    step = max(1, SCORE_SLICE_BYTES // (8 * max(qb.n, qb.dim, 1)))
    best = merge_topk([], q_id, c_id, k)
    for s in range(0, n, step):
        part = corpus.iloc[s:s + step]
        sc = score_matrix(qb, corpus_matrix(part, kind, qb.dim))
        qi, cj = np.nonzero(topk_select(sc, k))
        new = pd.DataFrame({q_id: qb.ids[qi], c_id: part[c_id].to_numpy()[cj],
                            "score": rounded(sc[qi, cj])})
        best = merge_topk([best, new] if len(best) else [new], q_id, c_id, k)
    return best


def rank_window(cands: DataFrame, k: int, q_id: str, c_id: str,
                tie: str | None = None) -> DataFrame:
    """row_number top-k per query by (rounded score desc, tie asc)."""
    w = Window.partitionBy(q_id).orderBy(F.col("score").desc(), F.col(tie or c_id).asc())
    return (cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def _group_topk(key, corpus_pdf, probe_pdf, k, q_id, c_id, kind, dim):
    if len(corpus_pdf) == 0 or len(probe_pdf) == 0:
        return merge_topk([], q_id, c_id, k)
    qb = QueryBlock.from_pandas(probe_pdf.drop_duplicates(q_id), q_id, kind, dim)
    return block_topk(qb, corpus_pdf, c_id, kind, k, q_id)


def _blocks(rows: DataFrame, own: str, n_own: str, n_other: str, names: tuple[str, str]) -> DataFrame:
    """Each row's block of its own side, and a copy for every block of the other."""
    return (rows.withColumn(names[0], F.pmod(F.xxhash64(F.col(own)), F.col(n_own)).cast("int"))
            .withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
            .drop(n_own, n_other))


def _paired(c: DataFrame, p: DataFrame, k: int, q_id: str, c_id: str, kind: str, dim: int,
            c_type: str, dedupe: bool = False) -> DataFrame:
    cb, pb = _blocks(c, c_id, "nc", "nq", ("cb", "qb")), _blocks(p, q_id, "nq", "nc", ("qb", "cb"))
    key = ["bucket", "qb", "cb"]
    cands = (cb.groupBy(*key).cogroup(pb.groupBy(*key))
             .applyInPandas(partial(_group_topk, k=k, q_id=q_id, c_id=c_id, kind=kind, dim=dim),
                            f"{q_id} long, {c_id} {c_type}, score double"))
    if dedupe:   # a corpus row reached through several buckets (LSH bands)
        cands = cands.dropDuplicates([q_id, c_id])
    return rank_window(cands, k, q_id, c_id).select(q_id, "rank", c_id, "score")


def _to_one_block(queries: DataFrame, corpus: DataFrame, k: int, q_id: str, c_id: str, kind: str, dim: int,
                  c_type: str) -> DataFrame:
    """Exact top-k of one broadcast block of queries: k rows per query leave a task."""
    block = queries.sparkSession.sparkContext.broadcast(
        QueryBlock.from_pandas(queries.toPandas().drop_duplicates(q_id), q_id, kind, dim))

    def best(batches):
        found = merge_topk([], q_id, c_id, k)
        for pdf in batches:
            new = block_topk(block.value, pdf, c_id, kind, k, q_id)
            found = merge_topk([found, new] if len(found) else [new], q_id, c_id, k)
        yield found

    cands = corpus.mapInPandas(best, f"{q_id} long, {c_id} {c_type}, score double")
    return rank_window(cands, k, q_id, c_id).select(q_id, "rank", c_id, "score")


def one_block(queries: DataFrame, vec_cols: list[str], query_rows: int = QUERY_ROWS) -> bool:
    """Whether the (written) queries are one block that is small enough to be broadcast."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(vec_cols[0])), F.lit(0)).alias("items")).first()
    return size["n"] <= query_rows and size["items"] <= BROADCAST_ITEMS


def probes_to_one_block(queries: DataFrame, probes: DataFrame, corpus_b: DataFrame, k: int, q_id: str, c_id: str,
                        kind: str, dim: int, c_type: str) -> DataFrame:
    """``bucketed_knn`` of one broadcast block of queries, of which each bucket's rows meet
    those that probe it (``probes``: bucket, q_id). Buckets probed by the same queries are
    scored together; rows of other buckets are dropped."""
    vec_cols = ["vec"] if kind == "dense" else ["idx", "val"]
    block = QueryBlock.from_pandas(queries.toPandas().drop_duplicates(q_id), q_id, kind, dim)
    place = {q: i for i, q in enumerate(block.ids.tolist())}
    asked = probes.select("bucket", q_id).distinct().toPandas()
    members = {b: tuple(sorted(place[q] for q in ids)) for b, ids in asked.groupby("bucket")[q_id]}
    groups = {m: g for g, m in enumerate(dict.fromkeys(members.values()))}
    of_bucket = pd.Series({b: groups[m] for b, m in members.items()}, dtype="int64")
    sent = queries.sparkSession.sparkContext.broadcast((of_bucket, [block.rows(np.array(m, int)) for m in groups]))

    def best(batches):
        of, blocks = sent.value
        found = merge_topk([], q_id, c_id, k)
        for pdf in batches:
            group = pdf.pop("bucket").map(of)
            for g, rows in pdf.groupby(group.to_numpy()):
                new = block_topk(blocks[int(g)], rows, c_id, kind, k, q_id)
                found = merge_topk([found, new] if len(found) else [new], q_id, c_id, k)
        yield found

    cands = corpus_b.select("bucket", c_id, *vec_cols).mapInPandas(best, f"{q_id} long, {c_id} {c_type}, score double")
    return rank_window(cands, k, q_id, c_id).select(q_id, "rank", c_id, "score")


def flat_knn(queries: DataFrame, corpus: DataFrame, k: int, *, q_id: str = "query_id",
             c_id: str = "product_id", kind: str = "sparse", dim: int, c_type: str = "string",
             query_rows: int = QUERY_ROWS, corpus_rows: int = CORPUS_ROWS) -> DataFrame:
    """A1: exact inner-product top-k. Returns (q_id, rank, c_id, score).

    Queries must be keyed by a bigint id. Missing neighbours (corpus
    smaller than k) are simply absent rows (F9). Queries of one block that are
    small are broadcast to the corpus, which then stays where it is. Otherwise
    blocks are smaller than ``corpus_rows`` where that gives every core one."""
    vec_cols = ["vec"] if kind == "dense" else ["idx", "val"]
    queries = materialize(queries.select(q_id, *vec_cols), "queries")
    if corpus_rows >= CORPUS_ROWS and one_block(queries, vec_cols, query_rows):
        return _to_one_block(queries, corpus.select(c_id, *vec_cols), k, q_id, c_id, kind, dim, c_type)
    corpus = materialize(corpus.select(c_id, *vec_cols), "corpus")
    n_q, n_c = queries.count(), corpus.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq = max(1, math.ceil(n_q / query_rows))
    nc = max(1, math.ceil(n_c / corpus_rows), min(cores, n_c // 256))
    sizes = [F.lit(0).alias("bucket"), F.lit(nq).alias("nq"), F.lit(nc).alias("nc")]
    return _paired(corpus.select("*", *sizes), queries.select("*", *sizes), k, q_id, c_id, kind,
                   dim, c_type)


def bucketed_knn(corpus_b: DataFrame, probes: DataFrame, k: int, *, q_id: str, c_id: str,
                 kind: str, dim: int, c_type: str = "string", query_rows: int = QUERY_ROWS,
                 corpus_rows: int = CORPUS_ROWS, dedupe: bool = False,
                 written: bool = False) -> DataFrame:
    """corpus_b (bucket, c_id, vectors...), probes (bucket, q_id, vectors...)
    -> (q_id, rank, c_id, score): exact top-k among the probed buckets. The join
    with the sizes of the probed buckets drops every other corpus row. ``written``
    says that corpus_b is a table on storage already."""
    vec_cols = ["vec"] if kind == "dense" else ["idx", "val"]
    corpus_b = corpus_b.select("bucket", c_id, *vec_cols)
    if not written:
        corpus_b = materialize(corpus_b, "bucketed")
    probes = materialize(probes.select("bucket", q_id, *vec_cols), "probes")

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    sizes = materialize(blocks(corpus_b, corpus_rows, "nc").join(
        blocks(probes, query_rows, "nq"), "bucket"), "bucket-sizes")
    return _paired(corpus_b.join(sizes, "bucket"), probes.join(sizes, "bucket"), k, q_id, c_id,
                   kind, dim, c_type, dedupe)
