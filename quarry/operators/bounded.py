"""Exact search over IVF cells by bounds.

A cell knows the widest angle between its centre and a member, and its members'
greatest norm. By the triangle inequality for angles no member can score above

    |q| * norm * cos(angle(q, centre) - widest angle)       (angle at least 0)

for a query q. Cells are probed in the order of this bound, some in each round,
twice as many in the next; a query is done when the bound of its next cell lies
below its k-th score so far. The result equals the exact search; what is saved is
the rows of the cells that were never probed.

Driver and broadcasts: one row a cell (centre, angle, norm, size), so nlist x dim,
bounded by parameters as in training. A query carries its order of cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ivf import _centroid_matrix
from quarry.operators.knn import SCORE_SLICE_BYTES, bucketed_knn, corpus_matrix, rank_window
from quarry.session import materialize

SLACK = 1e-6   # scores are compared rounded to six decimals
FIRST = 4      # cells of the first round


@dataclass
class Search:
    hits: DataFrame     # q_id, rank, c_id, score
    rounds: list[dict]  # per round: queries, probes (query x cell), scored (query x row)


def _slices(batches, dim: int, width: int):
    step = max(1, SCORE_SLICE_BYTES // (8 * max(dim, width)))
    for pdf in batches:
        for s in range(0, len(pdf), step):
            yield pdf.iloc[s:s + step]


def _reach(batches, bc, kind, dim):
    """Per cell of a batch: members, least cosine to the centre, greatest norm."""
    place, centres = bc.value
    for pdf in _slices(batches, dim, 1):
        x = corpus_matrix(pdf, kind, dim)
        norm = np.linalg.norm(x, axis=0)
        c = centres[[place[b] for b in pdf["bucket"]]]
        size = np.linalg.norm(c, axis=1) * norm
        cos = np.where(size > 0, np.einsum("ij,ji->i", c, x) / np.where(size > 0, size, 1), 1.0)
        out = pd.DataFrame({"bucket": pdf["bucket"].to_numpy(), "cos": cos, "norm": norm, "n": 1})
        yield out.groupby("bucket", as_index=False).agg({"cos": "min", "norm": "max", "n": "sum"})


def cell_reach(index: DataFrame, centroids: DataFrame, kind: str, dim: int) -> DataFrame:
    """(bucket, n, cos, norm) of every cell that has members."""
    cells, centres = _centroid_matrix(centroids)
    bc = index.sparkSession.sparkContext.broadcast(({int(c): i for i, c in enumerate(cells)}, centres))
    vec = ["vec"] if kind == "dense" else ["idx", "val"]
    return (index.select("bucket", *vec)
            .mapInPandas(partial(_reach, bc=bc, kind=kind, dim=dim), "bucket int, cos double, norm double, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n"), F.min("cos").alias("cos"), F.max("norm").alias("norm")))


def bounds(q: np.ndarray, centres: np.ndarray, cos: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(queries x cells) upper bounds for queries in the columns of ``q``."""
    length = np.linalg.norm(q, axis=0)
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    to_centre = (unit @ q / np.maximum(length, 1e-300)).T
    gap = np.arccos(np.clip(to_centre, -1, 1)) - np.arccos(np.clip(cos, -1, 1)) - 1e-7
    best = np.cos(np.clip(gap, 0, np.pi))
    return np.maximum(best, 0) * length[:, None] * norm


def _order(batches, bc, kind, dim):
    cells, centres, cos, norm = bc.value
    for pdf in _slices(batches, dim, len(cells)):
        b = bounds(corpus_matrix(pdf, kind, dim), centres, cos, norm)
        order = np.argsort(-b, axis=1, kind="stable")
        yield pdf.assign(cells=[cells[o].tolist() for o in order],
                         limits=[r[o].tolist() for r, o in zip(b, order, strict=True)])


def search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, *, q_id: str, c_id: str,
           kind: str, dim: int, c_type: str = "string", first: int = FIRST) -> Search:
    """The exact k best rows of ``index`` (bucket, c_id, vectors) per query.

    Empty cells are never probed; a zero vector as query meets all cells, since
    every score is 0 and the least ids win; fewer than k rows give fewer ranks."""
    spark = queries.sparkSession
    vec = ["vec"] if kind == "dense" else ["idx", "val"]
    index = materialize(index.select("bucket", c_id, *vec), "bounded-index")
    reach = {r["bucket"]: r for r in cell_reach(index, centroids, kind, dim).collect()}  # nlist rows
    cells, centres = _centroid_matrix(centroids)
    used = [i for i, c in enumerate(cells) if int(c) in reach]
    own = [reach[int(cells[i])] for i in used]
    bc = spark.sparkContext.broadcast((cells[used], centres[used], np.array([r["cos"] for r in own]),
                                       np.array([r["norm"] for r in own])))
    queries = queries.select(q_id, *vec)
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())),
                           T.StructField("limits", T.ArrayType(T.DoubleType()))])
    ordered = materialize(queries.mapInPandas(partial(_order, bc=bc, kind=kind, dim=dim), schema), "bounded-queries")
    size = spark.createDataFrame([(r["bucket"], r["n"]) for r in own], "bucket int, n long")

    low, high, best, rounds = 0, first, None, []
    active = ordered.withColumn("least", F.lit(float("-inf")))
    while low < len(used):
        take = F.slice(F.arrays_zip("cells", "limits"), low + 1, high - low)
        probes = materialize(
            active.select(q_id, *vec, "least", F.explode(take).alias("x"))
            .where(F.col("x.limits") >= F.col("least") - SLACK)
            .select(F.col("x.cells").alias("bucket"), q_id, *vec), "bounded-probes")
        work = (probes.join(F.broadcast(size), "bucket")
                .agg(F.countDistinct(q_id).alias("queries"), F.count("*").alias("probes"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("scored")).first())
        if not work["probes"]:
            break
        rounds.append(work.asDict())
        hits = bucketed_knn(index, probes, k, q_id=q_id, c_id=c_id, kind=kind, dim=dim, c_type=c_type,
                            written=True).drop("rank")
        both = hits if best is None else best.unionByName(hits)
        best = materialize(rank_window(both, k, q_id, c_id).drop("rank"), "bounded-best")
        low, high = high, 3 * high
        kth = best.groupBy(q_id).agg(
            F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        # a query goes on if the bound of its next cell reaches its k-th score
        active = (ordered.where(F.size("cells") > low).join(kth, q_id)
                  .where(F.get("limits", F.lit(low)) >= F.col("least") - SLACK))
    if best is None:
        best = spark.createDataFrame([], f"{q_id} long, {c_id} {c_type}, score double")
    return Search(rank_window(best, k, q_id, c_id).select(q_id, "rank", c_id, "score"), rounds)
