"""Neighbour-graph index and its search (A6, the graph slot).

build   Rows of equal vectors are one node (the least id); nodes are linked to their
        nearest by cosine:
        1. first lists: nodes are ordered along a few random projections, every run of
           ``block`` nodes of an order is compared with itself;
        2. rounds of neighbours-of-neighbours: a node's neighbours, both ways, meet at
           it with their vectors, and the best pairs that would enter a list leave it.
           Pairs of two old entries have met before. Rounds end when few lists change;
        3. pruning: a link goes if a kept, nearer neighbour is nearer to its end than
           the node is, so that the links left point in different directions; links
           are then made mutual and pruned once more to ``2 * m``.
search  A query starts at the best of ``starts`` nodes (the greater of 64 and the square
        root of their number, by hash). Every round expands the best ``width`` open
        entries of its beam by a join with the links, scores the nodes it has not seen,
        and keeps the best ``beam``; a query is done when its beam has no open entry.

Each round writes its table, so a lost executor re-reads files. A node has at most
``size`` list entries, ``size`` reverse entries and ``2 * m`` links, so no group grows
with the data; the cost of building is linear in nodes and rounds, that of a search
depends on beam and links. Approximate: recall is measured in the bench. With every
node as a start the search is exact.

Odd rows: null vectors are not indexed; a zero vector scores 0 with all; copies share a
node and come back by id, k of them at most; fewer than k rows give fewer ranks; an
empty corpus gives no rows. Ids must be unique.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.knn import SCORE_SLICE_BYTES, corpus_matrix, flat_knn, rank_window, rounded
from quarry.operators.lsh import planes
from quarry.session import materialize, spread

M = 16          # links kept per direction
SIZE = 24       # entries of a neighbour list
ORDERS = 4      # projections of the first lists
BLOCK = 512     # nodes of an order compared with each other
ROUNDS = 8      # refining rounds at most
OFFERS = 4      # pairs a node takes from one meeting
SETTLED = 0.01  # share of lists that may still change
BEAM = 64
WIDTH = 32
TABLES = ("nodes", "links", "members", "starts")


@dataclass
class Graph:
    nodes: DataFrame    # node, vectors
    links: DataFrame    # node, out array
    members: DataFrame  # node, id
    starts: DataFrame   # node, vectors

    def save(self, path: str) -> str:
        for t in TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Graph":
        return Graph(*(spark.read.parquet(f"{path}/{t}") for t in TABLES))


@dataclass
class Search:
    hits: DataFrame    # q_id, rank, c_id, score
    scored: DataFrame  # q_id, scored: nodes compared with the query


def _cols(kind: str) -> list[str]:
    return ["vec"] if kind == "dense" else ["idx", "val"]


def _units(pdf: pd.DataFrame, kind: str, dim: int) -> np.ndarray:
    x = corpus_matrix(pdf, kind, dim).T
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _step(dim: int) -> int:
    return max(1, SCORE_SLICE_BYTES // (8 * dim))


# ------------------------------------------------------------ first lists
def _project(batches, bc, kind, dim):
    for whole in batches:
        for s in range(0, len(whole), _step(dim)):
            pdf = whole.iloc[s:s + _step(dim)]
            yield pdf.assign(place=list(_units(pdf, kind, dim) @ bc.value))


def _block_lists(batches, kind, dim, size, block):
    """(node, other, score): the ``size`` best of each run of nodes of one order."""
    block = min(block, _step(dim))
    for whole in batches:
        for _, own in whole.groupby("nth", sort=False):
            for s in range(0, len(own), block):
                pdf = own.iloc[s:s + block]
                x, ids = _units(pdf, kind, dim), pdf["node"].to_numpy()
                sim = rounded(x @ x.T)
                np.fill_diagonal(sim, -np.inf)
                best = np.argsort(-sim, axis=1, kind="stable")[:, :min(size, len(ids) - 1)]
                rows = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pd.DataFrame({"node": ids[rows], "other": ids[best.ravel()],
                                    "score": sim[rows, best.ravel()]})


def _best_lists(entries: DataFrame, size: int) -> DataFrame:
    """(node, near): the ``size`` best entries of each node, each other node once.
    One shuffle serves both aggregates."""
    once = (entries.repartition("node").groupBy("node", "other")
            .agg(F.max("score").alias("score"), F.bool_and("fresh").alias("fresh")))
    entry = F.struct((-F.col("score")).alias("gap"), "other", "fresh")
    return once.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, size).alias("near"))


def first_lists(nodes: DataFrame, kind: str, dim: int, size: int, orders: int,
                block: int = BLOCK) -> DataFrame:
    spark = nodes.sparkSession
    bc = spark.sparkContext.broadcast(planes(orders, dim))
    id_type = nodes.schema["node"].dataType.simpleString()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", place array<double>"
    placed = (spread(nodes).mapInPandas(partial(_project, bc=bc, kind=kind, dim=dim), schema)
              .select("node", *_cols(kind), F.posexplode("place").alias("nth", "at")))
    entries = (placed.repartitionByRange("nth", "at", "node").sortWithinPartitions("nth", "at", "node")
               .select("nth", "node", *_cols(kind))
               .mapInPandas(partial(_block_lists, kind=kind, dim=dim, size=size, block=block),
                            f"node {id_type}, other {id_type}, score double"))
    return _best_lists(entries.withColumn("fresh", F.lit(True)), size)


# ---------------------------------------------------------------- refining
def _centres(batches, dim):
    """Frames of whole centres from rows sorted by ``node``, each of few rows."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["node"].to_numpy()[-1] if len(pdf) else None
        open_ = (pdf["node"] == last).to_numpy()
        whole, rest = pdf[~open_], pdf[open_]
        if len(whole):
            yield from _cut(whole, dim)
    if rest is not None and len(rest):
        yield rest


def _cut(pdf: pd.DataFrame, dim: int):
    names = pdf["node"].to_numpy()
    edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
    at = 0
    while at < len(edges) - 1:
        to = at + 1
        while to < len(edges) - 1 and edges[to + 1] - edges[at] <= _step(dim):
            to += 1
        yield pdf.iloc[edges[at]:edges[to]]
        at = to


def _runs(pdf: pd.DataFrame):
    names = pdf["node"].to_numpy()
    edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
    return zip(edges[:-1], edges[1:], strict=True)


def _meet(batches, kind, dim):
    """Pairs of a centre's neighbours that would enter one another's list."""
    for pdf in _centres(batches, dim):
        x, ids = _units(pdf, kind, dim), pdf["other"].to_numpy()
        least, fresh = pdf["least"].to_numpy(), pdf["fresh"].to_numpy(dtype=bool)
        a, b, score = [], [], []
        for s, e in _runs(pdf):
            sim = rounded(x[s:e] @ x[s:e].T)
            good = (sim > least[s:e, None]) & (fresh[s:e, None] | fresh[None, s:e])
            np.fill_diagonal(good, False)
            near = np.argsort(np.where(good, -sim, np.inf), axis=1, kind="stable")[:, :OFFERS]
            i, j = np.repeat(np.arange(e - s), near.shape[1]), near.ravel()
            i, j = i[good[i, j]], j[good[i, j]]
            a.append(i + s), b.append(j + s), score.append(sim[i, j])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pd.DataFrame({"node": ids[a], "other": ids[b], "score": np.concatenate(score)})


def refine(lists: DataFrame, nodes: DataFrame, kind: str, dim: int, size: int) -> DataFrame:
    """One round: lists in, lists out. An entry that stays is no longer fresh."""
    id_type = nodes.schema["node"].dataType.simpleString()
    entries = lists.select("node", F.explode("near").alias("x")).select(
        "node", "x.other", (-F.col("x.gap")).alias("score"), "x.fresh")
    back = entries.select(F.col("other").alias("node"), F.col("node").alias("other"), "score", "fresh")
    w = Window.partitionBy("node").orderBy(F.col("fresh").desc(), F.col("score").desc(), "other")
    back = back.withColumn("n", F.row_number().over(w)).where(F.col("n") <= size).drop("n")
    around = (entries.unionByName(back).groupBy("node", "other").agg(F.bool_or("fresh").alias("fresh")))
    # what a node must beat: its last entry, or nothing while its list is short
    known = nodes.join(lists.select("node", F.when(F.size("near") >= size, -F.element_at("near", -1)["gap"])
                                    .otherwise(F.lit(-2.0)).alias("least")), "node", "left")
    known = known.select(F.col("node").alias("other"), F.coalesce("least", F.lit(-2.0)).alias("least"), *_cols(kind))
    met = (around.join(known, "other").repartition("node").sortWithinPartitions("node")
           .select("node", "other", "fresh", "least", *_cols(kind))
           .mapInPandas(partial(_meet, kind=kind, dim=dim), f"node {id_type}, other {id_type}, score double"))
    return _best_lists(entries.withColumn("fresh", F.lit(False))
                       .unionByName(back.unionByName(met, allowMissingColumns=True)
                                    .withColumn("fresh", F.lit(True))), size)


def neighbour_lists(nodes: DataFrame, kind: str, dim: int, size: int = SIZE, orders: int = ORDERS,
                    rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(node, near array<(gap = -cosine, other, fresh)>), best first."""
    lists = materialize(first_lists(nodes, kind, dim, size, orders, block), "graph-lists")
    n = lists.count()
    for _ in range(rounds):
        lists = materialize(refine(lists, nodes, kind, dim, size), "graph-lists")
        changed = lists.where(F.exists("near", lambda x: x["fresh"])).count()
        if changed <= SETTLED * n:
            break
    return lists


# ----------------------------------------------------------------- pruning
def keep_links(score: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Positions kept of neighbours in descending ``score``: one goes if a kept
    neighbour is more like it than the node is. Equals in both do not go."""
    kept: list[int] = []
    for i in range(len(score)):
        if all(sim[i, j] <= score[i] for j in kept):
            kept.append(i)
            if len(kept) == most:
                break
    return np.array(kept, dtype=np.int64)


def _prune(batches, kind, dim, most):
    for pdf in _centres(batches, dim):
        x, ids, score = _units(pdf, kind, dim), pdf["other"].to_numpy(), pdf["score"].to_numpy()
        names, kept = pdf["node"].to_numpy(), []
        for s, e in _runs(pdf):
            kept.append(s + keep_links(score[s:e], rounded(x[s:e] @ x[s:e].T), most))
        take = np.concatenate(kept)
        yield pd.DataFrame({"node": names[take], "other": ids[take], "score": score[take]})


def prune(entries: DataFrame, nodes: DataFrame, kind: str, dim: int, most: int) -> DataFrame:
    """(node, other, score) of which each node keeps ``most`` at most."""
    id_type = nodes.schema["node"].dataType.simpleString()
    return (entries.join(nodes.withColumnRenamed("node", "other"), "other")
            .repartition("node").sortWithinPartitions("node", F.col("score").desc(), "other")
            .select("node", "other", "score", *_cols(kind))
            .mapInPandas(partial(_prune, kind=kind, dim=dim, most=most),
                         f"node {id_type}, other {id_type}, score double"))


def build(vectors: DataFrame, id_col: str, kind: str, dim: int, *, m: int = M, size: int = SIZE,
          orders: int = ORDERS, rounds: int = ROUNDS, block: int = BLOCK, starts: int | None = None) -> Graph:
    """The graph over ``vectors`` (id_col, vectors)."""
    cols = _cols(kind)
    rows = materialize(vectors.select(F.col(id_col).alias("id"), *cols).where(F.col(cols[0]).isNotNull()),
                       "graph-rows")
    nodes = materialize(rows.groupBy(*cols).agg(F.min("id").alias("node")).select("node", *cols), "graph-nodes")
    members = materialize(rows.join(nodes, cols).select("node", "id"), "graph-members")
    n = nodes.count()
    lists = neighbour_lists(nodes, kind, dim, size, orders, rounds, block)
    entries = lists.select("node", F.explode("near").alias("x")).select(
        "node", "x.other", (-F.col("x.gap")).alias("score"))
    out = materialize(prune(entries, nodes, kind, dim, m), "graph-out")
    back = out.select(F.col("other").alias("node"), F.col("node").alias("other"), "score")
    w = Window.partitionBy("node").orderBy(F.col("score").desc(), "other")
    both = (out.unionByName(back).distinct().withColumn("n", F.row_number().over(w))
            .where(F.col("n") <= 4 * m).drop("n"))
    links = materialize(prune(both, nodes, kind, dim, 2 * m).groupBy("node")
                        .agg(F.collect_list("other").alias("out")), "graph-links")
    first = max(64, math.isqrt(n)) if starts is None else starts
    begin = materialize(nodes.orderBy(F.md5(F.col("node").cast("string")), "node").limit(first), "graph-starts")
    return Graph(nodes, links, members, begin)


# ------------------------------------------------------------------ search
def _score(batches, kind, dim, q_id):
    mine = {"q_" + c: c for c in _cols(kind)}
    for whole in batches:
        for s in range(0, len(whole), _step(2 * dim)):
            pdf = whole.iloc[s:s + _step(2 * dim)]
            q = corpus_matrix(pdf[list(mine)].rename(columns=mine), kind, dim)
            score = rounded(np.einsum("ij,ij->j", q, corpus_matrix(pdf, kind, dim)))
            yield pd.DataFrame({q_id: pdf[q_id], "node": pdf["node"], "score": score})


def search(queries: DataFrame, graph: Graph, k: int, *, q_id: str, c_id: str, kind: str, dim: int,
           beam: int = BEAM, width: int = WIDTH) -> Search:
    """About the k best of the graph per query (bigint id), by inner product. A beam
    holds at least k entries."""
    cols, beam = _cols(kind), max(beam, k)
    id_type = graph.nodes.schema["node"].dataType.simpleString()
    queries = materialize(queries.select(q_id, *cols), "graph-queries")
    began = flat_knn(queries, graph.starts, beam, q_id=q_id, c_id="node", kind=kind, dim=dim, c_type=id_type)

    def entry(open_):
        return F.struct((-F.col("score")).alias("gap"), "node", open_.alias("open"))

    state = materialize(
        began.groupBy(q_id).agg(F.array_sort(F.collect_list(entry(F.lit(True)))).alias("beam"))
        .withColumn("seen", F.transform("beam", lambda x: x["node"])), "graph-beams")
    n_starts, done = graph.starts.count(), []
    while True:
        done.append(state.where(~F.exists("beam", lambda x: x["open"])).select(q_id, "beam", "seen"))
        active = state.where(F.exists("beam", lambda x: x["open"])).withColumn(
            "turn", F.transform(F.slice(F.filter("beam", lambda x: x["open"]), 1, width), lambda x: x["node"]))
        if active.isEmpty():
            break
        reached = (active.select(q_id, F.explode("turn").alias("node")).join(graph.links, "node")
                   .groupBy(q_id).agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("reached")))
        ahead = materialize(active.join(reached, q_id, "left").withColumn(
            "reached", F.array_except(F.coalesce("reached", F.array().cast(f"array<{id_type}>")), "seen")),
            "graph-ahead")
        pairs = (ahead.select(q_id, F.explode("reached").alias("node")).join(graph.nodes, "node")
                 .join(queries.select(q_id, *[F.col(c).alias("q_" + c) for c in cols]), q_id))
        scored = pairs.mapInPandas(partial(_score, kind=kind, dim=dim, q_id=q_id),
                                   f"{q_id} long, node {id_type}, score double")
        found = scored.groupBy(q_id).agg(F.collect_list(entry(F.lit(True))).alias("found"))
        closed = F.transform("beam", lambda x: F.struct(
            x["gap"].alias("gap"), x["node"].alias("node"),
            (x["open"] & ~F.array_contains(F.col("turn"), x["node"])).alias("open")))
        state = materialize(
            ahead.join(found, q_id, "left")
            .withColumn("beam", F.when(F.col("found").isNull(), closed).otherwise(
                F.slice(F.array_sort(F.concat(closed, "found")), 1, beam)))
            .withColumn("seen", F.concat("seen", "reached")).select(q_id, "beam", "seen"), "graph-beams")
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    hits = best.select(q_id, F.explode(F.slice("beam", 1, k)).alias("x")).select(
        q_id, F.col("x.node").alias("node"), (-F.col("x.gap")).alias("score"))
    nth = Window.partitionBy("node").orderBy("id")
    copies = graph.members.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k)
    rows = hits.join(copies, "node").select(q_id, F.col("id").alias(c_id), "score")
    # every start is scored, the beam's own are seen already
    scored = best.select(q_id, (F.size("seen") + max(0, n_starts - beam)).cast("long").alias("scored"))
    return Search(rank_window(rows, k, q_id, c_id).select(q_id, "rank", c_id, "score"), scored)
