"""Embedding near-duplicates by NN-descent.

Equal vectors are one node.  The neighbour graph starts from random projection
orders (nodes sorted by the signs of random projections, compared within blocks
of neighbours in that order).  A round of NN-descent then joins the graph with
itself: a node meets the neighbours of some of its neighbours, through an edge
that is new on at least one side.  A node's list holds its best ``k`` edges and
is doubled as long as it is saturated (its last edge still reaches the
threshold), so a group of any size is found.  Rounds end when next to no node
gets a new edge at the threshold.

An audit compares a sample of nodes with all nodes in blocks; while the mean
share of a node's true links that the graph has is below ``recall``, among nodes
with few links or among those of large groups, more projection orders are added
and the rounds go on; if that is not enough either, an error is raised.  Edges at
the threshold are the links.

Cosines are computed in double precision.  Nothing but the audit's sample
(up to ``draws * audit`` vectors) and the random projections is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.session import materialize

EDGE = "a long, b long, sim double"


def _matrix(vectors) -> np.ndarray:
    """Unit rows, in double precision, of packed float64 vectors."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pack(rows: DataFrame) -> DataFrame:
    """Nodes: (nid, dim, unit bytes, n, least, embedding) of distinct vectors
    that have a direction."""
    valid = ((F.size("embedding") > 0)
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("embedding", lambda x: x != 0))
    nodes = (rows.where(valid).groupBy("embedding")
             .agg(F.count("*").alias("n"), F.min("id").alias("least"))
             .withColumn("nid", F.monotonically_increasing_id()))

    @F.pandas_udf("binary")
    def unit(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = np.asarray(v, np.float64)
            x = x / np.abs(x).max()  # very large and very small components stay finite
            out.append((x / np.sqrt(x @ x)).tobytes())
        return pd.Series(out)

    return nodes.withColumn("dim", F.size("embedding")).withColumn("unit", unit("embedding"))


def _projection_edges(nodes: DataFrame, seed: int, explore: float, block: int = 128) -> DataFrame:
    """Edges within blocks of the order by the signs of 62 random projections."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                p = planes.setdefault(dim, np.random.default_rng([seed, dim]).standard_normal((dim, 62)))
                bits = _matrix(g["unit"]) @ p > 0
                key = bits.astype(np.int64) @ (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64))
                yield g.assign(key=key)[["dim", "key", "nid", "unit"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = block // 2
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= block:
                yield pairs(held.iloc[:block], half)
                held = held.iloc[half:]
        if held is not None and len(held) > 1:
            yield pairs(held, len(held))

    def pairs(g: pd.DataFrame, fresh: int) -> pd.DataFrame:
        """Pairs that begin in the first ``fresh`` rows; the rest come with the
        next block, which overlaps by half."""
        out = []
        for _, d in g.groupby("dim"):
            x, ids = _matrix(d["unit"]), d["nid"].to_numpy()
            i, j = np.nonzero(np.triu(x @ x.T >= explore, 1))
            out.append(pd.DataFrame({"a": ids[i], "b": ids[j], "sim": np.einsum("ij,ij->i", x[i], x[j])}))
        return pd.concat(out)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("dim", "nid", "unit").mapInPandas(
        sign, "dim int, key long, nid long, unit binary")
    return (keyed.repartitionByRange(parts, "dim", "key", "nid").sortWithinPartitions("dim", "key", "nid")
            .mapInPandas(compare, EDGE))


def _distinct(edges: DataFrame) -> DataFrame:
    return (edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
            .groupBy("a", "b").agg(F.max("sim").alias("sim")))


def _compared(pairs: DataFrame, nodes: DataFrame, explore: float) -> DataFrame:
    """Edges of the pairs (a, b) whose cosine is at least ``explore``."""
    def dots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby("dim"):
                sim = np.einsum("ij,ij->i", _matrix(g["ua"]), _matrix(g["ub"]))
                keep = sim >= explore
                yield pd.DataFrame({"a": g["a"].to_numpy()[keep], "b": g["b"].to_numpy()[keep],
                                    "sim": sim[keep]})

    left = nodes.select(F.col("nid").alias("a"), "dim", F.col("unit").alias("ua"))
    right = nodes.select(F.col("nid").alias("b"), F.col("dim").alias("bdim"), F.col("unit").alias("ub"))
    return (pairs.join(left, "a").join(right, "b").where("dim = bdim")
            .select("a", "b", "dim", "ua", "ub").mapInPandas(dots, EDGE))


def _round(found: DataFrame, nodes: DataFrame, threshold: float, explore: float, k: int,
           pivots: int, turn: int) -> DataFrame:
    """New edges by one join of the neighbour lists.  ``found`` has the flag
    ``new``."""
    both = (found.select("a", "b", "sim", "new")
            .union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new")))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    # doubled while saturated: all edges at the threshold, and the best k
    lists = (both.withColumn("rank", F.row_number().over(best))
             .where((F.col("rank") <= k) | (F.col("sim") >= threshold)).drop("rank", "sim"))
    drawn = Window.partitionBy("a").orderBy(~F.col("new"), F.xxhash64("a", "b", F.lit(turn)))
    via = (lists.withColumn("draw", F.row_number().over(drawn)).where(F.col("draw") <= pivots)
           .select("a", F.col("b").alias("u"), F.col("new").alias("new1")))
    onward = lists.select(F.col("a").alias("u"), "b", F.col("new").alias("new2"))
    pairs = (via.join(onward, "u").where("a <> b and (new1 or new2)")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
             .join(found.select("a", "b"), ["a", "b"], "left_anti"))
    return _compared(pairs, nodes, explore)


def _drawn(nodes: DataFrame, skip: int, size: int) -> pd.DataFrame:
    """``size`` nodes in the order of a hash, after the first ``skip``."""
    return (nodes.select("nid", "dim", "unit").orderBy(F.xxhash64("nid"), "nid")
            .offset(skip).limit(size).toPandas())


def _true_links(nodes: DataFrame, sample: pd.DataFrame, threshold: float) -> DataFrame:
    """All links (s, o, sim) of the sampled nodes s, by comparison with all nodes."""
    shared = nodes.sparkSession.sparkContext.broadcast(sample)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim = {d: (g["nid"].to_numpy(), _matrix(g["unit"])) for d, g in shared.value.groupby("dim")}
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                if dim in by_dim:
                    ids, q = by_dim[dim]
                    step = max(1, (1 << 22) // len(ids))  # 32 MB of cosines at a time
                    for at in range(0, len(g), step):
                        part = g.iloc[at:at + step]
                        x, mine = _matrix(part["unit"]), part["nid"].to_numpy()
                        i, j = np.nonzero(x @ q.T >= threshold)
                        sim = np.einsum("ij,ij->i", x[i], q[j])
                        ok = (mine[i] != ids[j]) & (sim >= threshold)
                        yield pd.DataFrame({"s": ids[j][ok], "o": mine[i][ok], "sim": sim[ok]})

    return nodes.select("nid", "dim", "unit").mapInPandas(scan, "s long, o long, sim double")


def _audit(nodes: DataFrame, threshold: float, size: int, draws: int, crowd: int) -> tuple[DataFrame, bool]:
    """True links (s, o, sim) of sampled nodes, and whether they are enough to
    judge by.  Nodes are drawn until ``size`` have a link but not more than
    ``crowd``, ``draws * size`` are drawn or there are no more (a quarter of ``size``
    is enough then); of those in larger groups a quarter of ``size`` is taken, as
    each brings its whole group."""
    sample = _drawn(nodes, 0, 0)
    sparse, dense, seen, total = sample, sample, 0, nodes.count()
    while len(sparse) < size and seen < min(total, draws * size):
        sample = _drawn(nodes, seen, min(max(size, 3 * seen), draws * size - seen))
        counts = (_true_links(nodes, sample, threshold).groupBy("s").count().toPandas()
                  .set_index("s")["count"].reindex(sample["nid"], fill_value=0).to_numpy())
        sparse = pd.concat([sparse, sample[(counts > 0) & (counts <= crowd)]])
        dense = pd.concat([dense, sample[counts > crowd]])
        seen += len(sample)
    chosen = pd.concat([sparse[:size], dense[:max(1, size // 4)]], ignore_index=True)
    return _true_links(nodes, chosen, threshold), len(sparse) >= max(1, size // 4) or seen >= total


def _recalls(true: DataFrame, links: DataFrame, crowd: int) -> tuple[float, float]:
    """Mean share of its true links that the graph has per audited node: nodes
    of up to ``crowd`` links, and those of larger groups (1 if there are none)."""
    hit = (true.select("s", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"))
           .join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
           .groupBy("s").agg(F.count("*").alias("n"), F.count("hit").alias("hits")))
    r = hit.agg(*(F.coalesce(F.avg(F.when(c, F.col("hits") / F.col("n"))), F.lit(1.0))
                  for c in (F.col("n") <= crowd, F.col("n") > crowd))).first()
    return float(r[0]), float(r[1])


def _ends(links: DataFrame) -> int:
    """Nodes that have a link."""
    return links.select(F.explode(F.array("a", "b")).alias("n")).distinct().count()


def graph(nodes: DataFrame, threshold: float = 0.95, explore: float = 0.8, k: int = 16,
          pivots: int = 8, orders: int = 6, rounds: int = 12, audit: int = 512,
          recall: float = 0.99, audits: int = 4, draws: int = 32, crowd: int = 64) -> DataFrame:
    """(a, b, sim), a < b: links at ``threshold`` between nodes (nid, dim, unit).

    Each attempt adds twice the projection orders of the one before.  Raises
    RuntimeError if the last one is still below ``recall``."""
    found = None
    true, enough = _audit(nodes, threshold, audit, draws, crowd)
    true = materialize(true, "audit")
    for attempt in range(audits):
        fresh = None
        for i in range(orders * (2**attempt - 1), orders * (2**(attempt + 1) - 1)):
            e = _projection_edges(nodes, i, explore)
            fresh = e if fresh is None else fresh.union(e)
        fresh = _distinct(fresh)
        if found is not None:
            fresh = fresh.join(found.select("a", "b"), ["a", "b"], "left_anti")
        gained = 0  # nodes with a link that this attempt added, most of any round
        for turn in range(rounds):
            fresh = materialize(fresh.withColumn("new", F.lit(True)), "edges")
            found = fresh if found is None else fresh.unionByName(
                found.withColumn("new", F.lit(False)))
            found = materialize(found, "graph") if turn or attempt else found
            moved = _ends(fresh.where(F.col("sim") >= threshold))
            gained = max(gained, moved)
            # nodes, not links: one dense group has next to all links
            tolerated = 0.0005 * _ends(found.where(F.col("sim") >= threshold))
            if turn and moved <= tolerated:
                break
            fresh = _distinct(_round(found, nodes, threshold, explore, k, pivots, turn))
        links = found.where(F.col("sim") >= threshold).select("a", "b", "sim")
        shares = _recalls(true, links, crowd)
        # too few linked nodes to judge by: more orders must not matter either
        if min(shares) >= recall and (enough or gained <= (1 - recall) * _ends(links)):
            break
    else:
        raise RuntimeError(
            f"links found after {audits} attempts: {shares[0]:.4f} per audited node, {shares[1]:.4f} per node of "
            f"groups above {crowd} links, asked {recall}"
            + ("" if enough else "; few linked nodes were drawn, and the last orders still added links"))
    seen = true.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), "sim")
    return links.union(seen).groupBy("a", "b").agg(F.max("sim").alias("sim"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.95, **options) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    ``n_links`` counts the other rows linked directly (rows with an equal vector
    included), ``component_id`` is the least id reachable, ``kept`` says that it
    is the row's own.  Null, empty and zero vectors and vectors with null or
    non-finite components link with nothing; vectors of different length don't
    link.  Rows with a null id count as links of others; they are not kept unless
    alone.  Other columns are ignored."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    nodes = materialize(_pack(rows), "nodes")
    slim = nodes.select("nid", "dim", "unit")
    links = materialize(graph(slim, threshold, **options), "links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = nodes.select(F.col("nid").alias("b"), F.col("n").alias("w"))
    linked = both.join(weight, "b").groupBy("a").agg(F.sum("w").alias("others"))
    member = (nodes.select("nid", "n", "least")
              .join(linked.withColumnRenamed("a", "nid"), "nid", "left")
              .join(components(links).withColumnRenamed("node", "nid"), "nid", "left")
              .withColumn("root", F.coalesce("root", "nid")))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = (member.join(least, "root")
               .select("nid", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    of_vector = nodes.select("embedding", "nid").join(of_node, "nid").drop("nid")
    out = rows.join(of_vector, "embedding", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(component.eqNullSafe(F.col("id")), F.lit(False)).alias("kept"))
