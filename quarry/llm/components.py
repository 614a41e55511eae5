"""Connected components of a link table, by alternating large and small stars.

Every round is two grouped minima and two joins on the link table; nothing is
collected.  Rounds are written to the shared folder, so a lost executor
re-reads files.  The link table never grows: a star step replaces each link by
one link to a smaller node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("m").alias("a"), "b").where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("m").alias("a"), "b")
            .union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
            .where("a <> b").distinct())


def _digest(links: DataFrame):
    row = links.agg(F.count("*").alias("n"),
                    F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in ``links``; ``root`` is the
    least node reachable.  Self links, repeated links, either direction and
    null ends (ignored) are accepted; an empty table gives no rows."""
    cur = materialize(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "links")
    seen = _digest(cur)
    while seen[0]:
        cur = materialize(_small_star(_large_star(cur)), "links")
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    # all links are stars now: (root, member)
    return (cur.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .union(cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))
