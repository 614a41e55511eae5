"""Contiguous balanced shards from global byte-size prefix sums.

Rows are put in a global order by range partitioning and sorting inside the
partitions.  Each partition's total size and count (one row a partition) give
the bytes and rows before it; running sums inside it do the rest.  A row belongs
to the shard its first byte falls in when the whole is cut at equal targets, so
shards are contiguous in the order and their sizes differ from the target by
less than one row's size at either end.

Rows that repeat the whole sort key count once with a multiplicity, so even one
row copied a third of the table is one row here and no sort key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

LAW = "bytes"


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; ``slot`` counts from
    0 in each shard.  The order is by id (nulls first), size and checksum; rows
    equal in these get neighbouring slots.  ``grown_shard`` is null: this law
    moves rows when the number of shards changes.  No rows give no rows."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("crc"))
    key = ["id", "size", "crc"]
    ordered = (rows.groupBy(*key).agg(F.count("*").alias("copies"))
               .repartitionByRange(*key).sortWithinPartitions(*key)
               .withColumn("part", F.spark_partition_id()))
    ordered = materialize(ordered, "ordered")  # one job fixes the partition of every row
    weight = F.col("size") * F.col("copies")
    totals = ordered.groupBy("part").agg(F.sum(weight).alias("bytes"), F.sum("copies").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    all_bytes = totals.agg(F.sum("bytes")).first()[0] or 0
    inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    placed = (ordered
              .withColumn("b", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
              .withColumn("r", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
              .join(F.broadcast(starts), "part")
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
              .withColumn("byte", F.col("bytes0") + F.col("b") + F.col("copy") * F.col("size"))
              .withColumn("row", F.col("rows0") + F.col("r") + F.col("copy"))
              .withColumn("shard", F.expr(f"byte * {shards} div {max(all_bytes, 1)}").cast("int")))
    placed = placed.select("id", "size", "crc", "shard", "row")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"),
        "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder a shard, in slot order per file.
    Rows that repeat id and text have the slots of any of them."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    of = (assign(docs, shards, id_col, text_col)
          .groupBy(F.col(id_col).alias("__id"), F.col("text_crc32").alias("__crc"),
                   F.col("size").alias("__size"))
          .agg(F.min("shard").alias("shard"), F.min("slot").alias("slot")))
    (docs.drop("shard", "slot").join(of, F.col(id_col).eqNullSafe(F.col("__id")) & (F.crc32(raw) == F.col("__crc"))
                                     & (F.octet_length(raw) + 1 == F.col("__size")))
     .drop("__id", "__crc", "__size").repartitionByRange("shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


# The checksum has no SQL function in the oracle's engine: its 256-entry table
# comes from the polynomial and is folded over the bytes.
ORACLE = """
WITH RECURSIVE s(b, i, v) AS (SELECT CAST(b AS BIGINT), 0, CAST(b AS BIGINT) FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
  FROM s WHERE i < 8),
t AS (SELECT list(v ORDER BY b) AS tab FROM s WHERE i = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
u AS (SELECT DISTINCT raw FROM d),
c AS (SELECT raw, xor(list_reduce(list_concat([4294967295], list_transform(
        range(octet_length(raw)), lambda i: CAST(('0x' || substr(hex(raw), 2 * i + 1, 2)) AS BIGINT))),
        lambda a, x : xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295) AS crc FROM u, t),
o AS (SELECT doc_id, octet_length(raw) + 1 AS size, crc FROM d JOIN c USING (raw)),
w AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, crc ROWS UNBOUNDED PRECEDING) - size AS b,
        row_number() OVER (ORDER BY doc_id, size, crc) AS r, sum(size) OVER () AS total FROM o),
p AS (SELECT *, CAST(b * 8 // total AS INTEGER) AS shard FROM w)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
