"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (13 consecutive words; a shorter item is one window) are sets
of word shingles.  A window occurs in a document only if all its shingles do, so
one necessary token is enough to find it: the rarest of its shingles in the
corpus.  The join is

1. vocabulary: the shingles of all windows; document shingles outside it are
   dropped while the documents are scanned (what is left is written, narrow);
2. rarity: counts of the vocabulary over the whole corpus; each window keeps
   its rarest shingle and that shingle's place (windows whose rarest shingle
   never occurs are done);
3. candidates: document shingles joined to the prefix shingles; the place in
   the window gives the only possible start, which must lie inside the document
   (positional and length bounds);
4. verification: every shingle of the window at its exact place.

Only built-in expressions are used.  The vocabulary and the prefix table are
broadcast only if they have at most ``max_broadcast_rows`` rows, else joined
with a shuffle (skewed shingles are split by AQE).  Documents are never
grouped by shingle, so a passage that a third of the corpus shares is only many
rows of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in text whose A-Z are lowered
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same in any text


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered (null: none).  ``lower`` does just
    that in ASCII texts and is much faster than ``translate``."""
    low = (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
           .otherwise(F.translate(text, UPPER, LOWER)))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def _grams(ws: str, size: int) -> Column:
    """All runs of ``size`` consecutive words, joined by spaces."""
    return F.when(F.size(ws) >= size, F.transform(
        F.sequence(F.lit(1), F.size(ws) - (size - 1)),
        lambda i: F.array_join(F.slice(ws, i, size), " ")))


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item string, win array) distinct windows of items; a null id is ''."""
    ws = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                      words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    return ws.select("item", F.explode(
        F.when(F.size("ws") <= window, F.array("ws"))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size("ws") - (window - 1)),
                               lambda i: F.slice("ws", i, window)))).alias("win")).distinct()


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", window: int = 13,
         shingle: int = 5, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, th, start, m, wid, items): every occurrence of every window in every
    document, ``start`` from 0, ``m`` its words.  ``th`` is the hash of the
    text: rows that repeat an id and a text have their occurrences once."""
    spark = docs.sparkSession

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= max_broadcast_rows else df

    win = windows(items, item_col, item_text, window)
    win = materialize(win.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
                      .withColumn("wid", F.monotonically_increasing_id())
                      .withColumn("m", F.size("win")), "windows")
    size = F.least(F.lit(shingle), F.col("m"))
    placed = win.select("wid", "m", size.alias("size"), F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("m") - size + 1),
        lambda i: F.array_join(F.slice("win", i, size), " "))).alias("at", "gram"))
    vocab = materialize(placed.select("size", "gram").distinct()
                        .withColumn("gid", F.monotonically_increasing_id()), "vocabulary")
    placed = materialize(placed.join(vocab, ["size", "gram"]).select("wid", "m", "at", "gid"),
                         "placed")
    sizes = sorted(r["size"] for r in vocab.select("size").distinct().collect())  # <= shingle rows

    scan = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                       words(F.col(text_col)).alias("ws"))
    known = small(vocab)
    found = None
    for n in sizes:
        part = (scan.select("id", "th", F.size("ws").alias("n"), F.posexplode(_grams("ws", n))
                            .alias("pos", "gram"))
                .join(known.where(F.col("size") == n).drop("size"), "gram")
                .select("id", "th", "n", "pos", "gid"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, th long, n int, pos int, gid long")
    found = materialize(found, "shingles")

    freq = found.groupBy("gid").agg(F.count("*").alias("freq"))
    prefix = (placed.join(freq, "gid", "left")
              .groupBy("wid", "m")
              .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gid", "at")).alias("p"),
                   F.transform(F.sort_array(F.collect_list(F.struct("at", "gid"))),
                               lambda x: x["gid"]).alias("gids"))
              .where("p.freq > 0")
              .select("wid", "m", "gids", F.col("p.gid").alias("gid"), F.col("p.at").alias("at")))
    prefix = materialize(prefix, "prefix")
    cand = (found.join(small(prefix), "gid")
            .withColumn("start", F.col("pos") - F.col("at"))
            .where("start >= 0 and start + m <= n")
            .select("id", "th", "start", "wid", "m", "gids").distinct())
    each = cand.select("id", "th", "start", "wid", "m", F.size("gids").alias("need"),
                       F.posexplode("gids").alias("i", "gid"))
    seen = found.select(F.col("id").alias("fid"), F.col("th").alias("fth"),
                        F.col("pos").alias("fpos"), F.col("gid").alias("fgid"))
    there = each.join(seen, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth"))
                      & (F.col("start") + F.col("i") == F.col("fpos"))
                      & (F.col("gid") == F.col("fgid")), "left_semi")
    whole = (there.groupBy("id", "th", "start", "wid", "m", "need").count()
             .where("count = need").select("id", "th", "start", "m", "wid"))
    return whole.join(win.select("wid", "items"), "wid")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", least_share: int = 20, **options) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_hit, n_items, items_sha256,
    contaminated).  ``n_hit`` counts words inside any occurrence of a window;
    ``contaminated`` is n_hit > 0 and ``least_share`` * n_hit >= n_words.  Null
    texts have no words; rows with null ids are judged like others; repeated
    rows get equal results; an empty benchmark hits nothing."""
    found = hits(docs, items, id_col, text_col, **options)
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", F.col("start") + F.col("m")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["col2"]).alias("end"),
                              (s["n"] + F.greatest(F.lit(0), x["col2"] - F.greatest(s["end"], x["start"])))
                              .alias("n")),
        lambda s: s["n"])
    spans = found.groupBy("id", "th").agg(covered.alias("n_hit"))
    named = (found.select("id", "th", F.explode("items").alias("item")).distinct()
             .groupBy("id", "th").agg(F.sort_array(F.collect_list("item")).alias("items")))
    per_doc = (spans.join(named.withColumnsRenamed({"id": "nid", "th": "nth"}),
                          F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth")))
               .select(F.col("id").alias("hid"), F.col("th").alias("hth"), "n_hit", "items"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(ANY_WORD)), F.lit(0))
                       .cast("long").alias("n_words"))
    out = rows.join(per_doc, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "th", "n_words", n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows."""
    bad = (contamination(docs, items, id_col, text_col, **options).where("contaminated")
           .select(F.col(id_col).alias("__id"), F.col("th").alias("__th")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__id"))
                     & (F.xxhash64(docs[text_col]) == F.col("__th")), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, m, array_to_string(ws[s:s + m - 1], ' ') AS win FROM (
      SELECT item, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s
      FROM i WHERE len(ws) > 0)),
g AS (SELECT doc_id, s, m, array_to_string(ws[s:s + m - 1], ' ') AS win FROM (
      SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS s
      FROM d, (SELECT DISTINCT m FROM w) WHERE len(ws) >= m)),
o AS (SELECT g.doc_id, g.s, g.m, w.item FROM g JOIN w USING (win, m)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
      SELECT doc_id, unnest(range(s, s + m)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
