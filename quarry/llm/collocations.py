"""Phrase collocations: phrases of up to five words per language, counted by a
multikey quicksort of suffix pointers, scored at their weakest cut.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and
pieces into words.  A suffix is what starts at a word, at most ``longest`` words of
its piece.

1. Words are counted per language; those below ``least`` can't be in a candidate.
2. So are the pairs of neighbouring words that are left.
3. Only suffixes that start with such a pair go on, cut where the next pair isn't
   frequent (Bloom filters of both, of bounded size, tell: they never say no to a
   frequent one, so nothing is lost).  Equal suffixes of a task travel as one with
   a weight, routed by language and their two leading words; a pair that holds
   more than one in ``hot`` of all pairs is routed by three.  Routes share buckets,
   whose number grows with the pairs.
4. In a bucket, pointers to suffixes are sorted by three-way partitioning, word by
   word: the weight of the equal part is the count of the phrase so far; parts
   below ``least`` are abandoned, an equal part goes on with the next word, down to
   ``longest``.

Words and languages are told apart by 64-bit hashes until the phrases are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.session import materialize

NO_LANG = "und"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACE = hashing.separators(BREAKS + b"\x20\x09")
BREAK = hashing.separators(BREAKS)
PART = 1 << 21     # bytes of text worked on at a time
HELD = 300_000     # different suffixes that a task adds up before it sends them
BUCKET = 200_000   # suffixes, copies included, that are sorted together on average


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def split(raw: list[bytes], langs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: the bytes, start and end and hash of each word, its
    language's hash, and whether the word before it is in the same piece."""
    text = b"\n".join(raw)
    data = np.frombuffer(text, np.uint8)
    start, end, h = hashing.words(data, SPACE)
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), start)
    joined = np.concatenate([[False], piece[1:] == piece[:-1]])[:len(start)]
    behind = np.cumsum([len(r) + 1 for r in raw])
    return text, start, end, h, langs[np.searchsorted(behind, start, side="right")], joined


def _batches(batches: Iterator[pd.DataFrame]):
    for pdf in batches:
        names, texts = pdf["lang"].tolist(), pdf["text"].tolist()
        hashes = {x: lang_hash(x) for x in set(names)}
        langs = np.array([hashes[x] for x in names], np.uint64)
        for at, raw in hashing.parts(texts, PART):
            yield names[at:at + len(raw)], hashes, split(raw, langs[at:at + len(raw)])


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col(text_col).alias("text"))


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, lh long, h long, key long, word, n): words with at least ``least``
    occurrences in their language, and per language a row without a word that
    has the number of all."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, hashes, (text, start, end, h, lh, _) in _batches(batches):
            key, first, n = np.unique(hashing.pair(lh, h), return_index=True, return_counts=True)
            back = {v: k for k, v in hashes.items()}
            yield pd.DataFrame({
                "lang": [back[x] for x in lh[first].tolist()], "lh": lh[first].view(np.int64),
                "h": h[first].view(np.int64), "key": key.view(np.int64),
                "word": [text[a:b].decode("utf-8", "surrogatepass") for a, b in
                         zip(start[first].tolist(), end[first].tolist(), strict=True)], "n": n})
            own, n = np.unique(lh, return_counts=True)
            yield pd.DataFrame({"lang": [back[x] for x in own.tolist()], "lh": own.view(np.int64),
                                "h": 0, "key": 0, "word": None, "n": n})

    kind = "lang string, lh long, h long, key long, word string, n long"
    return (rows.mapInPandas(tally, kind).groupBy("lh", "h", "key")
            .agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"))
            .where((F.col("n") >= least) | F.col("word").isNull()))


def pair_counts(rows: DataFrame, words, least: int) -> DataFrame:
    """(key, n) of neighbouring words that are both in the filter ``words``."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, (_, _, _, h, lh, joined) in _batches(batches):
            one = hashing.pair(lh, h)
            known = words.value.has(one)
            at = np.flatnonzero(joined[1:] & known[1:] & known[:-1]) + 1
            key, n = hashing.tally(hashing.pair(one[at - 1], h[at]))
            yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    return (rows.mapInPandas(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least))


def suffixes(rows: DataFrame, pairs, hot, longest: int, buckets: int) -> DataFrame:
    """(bucket, block), blocks of suffixes with the columns (route, hot, weight,
    language, words), sorted and one behind the other: suffixes whose neighbouring words are
    all in the filter ``pairs``; 0 stands behind the end.  A task adds up equal
    ones, HELD different ones at a time."""
    def found(h: np.ndarray, lh: np.ndarray, joined: np.ndarray) -> list[np.ndarray]:
        """Columns: hash of the suffix, weight, hash of the leading pair, lh, words."""
        key = hashing.pair(hashing.pair(lh, np.concatenate([h[:1], h[:-1]])), h)  # of the pair that ends here
        link = joined & pairs.value.has(key)
        link = np.append(link, np.zeros(longest, bool))
        at = np.flatnonzero(link[1:len(h)])
        wide = np.append(h, np.zeros(longest, np.uint64))
        w, on = [wide[at], wide[at + 1]], np.ones(len(at), bool)
        for k in range(2, longest):
            on = on & link[at + k]
            w.append(np.where(on, wide[at + k], 0).astype(np.uint64))
        whole = lead = key[at + 1]
        for x in w[2:]:
            whole = hashing.pair(whole, x)
        return summed([whole, np.ones(len(at), np.int64), lead, lh[at], *w])

    def summed(cols: list[np.ndarray]) -> list[np.ndarray]:
        whole, first, back = np.unique(cols[0], return_index=True, return_inverse=True)
        n = np.bincount(back, cols[1], len(whole)).astype(np.int64)
        return [whole, n, *(c[first] for c in cols[2:])]

    def blocks(cols: list[np.ndarray]) -> pd.DataFrame:
        _, n, lead, lh, *w = cols
        is_hot = np.isin(lead, hot.value)
        route = np.where(is_hot, hashing.pair(lead, w[2] if longest > 2 else lead), lead)
        bucket = (hashing.mix(route) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((route, bucket))
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        table = np.stack([route, is_hot.astype(np.uint64), n.astype(np.uint64), lh, *w])[:, order]
        return pd.DataFrame({"bucket": bucket[order][first],
                             "block": [x.tobytes() for x in np.split(table, first[1:], axis=1)] if len(first) else []})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for _, _, (_, _, _, h, lh, joined) in _batches(batches):
            new = found(h, lh, joined)
            held = new if held is None else summed([np.concatenate(x) for x in zip(held, new, strict=True)])
            if len(held[0]) > HELD:
                yield blocks(held)
                held = None
        if held is not None:
            yield blocks(held)

    return rows.mapInPandas(emit, "bucket long, block binary")


def quicksort(cols: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Three-way partitioning of pointers to rows of ``cols`` (0: the row has
    ended), column by column.  Yields (columns, a row, weight) for every
    combination of leading values with a weight of at least ``least``."""
    stack = [(np.arange(len(n)), 0)]
    while stack:
        rows, depth = stack.pop()
        value = cols[depth][rows]
        a, b, c = value[0], value[len(value) // 2], value[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        below, above = value < pivot, value > pivot
        for side in (below, above):
            part = rows[side]
            if n[part].sum() >= least:
                stack.append((part, depth))
        same = rows[~(below | above)]
        weight = int(n[same].sum())
        if weight >= least and pivot:
            yield depth + 1, int(same[0]), weight
            if depth + 1 < len(cols):
                stack.append((same, depth + 1))


def phrases(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """(lh, ws array<long>, a) of all phrases of two words or more with a count of
    at least ``least``."""
    def found(group: pd.DataFrame) -> pd.DataFrame:
        table = np.concatenate([np.frombuffer(x, np.uint64).reshape(4 + longest, -1) for x in group["block"]], axis=1)
        table = table[:, np.argsort(table[0], kind="stable")]
        route, hot, n, cols = table[0], table[1], table[2].astype(np.int64), list(table[3:])
        out = []
        for depth, row, weight in quicksort(cols, n, least):
            if depth > 3 or depth == 3 and not hot[row]:
                out.append((row, depth - 1, weight))
        # the leading pair of a hot route is spread over routes: its parts are added up later
        first = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        total = np.add.reduceat(n, first)
        out += [(int(r), 2, int(t)) for r, t in zip(first, total, strict=True) if hot[r]]
        signed = [c.view(np.int64) for c in cols]
        return pd.DataFrame({
            "lh": [int(signed[0][r]) for r, _, _ in out],
            "ws": [[int(c[r]) for c in signed[1:1 + m]] for r, m, _ in out],
            "a": [t for *_, t in out]}).astype({"lh": np.int64, "a": np.int64})

    return (routed.groupBy("bucket").applyInPandas(found, "lh long, ws array<long>, a long")
            .groupBy("lh", "ws").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def _filter(spark, keyed: DataFrame, max_bytes: int, bits: int = 12):
    """A broadcast filter of at most ``max_bytes``; fuller, it says yes more often."""
    size = min(max_bytes, keyed.count() * bits // 8)
    return spark.sparkContext.broadcast(hashing.build(
        keyed.select("key", F.lit(1).alias("level")), max(1, size // hashing.Levels.SHARD)))


def _ranked(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their rank, without bringing a
    group into one task: places in a sort by ranges, less the group's first."""
    placed = materialize(
        df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
        .withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    sizes = sorted((r["part"], r["n"]) for r in
                   placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "__part long, __before long")
    put = (placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
           .withColumn("__place", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)))
    first = put.groupBy(group).agg(F.min("__place").alias("__first"))
    return (put.join(first, group).withColumn("rank", F.col("__place") - F.col("__first") + 1)
            .where(F.col("rank") <= most).drop("__id", "__part", "__before", "__place", "__first"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100,
         longest: int = 5, most: int = 2000, absorb: int = 100, hot: int = 1000,
         max_bytes: int = 16 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each
    language by score, a and phrase.

    Candidates have two to ``longest`` words and a count a of at least ``least``.
    A cut gives l and r, the counts of the two sides, and the score
    floor(1000 a n / (l r)); the lowest counts, ties to the shortest first side.
    A candidate goes if its words lie within a longer one with at least
    ``absorb`` % of its count.

    Null texts are empty, null languages ``und``; repeated rows count as often;
    other columns are ignored; no rows or no candidates give no rows."""
    spark = docs.sparkSession
    rows = _rows(docs, text_col, lang_col)
    counted = materialize(word_counts(rows, least), "collocation-words")
    words = counted.where(F.col("word").isNotNull() & (F.col("n") >= least))
    totals = counted.where(F.col("word").isNull()).select("lh", "lang", "n")
    known = _filter(spark, words, max_bytes)
    pairs = materialize(pair_counts(rows, known, least), "collocation-pairs")
    all_pairs = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = pairs.where(F.col("n") * hot > all_pairs).collect()  # at most ``hot`` rows
    hot_pairs = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    routed = suffixes(rows, _filter(spark, pairs, max_bytes), spark.sparkContext.broadcast(hot_pairs), longest,
                      1 + all_pairs // BUCKET)
    counts = materialize(phrases(routed, least, longest), "collocation-phrases")

    either = counts.unionByName(words.select("lh", F.array("h").alias("ws"), F.col("n").alias("a")))
    cuts = (counts.join(totals.drop("lang"), "lh")
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
            .withColumn("left", F.slice("ws", F.lit(1), F.col("k")))
            .withColumn("right", F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k"))))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(either.select("lh", F.col("ws").alias(side), F.col("a").alias(name)), ["lh", side])
    wide = "decimal(38, 0)"
    score = F.expr(f"(cast(1000 as {wide}) * a * n) div (cast(l as {wide}) * r)")
    scored = (cuts.withColumn("score", score).groupBy("lh", "ws")
              .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lh", "ws", "x.*"))

    size = F.size("ws")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ws", i, m))))
    within = (counts.where(size > 2).select("lh", F.explode(inner).alias("ws"), "a")
              .groupBy("lh", "ws").agg(F.max("a").alias("longer")))
    free = (scored.join(within, ["lh", "ws"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a"))))
    named = (free.select("lh", "ws", F.posexplode("ws").alias("at", "h"))
             .join(words.select("lh", "h", "word"), ["lh", "h"])
             .groupBy("lh", "ws").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("named"))
             .select("lh", "ws", F.array_join(F.col("named.word"), " ").alias("phrase")))
    full = free.join(named, ["lh", "ws"]).join(totals.select("lh", "lang"), "lh")
    return _ranked(full.select("lang", "phrase", "a", "l", "r", "n", "score"), "lang",
                   [F.desc("score"), F.desc("a"), F.asc("phrase")], most).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, longest: int = 5, most: int = 2000, absorb: int = 100) -> str:
    """The same in SQL: every contiguous run of up to ``longest`` words is a row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, '{NO_LANG}') AS lang,
          unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
m AS (SELECT lang, list_slice(w, i, i + m - 1) AS ws FROM s, range(1, {longest + 1}) AS k(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, ws, count(*) AS a FROM m GROUP BY ALL),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT * FROM f WHERE len(ws) > 1 AND a >= {least}),
u AS (SELECT c.lang, c.ws, c.a, k, l.a AS l, r.a AS r, t.n,
        (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
      FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c) c JOIN t USING (lang)
      JOIN f l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, c.k)
      JOIN f r ON r.lang = c.lang AND r.ws = list_slice(c.ws, c.k + 1, len(c.ws))),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
i AS (SELECT lang, list_slice(ws, i, i + m - 1) AS ws, max(a) AS longer
      FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c), range(2, {longest}) AS k(m)
      WHERE m < len(ws) AND i + m - 1 <= len(ws) GROUP BY ALL),
x AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.ws = b.ws
      WHERE i.longer IS NULL OR 100 * i.longer < {absorb} * b.a),
o AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM x)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
WHERE rank <= {most}
"""
