"""Line dedup: exact copies and lines a few edits apart, by segment-partition join.

A line is dropped where an earlier line equals it or is within ``max_edits``
edits of it (Levenshtein over code points).  "Earlier" is the order of document
id, line number; a distinct line counts from its first occurrence, and only
lines of ``min_chars`` characters or more have near copies.

A line of n characters is cut into ``max_edits`` + 1 segments at n*i/k.  Within
max_edits edits at least one segment of the shorter line is untouched, so it is
a substring of the longer one; the shift of segment i is bounded by the edits
left of and right of it (i edits at most before, the rest after, the difference
in length taken off), which is the set of places that are probed.

1. keys: hashes of (length, i, segment) from each line, and of the probed
   substrings; one grouped minimum and maximum finds the few keys under which
   two different lines meet (narrow rows, pre-aggregated);
2. lines are scanned again and only those with such a key go on; word parities
   (an edit changes at most three words) discard most pairs inside the join;
   a key that very many lines share (templates, log lines) is split: the rest of
   its lines is cut into segments and probed in its turn, round by round;
3. banded bit-parallel edit distance verifies what is left: the band of
   2 * max_edits + 1 diagonals is one word, moved along the diagonal.

Only built-in expressions are used.  A frequent line is one distinct line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def _cut(n: Column, i: int, k: int) -> Column:
    return F.floor(n * i / F.lit(k)).cast("int")


def _segment_keys(line: Column, n: Column, edits: int, min_chars: int) -> Column:
    """array<struct<probe boolean, k long>> of one line of ``n`` characters; null
    elements are places outside it."""
    k = edits + 1

    def key(size: Column, i: int, at: Column) -> Column:
        begin, end = _cut(size, i, k), _cut(size, i + 1, k)
        return F.xxhash64(size, F.lit(i), F.substring(line, at + 1, end - begin))

    out = [F.struct(F.lit(False).alias("probe"), key(n, i, _cut(n, i, k)).alias("k"))
           for i in range(k)]
    for less in range(edits + 1):  # the shorter line has ``less`` characters fewer
        size = n - less
        for i in range(k):
            after = edits - i
            for shift in range(max(-i, less - after), min(i, less + after) + 1):
                at = _cut(size, i, k) + shift
                end = at + _cut(size, i + 1, k) - _cut(size, i, k)
                out.append(F.when((size >= min_chars) & (at >= 0) & (end <= n), F.struct(
                    F.lit(True).alias("probe"), key(size, i, at).alias("k"))))
    return F.array(*out)


def _word_parity(line: Column) -> Column:
    """64 parities of the hashed words of a line."""
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(w), F.lit(64)))))


def with_edit_distance(pairs: DataFrame, a: str, b: str, edits: int, out: str) -> DataFrame:
    """``pairs`` with the Levenshtein distance of columns ``a`` and ``b`` where
    it is at most ``edits``, else null.

    Bits 0..2*edits of a word are the rows j-edits..j+edits of column j.  The
    vertical differences of the band follow the diagonal; the value on its
    lowest row is counted down the diagonal, then along the last row.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    zero = F.lit(0).cast("long")
    na, nb = F.size("__a"), F.size("__b")

    def match(j: Column) -> Column:  # rows of column j (from 1) that hold its letter
        letter = F.get("__b", j - 1)
        return reduce(lambda p, q: p + q, (
            F.when(F.get("__a", j - edits + t - 1) == letter, 1 << t).otherwise(0)
            for t in range(width))).cast("long")

    def bit(word: Column, t: Column) -> Column:
        return F.call_function("shiftright", word, t).bitwiseAND(F.lit(1).cast("long")).cast("int")

    def diagonal(s: Column, x: Column) -> Column:
        d0 = x.bitwiseAND(s["vp"]) + s["vp"]
        return F.struct(d0.bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(full)
                        .alias("d0"), s["vp"], s["vn"], s["j"], s["dist"])

    def move(s: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(full)
        hn = s["d0"].bitwiseAND(s["vp"])
        down = F.call_function("shiftright", s["d0"], F.lit(1))
        # from column na - edits + 1 on, the last row lies ``low`` bits below the top
        low = s["j"] - (na - edits)
        change = F.when(low <= 0, 1 - bit(s["d0"], F.lit(width - 1))).otherwise(
            bit(hp, width - 1 - low) - bit(hn, width - 1 - low))
        return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"), (s["j"] + 1).alias("j"),
                        (s["dist"] + change).alias("dist"))

    start = F.struct((full - ((1 << edits) - 1)).alias("vp"), zero.alias("vn"),
                     F.lit(1).alias("j"), F.lit(edits).alias("dist"))
    # a one-element array names a value, so that it is computed once
    fold = F.aggregate("__words", start,
                       lambda s, x: F.transform(F.array(diagonal(s, x)), move)[0])["dist"]
    wide = (na <= edits) | (nb <= edits)  # the band is wider than the table
    dist = (F.when(F.abs(na - nb) > edits, None)
            .when(wide, F.levenshtein(F.col(a), F.col(b))).otherwise(fold))
    return (pairs.withColumn("__a", F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0)))
            .withColumn("__b", F.regexp_extract_all(b, F.lit("(?s)."), F.lit(0)))
            .withColumn("__words", F.when(nb > 0, F.transform(F.sequence(F.lit(1), nb), match))
                        .otherwise(F.array().cast("array<bigint>")))
            .withColumn(out, dist).withColumn(out, F.when(F.col(out) <= edits, F.col(out)))
            .drop("__a", "__b", "__words"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, line) of all lines that hold more than white space."""
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line")
    ).where(F.col("line").rlike(r"\S"))


def _hashes() -> list[Column]:
    """Two independent hashes that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")]


def _met(held: DataFrame, parities: int, letters: int | None = None) -> DataFrame:
    """Different lines that meet under a key, the longer one probed (of equal ones
    the one of the lesser hashes), whose word
    parities (and letter parities, if asked for) differ in few places."""
    extra = [] if letters is None else ["letters"]
    index = held.where(~F.col("probe")).select("k", *(F.col(c).alias(f"i_{c}") for c in
                                                      ("line", "h1", "h2", "sig", *extra)))
    pairs = (held.where("probe").join(index, "k")
             .where("char_length(line) > char_length(i_line) or char_length(line) = char_length(i_line)"
                    " and (h1 < i_h1 or h1 = i_h1 and h2 < i_h2)")
             .where(F.bit_count(F.col("sig").bitwiseXOR(F.col("i_sig"))) <= parities))
    if extra:
        pairs = pairs.where(F.bit_count(F.col("letters").bitwiseXOR(F.col("i_letters"))) <= letters)
    return pairs.select("line", "h1", "h2", "i_line", "i_h1", "i_h2")


def _rest_keys(edits: int, top: bool) -> Column:
    """array<struct<k long, rest string>> of a row (k, probe, less, rest): the keys
    of the segments of ``rest`` and what is left when a segment is taken out; null
    where a place lies outside.  ``less`` is the number of characters that the
    other line has fewer, zero for a row that is not probed."""
    k, n = edits + 1, F.char_length("rest")

    def cell(when: Column, size: Column, i: int, at: Column) -> Column:
        length = _cut(size, i + 1, k) - _cut(size, i, k)
        under = [] if top else [F.col("k")]
        key = F.xxhash64(*under, size, F.lit(i), F.substring("rest", at + 1, length))
        left = F.concat(F.substring("rest", F.lit(1), at), F.substring("rest", at + length + 1, n))
        return F.when(when & (at >= 0) & (at + length <= n),
                      F.struct(key.alias("k"), left.alias("rest")))

    out = [cell(~F.col("probe"), n, i, _cut(n, i, k)) for i in range(k)]
    for less in range(edits + 1):
        for i in range(k):
            after = edits - i
            for shift in range(max(-i, less - after), min(i, less + after) + 1):
                out.append(cell(F.col("probe") & (F.col("less") == less), n - less, i,
                                _cut(n - less, i, k) + shift))
    return F.array(*out)


def _letter_parity(line: Column) -> Column:
    """64 parities of the hashed letters of a line; an edit changes at most two."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64)))))


def _hot_pairs(held: DataFrame, hot: DataFrame, edits: int, min_chars: int,
               split_pairs: int) -> DataFrame:
    """What ``_met`` gives under the hot keys, less pairs that cannot be near.

    Lines that share a segment are within ``edits`` edits only if what is left of
    them without it is, too; so the rest is cut into segments and probed again,
    and a pair must share the key of such a segment besides.  Keys that are still
    hot are split in the same way, until few pairs meet or the rest has no more
    characters than edits are allowed.  Every round shortens the rest."""
    carried = ("line", "h1", "h2", "sig", "letters")
    lines = (held.select("line", "h1", "h2", "sig").distinct()
             .withColumn("letters", _letter_parity(F.col("line"))))
    role = lambda probe, less: F.struct(F.lit(probe).alias("probe"), F.lit(less).alias("less"))
    roles = F.array(role(False, 0), *(role(True, less) for less in range(edits + 1)))
    rows = (lines.select(*carried, F.col("line").alias("rest"), F.explode(roles).alias("r"))
            .select(*carried, "rest", "r.*").where(F.char_length("rest") - F.col("less") >= min_chars)
            .withColumn("k", F.lit(0).cast("long")))

    def narrower(rows: DataFrame, top: bool) -> DataFrame:
        return (rows.select(*carried, "probe", "less", F.explode(_rest_keys(edits, top)).alias("x"))
                .where("x is not null").select(*carried, "probe", "less", "x.*"))

    rows = narrower(rows, top=True).join(hot, "k")
    found = []
    while True:
        # rows that share the key of a parent have rests of one length but for ``less``
        rows = materialize(narrower(rows, top=False).distinct(), "line-rests")
        size = F.max(F.char_length("rest") - F.col("less"))
        pairs = F.count_if("probe") * F.count_if(~F.col("probe"))
        keys = materialize(rows.groupBy("k").agg(pairs.alias("n"), size.alias("size")).where("n > 0")
                           .select("k", ((F.col("n") > split_pairs) & (F.col("size") > edits)).alias("hot")),
                           "line-rest-keys")
        cold = rows.join(keys.where("not hot"), "k")
        found.append(materialize(_met(cold, 3 * edits, 2 * edits), "line-rest-pairs"))
        if keys.where("hot").isEmpty():
            return reduce(DataFrame.union, found)
        rows = rows.join(keys.where("hot").select("k"), "k")


def near_pairs(lines: DataFrame, max_edits: int = 1, min_chars: int = 20,
               max_broadcast_rows: int = 1_000_000, split_pairs: int = 4096) -> DataFrame:
    """(h1, h2, g1, g2): pairs of different lines (column ``line``) within
    ``max_edits`` edits, each once, either way round.  A key under which more than
    ``split_pairs`` pairs meet is split by the rest of its lines."""
    # n is a column of its own: the keys use it many times
    long = lines.select("line", F.char_length("line").alias("n")).where(F.col("n") >= min_chars)
    keys = F.explode(_segment_keys(F.col("line"), F.col("n"), max_edits, min_chars)).alias("x")
    filed = long.select(F.xxhash64("line").alias("h1"), keys).where("x is not null")
    meet = (filed.select("h1", "x.*").groupBy("k")
            .agg(F.min("h1").alias("a"), F.max("h1").alias("b"),
                 F.min("probe").alias("p"), F.max("probe").alias("q"))
            .where("a <> b and p <> q").select("k"))
    meet = materialize(meet, "line-keys")
    if meet.count() <= max_broadcast_rows:
        meet = F.broadcast(meet)
    held = (long.select("line", keys).where("x is not null")
            .select("line", "x.*").join(meet, "k").distinct()
            .select("k", "probe", "line", *_hashes(), _word_parity(F.col("line")).alias("sig")))
    held = materialize(held, "line-segments")
    near = 3 * max_edits
    counts = (held.groupBy("k").agg((F.count_if("probe") * F.count_if(~F.col("probe"))).alias("n"))
              .where(F.col("n") > split_pairs).select("k"))
    hot = materialize(counts, "line-hot-keys")
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= max_broadcast_rows else hot
        pairs = (_met(held.join(hot, "k", "left_anti"), near)
                 .union(_hot_pairs(held.join(hot, "k"), hot, max_edits, min_chars, split_pairs)))
    else:
        pairs = _met(held, near)
    pairs = pairs.distinct()
    # written, so that the filter is not pushed into the fold's inputs
    near = materialize(with_edit_distance(pairs, "i_line", "line", max_edits, "edits")
                       .drop("line", "i_line"), "line-pairs").where("edits is not null")
    return near.select("h1", "h2", F.col("i_h1").alias("g1"), F.col("i_h2").alias("g2"))


def _judged(docs: DataFrame, id_col: str, text_col: str, max_edits: int, min_chars: int,
            **options) -> DataFrame:
    """(doc, text, kept, lines, dropped): the row as a struct, its text, what is
    kept of it, and its counts of full and of dropped lines."""
    lines = _lines(docs, id_col, text_col)
    first = materialize(
        lines.select(*_hashes(), F.struct(F.col("id").isNull().alias("none"), "id", "no", "th")
                     .alias("at"))
        .groupBy("h1", "h2").agg(F.min("at").alias("at")), "first-lines")
    pairs = near_pairs(lines, max_edits, min_chars, **options)
    both = pairs.union(pairs.select("g1", "g2", "h1", "h2"))
    other = first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("at").alias("g_at"))
    late = (both.join(other, ["g1", "g2"]).groupBy("h1", "h2").agg(F.min("g_at").alias("g_at"))
            .join(first, ["h1", "h2"]).where("g_at < at").select("h1", "h2"))
    kept = (first.join(late, ["h1", "h2"], "left_anti")
            .groupBy("at.id", "at.th").agg(F.collect_set("at.no").alias("nos"))
            .select(F.col("id").alias("own"), F.col("th"), "nos"))
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("no"), x.alias("line"), x.rlike(r"\S").alias("full")))
    nos = F.coalesce("nos", F.array().cast("array<int>"))
    stay = F.filter("parts", lambda x: ~x["full"] | F.array_contains(nos, x["no"]))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (rows.join(kept, F.col("id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("th")), "left")
            .withColumn("parts", parts).withColumn("stay", stay)
            .select("doc", "text",
                    F.array_join(F.transform("stay", lambda x: x["line"]), "\n").alias("kept"),
                    F.coalesce(F.size(F.filter("parts", lambda x: x["full"])), F.lit(0)).cast("long").alias("lines"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size("parts") - F.size("stay"))
                    .cast("long").alias("dropped")))


def _columns(names: list[str], text_col: str) -> list[Column]:
    return [(F.col("kept") if c == text_col else F.col("doc").getField(c)).alias(c) for c in names]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_edits: int = 1, min_chars: int = 20, **options) -> DataFrame:
    """``docs`` with ``text_col`` replaced by its kept lines, and the columns
    ``__lines`` and ``__dropped`` (longs), in place of any of these names.

    Lines of nothing but white space are kept and never compared.  A null text
    stays null (0 lines).  Rows with a null id come after all others.  Rows that
    repeat id and text are treated alike: both keep what one would.  Rows of one
    id with different texts are ordered by line number, then by a hash of the
    text.  Other columns pass through, whatever their names."""
    names = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    return _judged(docs, id_col, text_col, max_edits, min_chars, **options).select(
        *_columns(names, text_col), F.col("lines").alias("__lines"), F.col("dropped").alias("__dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        max_edits: int = 1, min_chars: int = 20, **options) -> DataFrame:
    """``docs`` with the kept lines only, without the rows that lost lines and
    have none left but blank ones."""
    out = _judged(docs, id_col, text_col, max_edits, min_chars, **options)
    return out.where("dropped = 0 or dropped < lines").select(*_columns(docs.columns, text_col))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
f AS (SELECT line, min((doc_id, no)) AS first FROM l WHERE regexp_matches(line, '[^ 	

]')
      GROUP BY line),
c AS (SELECT line, first, n, left(line, n // 2) AS a, right(line, n // 2) AS b
      FROM (SELECT *, unnest([length(line), length(line) - 1]) AS n FROM f WHERE length(line) >= 20)),
late AS (SELECT DISTINCT x.line FROM c x JOIN c y ON x.n = y.n AND (x.a = y.a OR x.b = y.b)
         WHERE x.line <> y.line AND y.first < x.first AND levenshtein(x.line, y.line) <= 1),
k AS (SELECT l.*, regexp_matches(l.line, '[^ 	

]') AS has,
        NOT has OR (f.first = (l.doc_id, l.no) AND l.line NOT IN (SELECT line FROM late)) AS stay
      FROM l LEFT JOIN f USING (line))
SELECT doc_id, count(*) FILTER (has) AS n_lines, count(*) FILTER (NOT stay) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stay), '') AS text
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
