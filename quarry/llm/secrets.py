"""Secret scan: fixed patterns and sliding-window entropy, in column expressions.

Spans are (kind, start, end) in code points, end exclusive.

* assign, access, hex: the base patterns (leftmost, not overlapping per kind).
* entropy_hex, entropy_base64: candidates are the runs of a character class that
  are at least a window long.  A window slides over the run; when it moves, the
  counts of the character that leaves and the one that enters change by one and
  the sum of n*log2(n) is corrected for just these two.  Windows whose Shannon
  entropy reaches the class's threshold are joined where they overlap.  Runs
  that the allow list fits (whole words, numbers, identifiers of a known shape)
  are suppressed; base spans never are.

Where a text has no match of a cheap test (a substring, a shorter pattern), the
expensive expressions are not evaluated.  A row is scanned whole in its own
task; nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run below 20 characters fails and holds no other match
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int,group:string>>"


@dataclass(frozen=True)
class CharClass:
    name: str
    alphabet: str      # in natural order
    pattern: str       # one character of the class
    window: int
    threshold: float   # bits per character


CLASSES = (
    CharClass("entropy_hex", "0123456789ABCDEFabcdef", "[0-9A-Fa-f]", 24, 3.25),
    CharClass("entropy_base64",
              "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
              "[A-Za-z0-9+/_=-]", 24, 3.85),
)
# Runs that look random and are not secret: words, numbers, rules, UUIDs.  No
# expression repeats a group without a bound: the engine would recurse for it.
ALLOW = (r"^[A-Za-z]+$", r"^[0-9]+$", r"^[=_/+-]+$", r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
# Paths of words, each with a number behind it or none: a run that fits the first
# and holds nothing of the second.
PATHS = (r"^[A-Za-z]+[/_-][A-Za-z0-9/_-]*$", r"[0-9][A-Za-z]")


def _none() -> Column:
    return F.array().cast(SPANS)


def find(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of all matches; ``group`` is the text of that group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    rows = F.transform(F.arrays_zip(whole.alias("w"), part.alias("p"), gaps.alias("g")),
                       lambda r: F.struct(F.char_length(r["w"]).alias("n"), r["p"].alias("p"),
                                          r["g"].alias("g")))
    rows = F.filter(rows, lambda r: r["n"].isNotNull())  # the gap after the last match
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))
    return F.aggregate(rows, start, lambda s, r: F.struct(
        (s["at"] + r["g"] + r["n"]).alias("at"),
        F.concat(s["out"], F.array(F.struct(
            F.lit(kind).alias("kind"), (s["at"] + r["g"]).alias("start"),
            (s["at"] + r["g"] + r["n"]).alias("end"), r["p"].alias("group")))).alias("out")),
        lambda s: s["out"])


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    named = (low.contains("password") | low.contains("passwd") | low.contains("secret")
             | low.contains("token") | low.contains("apikey") | low.contains("api_key"))
    assign = F.filter(find(text, ASSIGN, "assign", 2), lambda x: F.char_length(x["group"]) >= 6)
    return F.concat(F.when(named, assign).otherwise(_none()),
                    F.when(text.contains("AKIA"), find(text, ACCESS, "access")).otherwise(_none()),
                    F.when(text.rlike("[0-9a-f]{24}"), find(text, HEX, "hex")).otherwise(_none()))


def _named(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.transform(F.array(value), body)[0]


def hot_windows(run: Column, c: CharClass) -> Column:
    """array<struct<a int, b int>>: joined windows of ``run`` (all of class
    ``c``) whose entropy is at least the threshold."""
    w = c.window
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 1)])
    # entropy = log2(w) - s / w, so a window is hot where s is at most
    limit = F.lit(w * (math.log2(w) - c.threshold))
    size = len(c.alphabet)

    def term(n: Column) -> Column:
        return F.get(table, n)

    def slide(s: Column, x: Column) -> Column:
        enters, leaves, i = x["enters"], x["leaves"], x["i"]  # leaves: -1 in the first window
        n_out = F.when(leaves >= 0, F.get(s["n"], leaves)).otherwise(0)
        n_in = F.get(s["n"], enters) - F.when(enters == leaves, 1).otherwise(0)
        total = (s["s"] + F.when(leaves >= 0, term(n_out - 1) - term(n_out)).otherwise(0.0)
                 + term(n_in + 1) - term(n_in))
        counts = F.transform(s["n"], lambda v, k: v + F.when(k == enters, 1).otherwise(0)
                             - F.when(k == leaves, 1).otherwise(0))
        return F.struct(counts.alias("n"), total.alias("s"), s["out"].alias("out"), i.alias("i"))

    def join(s: Column) -> Column:
        a, b, last = s["i"] - (w - 1), s["i"] + 1, F.get(s["out"], F.size(s["out"]) - 1)
        new = F.array(F.struct(a.alias("a"), b.alias("b")))
        longer = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1),
                          F.array(F.struct(last["a"].alias("a"), b.alias("b"))))
        # the sum is kept by adding and taking off: a rounding below 1e-9 counts as equal
        out = (F.when((a < 0) | (s["s"] > limit + 1e-9), s["out"])
               .when(last["b"] >= a, longer).otherwise(F.concat(s["out"], new)))
        return F.struct(s["n"].alias("n"), s["s"].alias("s"), out.alias("out"))

    def walk(codes: Column) -> Column:
        steps = F.transform(codes, lambda e, i: F.struct(
            e.alias("enters"), F.coalesce(F.get(codes, i - w), F.lit(-1)).alias("leaves"), i.alias("i")))
        start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"),
                         F.array().cast("array<struct<a:int,b:int>>").alias("out"))
        return F.aggregate(steps, start, lambda s, x: _named(slide(s, x), join), lambda s: s["out"])

    codes = F.transform(F.regexp_extract_all(run, F.lit("."), F.lit(0)),
                        lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    return _named(codes, walk)


def entropy_spans(text: Column, c: CharClass, allow=ALLOW, paths=PATHS) -> Column:
    runs = find(text, rf"(?<!{c.pattern}){c.pattern}{{{c.window},}}", c.name)
    if allow:
        runs = F.filter(runs, lambda r: ~r["group"].rlike("|".join(allow)))
    if paths:
        runs = F.filter(runs, lambda r: ~r["group"].rlike(paths[0]) | r["group"].rlike(paths[1]))
    spans = F.flatten(F.transform(runs, lambda r: F.transform(
        hot_windows(r["group"], c), lambda x: F.struct(
            F.lit(c.name).alias("kind"), (r["start"] + x["a"]).alias("start"),
            (r["start"] + x["b"]).alias("end"), F.lit("").alias("group")))))
    return F.when(text.rlike(f"{c.pattern}{{{c.window}}}"), spans.cast(SPANS)).otherwise(_none())


def joined(spans: Column, kinds) -> Column:
    """kind:start:end by start, then by the place of the kind in ``kinds``."""
    order = F.array(*[F.lit(k) for k in kinds])
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"),
        x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         classes=CLASSES, allow=ALLOW, paths=PATHS) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of
    ``docs``.  A null text is empty: no spans, the hash of the empty string.
    Repeated rows and null ids are scanned like others."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("id", base_spans(text).alias("base"),
                       F.concat(*[entropy_spans(text, c, allow, paths) for c in classes]).alias("more"))
    kinds = (*BASE, *(c.name for c in classes))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return rows.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base"), BASE).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "more"), kinds).alias("spans"))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def oracle() -> str:
    """The scan in SQL: positions from the lengths of matches and gaps, entropy
    counted anew in every window."""
    names = _either_case("(password|passwd|secret|token|api_?key)")
    base = (("assign", names + r"""["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    runs = [(c.name, c.pattern + "+", 0, c.window) for c in CLASSES]

    def found(kind: str, pattern: str, group: int, least: int) -> str:
        quoted = pattern.replace("'", "''")
        return (f"SELECT doc_id, '{kind}' AS kind, m[i] AS m, coalesce(list_sum(list_transform(g[1:i], "
                "lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) "
                f"AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, "
                f"regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS p, "
                f"string_split_regex(t, '{quoted}') AS g FROM d)) WHERE length(p[i]) >= {least}")

    allow = " OR ".join([*(f"regexp_matches(m, '{p}')" for p in ALLOW),
                         f"(regexp_matches(m, '{PATHS[0]}') AND NOT regexp_matches(m, '{PATHS[1]}'))"])
    limit = " ".join(f"WHEN '{c.name}' THEN {c.window * (math.log2(c.window) - c.threshold)!r}" for c in CLASSES)
    width = " ".join(f"WHEN '{c.name}' THEN {c.window}" for c in CLASSES)
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate([*BASE, *(c.name for c in CLASSES)]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({" UNION ALL ".join(found(*x) for x in base)}),
r AS (SELECT * FROM ({" UNION ALL ".join(found(*x) for x in runs)}) WHERE NOT ({allow})),
w AS (SELECT *, substr(m, j + 1, n) AS win FROM (SELECT *, unnest(range(length(m) - n + 1)) AS j
      FROM (SELECT *, CASE kind {width} END AS n FROM r))),
h AS (SELECT doc_id, kind, start, j, n FROM w WHERE list_sum(list_transform(list_distinct(
        string_split(win, '')), lambda c: (n - length(replace(win, c, ''))) * log2(n - length(replace(win, c, '')))))
      <= CASE kind {limit} END + 1e-9),
q AS (SELECT *, sum(CASE WHEN prev IS NULL OR j > prev + n THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, kind, start ORDER BY j) AS run
      FROM (SELECT *, lag(j) OVER (PARTITION BY doc_id, kind, start ORDER BY j) AS prev FROM h)),
e AS (SELECT doc_id, kind, start + min(j) AS a, start + max(j) + any_value(n) AS z FROM q
      GROUP BY doc_id, kind, start, run),
s AS (SELECT doc_id, kind, start AS a, start + length(m) AS z FROM b UNION ALL SELECT * FROM e),
o AS (SELECT *, CASE kind {order} END AS rank, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT) AS span
      FROM s),
x AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
        string_agg(span, ',' ORDER BY a, rank) AS spans FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id)
"""
