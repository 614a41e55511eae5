"""Data preparation: join, filters, sampling, splits, dedupe, ground truth
(J1, F1-F6, P1-P2, D1-D4, G1-G3, C1).

Everything is one lazy plan. Per-key "first" values are hash aggregates
with ``min_by`` (partial aggregation before the shuffle), so a key that
holds a third of all rows costs one partial row per map task, not one
giant window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.tokens import unit_hash
from quarry.sources.schemas import TEXT_FIELDS

RELEVANT_LABELS = ("E", "S")
ALL_LABELS = ("E", "S", "C", "I")
SAMPLE_SEED = 42
# judgment columns plus the title (failure examples show it); the long
# catalogue texts stay out of materialized judgment tables
JUDGMENT_COLUMNS = ("example_id", "query_id", "query", "product_id", "product_locale",
                    "esci_label", "small_version", "large_version", "split", "product_title")


def join_catalog(judgments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left equi-join on (product_locale, product_id). With ``=`` keys
    Catalyst infers the locale predicate for the catalogue scan too."""
    return judgments.join(catalog, ["product_locale", "product_id"], "left")


def filter_version_locale(merged: DataFrame, version: str = "small",
                          locale: str = "us") -> DataFrame:
    """``<version>_version == 1`` and ``product_locale == locale``."""
    col = f"{version}_version"
    if col not in merged.columns:
        raise ValueError(f"unknown dataset version {version!r}: no column {col}")
    return merged.where((F.col(col) == 1) & (F.col("product_locale") == locale))


def sample_fraction(df: DataFrame, frac: float | None, key: str = "example_id",
                    seed: int = SAMPLE_SEED) -> DataFrame:
    """Deterministic hash-threshold sample of rows; None = all rows."""
    if frac is None:
        return df
    if not (0.0 < frac <= 1.0):
        raise ValueError("sample fraction must be in (0, 1]")
    return df.where(unit_hash(F.col(key), seed) < F.lit(float(frac)))


def sample_exact(df: DataFrame, frac: float, key: str = "example_id",
                 seed: int = SAMPLE_SEED) -> DataFrame:
    """P1 with an exact size: ``round(frac * n)`` of the n rows, the least by
    md5(seed-key), then by a digest of the row; the same rows for any partitioning.

    No sort: rows are counted by the next four hexadecimal digits of their hash (at
    most 65,536 counts), the bin in which the sample ends is found, and only that bin
    is counted again by further digits, until the end falls between two bins.  Then
    one comparison with a constant makes the sample.  Each round scans ``df``; four
    digits suffice per factor of 65,536 in rows.  A null key hashes as an empty one.
    Rows that are equal in every column are interchangeable: where the sample ends
    among them, any of them fill it."""
    if not (0.0 < frac <= 1.0):
        raise ValueError("sample fraction must be in (0, 1]")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    of_key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))

    def digits(upto: int):  # the row's digest is computed only where the key's ends
        first = F.substring(of_key, 1, min(upto, 32))
        return first if upto <= 32 else F.concat(first, F.substring(F.md5(row), 1, upto - 32))

    cut, left = "", round(frac * df.count())
    while len(cut) < 64:
        at = len(cut)
        inside = df if not cut else df.where(digits(at) == cut)
        bins = inside.groupBy(digits(at + 4).alias("bin")).count().collect()  # at most 65,536
        for bin_, n in sorted((b["bin"], b["count"]) for b in bins):
            if n > left:
                cut = bin_
                break
            left -= n
        else:
            return df  # all rows
        if left == 0:  # the sample ends before this bin
            return df.where(digits(len(cut)) < cut)
    return df.where(digits(64) < cut).unionByName(df.where(digits(64) == cut).limit(left))


def prepare_dataset(judgments: DataFrame, catalog: DataFrame, version: str = "small",
                    locale: str = "us", sample_frac: float | None = None) -> DataFrame:
    """J1 -> F1 -> F2 -> P1."""
    merged = join_catalog(judgments, catalog)
    return sample_fraction(filter_version_locale(merged, version, locale), sample_frac)


def prepare_judgments(judgments: DataFrame, version: str = "small", locale: str = "us",
                      sample_frac: float | None = None) -> DataFrame:
    """F1, F2 and P1 on the judgments alone: the left join J1 keeps each of their
    rows, so ``join_catalog`` of the result is ``prepare_dataset``."""
    return sample_fraction(filter_version_locale(judgments, version, locale), sample_frac)


def split(merged: DataFrame, name: str) -> DataFrame:
    """one split; values other than train/test belong to neither."""
    return merged.where(F.col("split") == name)


def test_set(merged_unfiltered: DataFrame, version: str = "small", locale: str = "us") -> DataFrame:
    """split = test AND <version>_version = 1 AND locale."""
    return merged_unfiltered.where((F.col("split") == "test") & (F.col(f"{version}_version") == 1)
                                   & (F.col("product_locale") == locale))


def unique_products(merged: DataFrame) -> DataFrame:
    """D1 + F5: one row per product, from its first judgment (lowest
    example_id), id plus the five text columns."""
    fields = F.struct(*[F.col(c) for c in TEXT_FIELDS])
    # a catalogue that repeats a key repeats example_id: the texts break the tie
    first = F.min_by(fields, F.struct("example_id", F.xxhash64(fields)))
    return (merged.select("product_id", "example_id", *TEXT_FIELDS)
            .groupBy("product_id").agg(first.alias("f"))
            .select("product_id", *[F.col(f"f.{c}").alias(c) for c in TEXT_FIELDS]))


def judged_products(judgments: DataFrame, catalog: DataFrame) -> DataFrame:
    """``unique_products`` of the joined tables, where the long texts are joined once
    per product instead of once per judgment: of each catalogue key only the
    lowest example_id (null before all others, as in a struct) can be a product's first.

    The join's key is the product alone, the locale a condition on its pairs: its
    rows lie as the grouping by product needs them, and the texts move once."""
    keys = (judgments.groupBy("product_locale", "product_id")
            .agg(F.min(F.struct("example_id")).alias("first"))
            .select("product_locale", "product_id", "first.example_id"))
    return unique_products(_with_catalog(keys, catalog))


def _with_catalog(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """J1 for catalogue keys, lying by product."""
    cat = catalog.select("product_id", F.col("product_locale").alias("listed"), *TEXT_FIELDS)
    same = F.array_contains(F.array("listed"), F.col("product_locale"))  # an equality would become a key
    cat = cat.withColumnRenamed("product_id", "listed_id")
    return keys.join(cat, (F.col("product_id") == F.col("listed_id")) & same, "left")


def judged_states(judgments: DataFrame, catalog: DataFrame, states: dict[str, Column]) -> DataFrame:
    """``judged_products`` of several selections of the judgments at once, whose texts are
    joined and moved once: product_id and, for each name of ``states``, in_<name> and a
    struct of the product's texts, null where they are those of the last state.
    ``state_products`` gives a state's rows."""
    names = list(states)
    keys = judgments.groupBy("product_locale", "product_id").agg(
        *[F.min(F.when(chosen, F.struct("example_id"))).alias(n) for n, chosen in states.items()])
    fields = F.struct(*[F.col(c) for c in TEXT_FIELDS])
    first = (_with_catalog(keys, catalog).groupBy("product_id").agg(
        *[F.min_by(fields, F.when(F.col(n).isNotNull(), F.struct(f"{n}.example_id", F.xxhash64(fields)))).alias(n)
          for n in names]))
    own = [F.col(n) if n == names[-1] else F.when(~F.col(n).eqNullSafe(F.col(names[-1])), F.col(n)).alias(n) for n in names]
    return first.select("product_id", *[F.col(n).isNotNull().alias(f"in_{n}") for n in names], *own)


def state_products(held: DataFrame, name: str, last: str) -> DataFrame:
    """One state of ``judged_states``: product_id and its texts."""
    fields = F.coalesce(F.col(name), F.col(last))
    return held.where(f"in_{name}").select("product_id", *[fields[c].alias(c) for c in TEXT_FIELDS])


def test_queries(test: DataFrame) -> DataFrame:
    """G1: first non-null query text per query id (null ids dropped)."""
    return (test.where(F.col("query_id").isNotNull() & F.col("query").isNotNull())
            .groupBy("query_id").agg(F.min_by("query", "example_id").alias("query")))


def first_per_query(df: DataFrame, key: str = "query_id", order: str = "example_id") -> DataFrame:
    """First non-null value of every other column per key."""
    cols = [c for c in df.columns if c not in (key,)]
    # ties of ``order`` (repeated catalogue keys) are broken by the whole row
    row = F.xxhash64(*[F.col(c) for c in cols])
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), row))).alias(c)
            for c in cols]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def ground_truth(test: DataFrame) -> DataFrame:
    """G3 long form: (query_id, label, product_id, example_id); the list
    order of the reference's per-label lists is the example_id order.
    Labels E/S/C/I only. A projection, no grouping: a query with millions
    of judgments is never gathered into one list."""
    return (test.where(F.col("esci_label").isin(*ALL_LABELS))
            .select("query_id", F.col("esci_label").alias("label"), "product_id", "example_id"))


def relevant_set(test: DataFrame) -> DataFrame:
    """F6 + D3/D4: distinct (query_id, product_id) labelled E or S."""
    return (test.where(F.col("esci_label").isin(*RELEVANT_LABELS))
            .select("query_id", "product_id").distinct())


def sample_queries(df: DataFrame, n: int, key: str = "query_id",
                   seed: int = SAMPLE_SEED) -> DataFrame:
    """Fixed-size deterministic sample of rows (min(n, rows)); plans
    as TakeOrderedAndProject, i.e. a bounded top-n, never a full sort."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(key).cast("string")))
    return df.orderBy(h, F.col(key)).limit(n)
