"""Declared schemas of the two inputs and of the intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Judgments ("examples"): one row per (query, product) judgment.
JUDGMENTS = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_locale", T.StringType()),
    T.StructField("esci_label", T.StringType()),
    T.StructField("small_version", T.IntegerType()),
    T.StructField("large_version", T.IntegerType()),
    T.StructField("split", T.StringType()),
])

# Catalogue ("products"): one row per (locale, product).
CATALOG = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_locale", T.StringType()),
    T.StructField("product_title", T.StringType()),
    T.StructField("product_brand", T.StringType()),
    T.StructField("product_color", T.StringType()),
    T.StructField("product_bullet_point", T.StringType()),
    T.StructField("product_description", T.StringType()),
])

JUDGMENTS_REQUIRED = ("query_id", "query", "product_id", "product_locale", "esci_label", "split")
CATALOG_REQUIRED = ("product_id", "product_locale")
TEXT_FIELDS = ("product_title", "product_description", "product_bullet_point",
               "product_brand", "product_color")

PREDICTIONS = "query_id bigint, rank int, product_id string, score double"


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required, what: str) -> DataFrame:
    """Fail at analysis time, before any job runs, if a column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what}: missing required columns {missing}")
    return df
