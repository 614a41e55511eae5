"""Tokenizer and feature hashing as column expressions.

Tokens: lower-case, split on runs of characters that are neither letters
nor digits, empties dropped. A token's feature is taken from md5(token):
bucket = first 6 hex digits mod ``dim``; sign = +1 when the 7th hex digit
is even, else -1. md5 keeps the encoder reproducible outside Spark (the
SQL oracle computes the same buckets).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = "[^\\p{L}\\p{N}]+"


def tokens(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda x: x != "")


def _hex(h: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(h, start, length), 16, 10).cast("long")


def hash_of(token: Column) -> Column:
    """24 bits of which every dimension's bucket is the remainder."""
    return _hex(F.md5(token), 1, 6).cast("int")


def bucket_of(token: Column, dim: int) -> Column:
    return (_hex(F.md5(token), 1, 6) % dim).cast("int")


def sign_of(token: Column) -> Column:
    return F.when(_hex(F.md5(token), 7, 1) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def unit_hash(key: Column, seed) -> Column:
    """Deterministic number in [0, 1) from md5(seed-key); independent of
    partitioning, unlike ``DataFrame.sample``."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), key.cast("string")))
    return _hex(h, 1, 8) / F.lit(4294967296.0)
