"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
binary (23,12) Golay code decodes every 23-bit word to one codeword at distance
three or less.  A segment's fuzzy keys are the codewords that the segment and
all its one-bit changes decode to (one to six, mostly six): two segments at
distance two or less have a common one-bit neighbour, so they share a key.

Pigeonhole: two fingerprints at most two bits apart have a segment without an
error, and every other segment has at most two errors.  So each fingerprint
is filed under (segment i as it is, fuzzy keys of segment i+1) for the three i,
and every pair at distance two or less meets in a bucket of 30 or more
bits.  Candidates are verified by the bit count of their difference.

Scale: documents are reduced to distinct fingerprints first (copies never meet
in a bucket).  A bucket emits a forest of verified links, not its pairs.
Buckets above ``max_bucket`` fingerprints are not gathered in one task: their
members are linked through common one-bit neighbours (65 rows each, a grouped
minimum), which is exact, linear and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.llm.components import components
from quarry.session import materialize

GOLAY_POLY = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, generator of the code
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (first bit, bits)
MAX_BITS = 2  # what the keys guarantee
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles (with repeats)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        block = h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3,
                      out_col: str = "fp") -> DataFrame:
    """``docs`` plus the fingerprint as a signed long (same 64 bits)."""

    @F.pandas_udf(LongType())
    def fp(texts: pd.Series) -> pd.Series:
        bits = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(bits.view(np.int64))

    return docs.withColumn(out_col, fp(F.col(text_col)))


@lru_cache(1)
def _tables():
    """Syndromes of the three bytes of a word, and the error pattern of each
    of the 2048 syndromes (the code is perfect: weights 0 to 3 fill them)."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY_POLY << (i - 11)
        return x
    bits = np.array([syndrome(1 << i) for i in range(23)], np.int64)
    byte = np.zeros((3, 256), np.int64)
    for b in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * b + i < 23:
                    byte[b, v] ^= bits[8 * b + i]
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[bits[i]] = 1 << i
        for j in range(i):
            error[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                error[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return bits, byte, error


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    _, byte, error = _tables()
    s = byte[0][x & 255] ^ byte[1][x >> 8 & 255] ^ byte[2][x >> 16 & 127]
    return (x ^ error[s]) >> 11


def fuzzy_keys(x: np.ndarray, bits: int = 23) -> np.ndarray:
    """(n, bits + 1) codeword indices of each word and its one-bit changes;
    -1 where the row already has the index."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    keys = np.sort(decode(x[:, None] ^ flips[None, :]), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (bucket, fingerprint) rows of unsigned fingerprints."""
    segs = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)
            for at, n in SEGMENTS]
    keys, owners = [], []
    for i in range(3):
        j = (i + 1) % 3
        fuzzy = fuzzy_keys(segs[j], SEGMENTS[j][1])
        row, col = np.nonzero(fuzzy >= 0)
        keys.append(i << 40 | segs[i][row] << 12 | fuzzy[row, col])
        owners.append(fps[row])
    return np.concatenate(keys), np.concatenate(owners)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links joining every node of the link list to its least reachable node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _bucket_links(batches: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Verified links inside buckets of rows that arrive sorted by bucket."""
    def links(k, f):
        found_a, found_b = [], []
        at = np.arange(len(k))
        d = 1
        while True:  # rows whose bucket reaches d rows further
            at = at[:np.searchsorted(at, len(k) - d)]
            at = at[k[at] == k[at + d]]
            if not len(at):
                break
            near = at[np.bitwise_count(f[at] ^ f[at + d]) <= max_bits]
            found_a.append(f[near])
            found_b.append(f[near + d])
            d += 1
        if not found_a or not sum(map(len, found_a)):
            return None
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    k0, f0 = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for pdf in batches:
        k = np.concatenate([k0, pdf["k"].to_numpy()])
        f = np.concatenate([f0, pdf["fp"].to_numpy().view(np.uint64)])
        cut = np.searchsorted(k, k[-1]) if len(k) else 0
        if (out := links(k[:cut], f[:cut])) is not None:
            yield out
        k0, f0 = k[cut:], f[cut:]
    if (out := links(k0, f0)) is not None:
        yield out


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct
    fingerprints (column ``fp``) at ``max_bits`` (at most 2) or fewer bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the Golay keys cover distances of 0 to 2 bits")

    def keys(batches):
        for pdf in batches:
            k, f = bucket_keys(pdf["fp"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"k": k, "fp": f.view(np.int64)})

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = fps.select("fp").mapInPandas(keys, "k long, fp long")
    hot = materialize(filed.groupBy("k").count().where(F.col("count") > max_bucket).select("k"),
                      "hot-buckets")
    if any_hot := not hot.isEmpty():
        filed = filed.join(hot, "k", "left_anti")
    found = (filed.repartition(parts, "k").sortWithinPartitions("k")
             .mapInPandas(lambda it: _bucket_links(it, max_bits), "a long, b long"))
    if any_hot:
        members = (fps.select("fp").mapInPandas(keys, "k long, fp long")
                   .join(hot, "k", "left_semi").select("fp").distinct())
        found = found.union(_neighbour_links(members, max_bits))
    return found


def _neighbour_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links of the members of very large buckets: fingerprints within
    two bits have a common one-bit neighbour, and sharing one means that.
    For one bit, members meet at a member's own value only."""
    around = F.concat(F.array(F.col("fp")), F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = fps.select("fp", F.explode(around).alias("z"))
    if max_bits < 2:
        near = near.join(fps.select(F.col("fp").alias("z")), "z", "left_semi")
    if max_bits == 0:
        near = near.where("fp = z")
    centre = near.groupBy("z").agg(F.min("fp").alias("m"))
    return near.join(centre, "z").where("fp <> m").select(
        F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def _members(fps: DataFrame, max_bits: int, max_bucket: int) -> DataFrame:
    """Distinct fingerprints with the least one of their component (``root``)."""
    roots = components(links(fps, max_bits, max_bucket))
    return (fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = MAX_BITS,
                    max_bucket: int = 2048) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row.

    ``fingerprint`` is 16 hex digits, ``component_id`` the least id reachable
    over links of ``max_bits`` or fewer bits.  Null, empty and blank texts have
    fingerprint zero and link like any other.  Rows with a null id get the
    component of their fingerprint (null if it has no id at all); repeated rows
    are kept.  Other columns are ignored, whatever their names."""
    rows = materialize(
        with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                          "text", shingle).select("id", "fp"), "fingerprints")
    member = _members(rows.groupBy("fp").agg(F.min("id").alias("least")), max_bits, max_bucket)
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = member.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group (the
    one with the least id).  Rows with a null id are kept: they can't be told
    apart.  Of rows that repeat an id, all or none stay.  ``one_per_group`` tells
    these apart too and keeps one row."""
    found = near_duplicates(docs, id_col, **options)
    out = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(out, id_col, "left_anti")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = 3, max_bits: int = MAX_BITS, max_bucket: int = 2048) -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate group: the least id
    (null ids last), of its texts the one of least hash, and of rows that repeat
    both the one whose hash of all columns is least.  A row is known by its id
    and two hashes of its text, so another text under the same id is judged by
    itself, and repeated rows and rows with a null id go like any other copy."""
    text = F.col(text_col)
    keyed = docs.withColumns({"__id": F.col(id_col), "__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)})
    rows = materialize(
        with_fingerprints(keyed.select("__id", "__t1", "__t2", text.alias("text")), "text", shingle)
        .select("__id", "__t1", "__t2", "fp"), "fingerprints")
    texts = rows.groupBy("__id", "__t1", "__t2", "fp").agg(F.count("*").alias("n"))
    fps = materialize(texts.groupBy("fp").agg(F.min(F.struct(
        F.col("__id").isNull().alias("last"), "__id", "__t1", "__t2", "n")).alias("least")), "texts")
    survivors = materialize(_members(fps, max_bits, max_bucket).groupBy("root")
                            .agg(F.min("least").alias("s")).select("s.*").drop("last"), "survivors")

    def found(part: DataFrame) -> DataFrame:
        s = part.select(*(F.col(c).alias(c.replace("__", "__s_")) for c in ("__id", "__t1", "__t2")))
        return keyed.join(s, F.col("__id").eqNullSafe(F.col("__s_id")) & (F.col("__t1") == F.col("__s_t1"))
                          & (F.col("__t2") == F.col("__s_t2")), "left_semi")

    out = found(survivors.where("n = 1")).select(*docs.columns)
    repeated = survivors.where("n > 1")
    if not repeated.isEmpty():
        one = (found(repeated).groupBy("__id", "__t1", "__t2")
               .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")))
        out = out.unionByName(one.select("row.*"))
    return out
