"""Best-fit packing of tokenized documents into sequences, large items first.

Lengths are whole numbers up to the capacity, so the packing is decided on the
histogram of lengths (at most ``capacity`` counts, the only thing the driver
sees) and never on documents:

* pieces above a third of the capacity fit at most twice in a sequence; they are
  paired greedily, the longest with the longest partner that still fits;
* shorter pieces, longest first, go to the smallest gap that takes them, as many
  of one length as fit; new sequences are opened where no gap is left.

The plan is a bounded table of runs: pieces of a length with ranks r0 to r1 go
``per_bin`` at a time into consecutive sequences.  A piece's rank among those of
its length is its place in its partition plus the counts of the partitions
before it, so no length is ever gathered or sorted in one task.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

CAPACITY = 1024
END = 2  # id that ends every document
RUN = "length int, r0 long, r1 long, per_bin long, bin0 long, offset0 long"


@lru_cache(4)
def _encoder(ranks_path: str, end_of_text: int):
    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": end_of_text})


@lru_cache(4)
def _slow_encoder(path: str, special: bool):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


def byte_bpe(text: str, ranks: str = "byte_bpe_50k.tiktoken", end_of_text: int = 50256,
             special: bool = True, vocabulary: str = "byte_bpe_50k.json") -> np.ndarray:
    """Ids of the public byte-level BPE; strings of special tokens in the text are
    these tokens (``special``) or plain text.  The rank file holds the vocabulary
    of the JSON file and gives the same ids (tested) several times faster; its
    pattern engine gives up on very long runs of white space, which then go
    through the JSON file."""
    import public_tokenizers
    encoder = _encoder(public_tokenizers.path(ranks), end_of_text)
    try:
        return (encoder.encode_to_numpy(text, allowed_special="all") if special
                else encoder.encode_to_numpy(text, disallowed_special=()))
    except ValueError:  # its stack of backtracking is full
        slow = _slow_encoder(public_tokenizers.path(vocabulary), special)
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, encode: Callable[[str], np.ndarray] = byte_bpe,
           id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, place) of every row's
    tokens and END.  Longer ones are cut so that the first piece is the
    shorter one.  ``place`` numbers the pieces of a length in a partition."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            rows = []
            for i, text in enumerate(pdf["text"]):
                ids = np.append(encode(text or ""), END).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                start = 0
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    n = end - start
                    rows.append((i, k, start, n, zlib.crc32(ids[start:end].tobytes()), seen[n]))
                    seen[n] += 1
                    start = end
            at, k, start, n, crc, place = zip(*rows, strict=True) if rows else [()] * 6
            yield pd.DataFrame({
                "id": pdf["id"].iloc[list(at)].to_numpy(), "piece": k, "start": start, "length": n,
                "ids_crc32": crc, "part": part, "place": place})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # ids travel as strings: nulls in a numeric pandas column would turn it to floats
    out = rows.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(
        cut, "id string, piece int, start long, length int, ids_crc32 long, part int, place long")
    return out.withColumn("id", F.col("id").cast(kind))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Runs (RUN) that place ``counts`` pieces of every length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    runs: list[tuple[int, ...]] = []
    rank = np.zeros(capacity + 1, np.int64)
    gaps: dict[int, list[list[int]]] = {}  # gap -> [first sequence, sequences] with that gap
    order: list[int] = []                  # gaps in use, ascending
    opened = 0

    def place(length: int, bins: int, per_bin: int, bin0: int, offset: int) -> None:
        n = bins * per_bin
        runs.append((length, int(rank[length]), int(rank[length] + n), per_bin, bin0, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, bin0: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append([bin0, bins])

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b > third and not (left[b] > (b == a)):
                b -= 1
            if b <= third:
                bins = int(left[a])
                place(a, bins, 1, opened, 0)
                leave(capacity - a, opened, bins)
            elif b == a:
                bins = int(left[a]) // 2
                place(a, bins, 2, opened, 0)
                leave(capacity - 2 * a, opened, bins)
            else:
                bins = int(min(left[a], left[b]))
                place(a, bins, 1, opened, 0)
                place(b, bins, 1, opened, a)
                leave(capacity - a - b, opened, bins)
            opened += bins
    for s in range(third, 0, -1):
        while left[s]:
            at = bisect.bisect_left(order, s)
            gap = order[at] if at < len(order) else capacity
            fit = gap // s
            if gap < capacity:
                bin0, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                bin0, bins = opened, -(-int(left[s]) // fit)
                opened += bins
            filled = min(bins, int(left[s]) // fit)
            if filled:
                place(s, filled, fit, bin0, capacity - gap)
                leave(gap - fit * s, bin0, filled)
            over = int(left[s]) if filled < bins else 0  # fewer than fit: into one sequence
            if over:
                place(s, 1, over, bin0 + filled, capacity - gap)
                leave(gap - over * s, bin0 + filled, 1)
                filled += 1
            leave(gap, bin0 + filled, bins - filled)
    return runs


def pack(docs: DataFrame, encode: Callable[[str], np.ndarray] = byte_bpe, id_col: str = "doc_id",
         text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per
    piece of every row of ``docs``.  A null text is empty (END alone); repeated
    rows and rows with null ids are packed like others; no rows give none."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, encode, id_col, text_col, capacity), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in
              per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    first = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a length: at most capacity rows of a few runs each, whatever the input
    runs = (spark.createDataFrame(plan(counts, capacity), RUN)
            .groupBy("length").agg(F.collect_list(F.struct("r0", "r1", "per_bin", "bin0", "offset0"))
                                   .alias("runs")))
    ranked = (cut.join(first, ["part", "length"]).join(F.broadcast(runs), "length")
              .withColumn("rank", F.col("base") + F.col("place")))
    run = F.filter("runs", lambda x: (x["r0"] <= F.col("rank")) & (F.col("rank") < x["r1"]))[0]
    placed = ranked.withColumn("run", run).withColumn("at", F.col("rank") - F.col("run.r0"))
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"),
        "ids_crc32", (F.col("run.bin0") + F.floor(F.col("at") / F.col("run.per_bin"))).alias("sequence_id"),
        (F.col("run.offset0") + F.col("at") % F.col("run.per_bin") * F.col("length")).alias("offset"))
