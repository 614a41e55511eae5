"""Alignment of two tokenizations of the same bytes.

Both token sequences partition the bytes of a text; the offsets where tokens of
both end cut them into groups, and each stretch between neighbouring token ends of
either kind is the overlap of exactly one pair of tokens: a link.

A text is taken in byte ranges.  A range yields a fragment: the tokens that end in
it, as an open prefix (up to the first common end), closed groups, and an open
suffix (behind the last common end).  Fragments compose associatively: the suffix
of the left and the prefix of the right close one group, or stay open where a side
has no common end.  The ranges of a long text are tokenized in different tasks and
composed by a tree, ``fan`` fragments at a time; a shorter text is one range.

Each range is tokenized inside a window that reaches to the next places where
neither tokenizer can join what is left and right of it: a space between letters
(checked against the second vocabulary).  A range's end is only where such places
are within half a range of it on both sides, so windows stay within two ranges; a
run without them is one range.

How often a pair of ids is linked is counted over all texts.  Pairs with more than
one in ``frequent`` of all links (at most ``frequent`` pairs) are broadcast, the
others are joined by their code.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing, packing
from quarry.session import materialize

RANGE = 1 << 16
IDS = 1 << 16           # ids of either vocabulary are below
HELD = 1 << 20          # different pairs that a task adds up before it sends them
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


# ---- tokenizers -------------------------------------------------------------

@lru_cache(2)
def _byte_table(path: str) -> tuple[list[bytes], np.ndarray]:
    import base64
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    table = [ranks.get(i, b"") for i in range(max(ranks) + 2)]
    return table, np.array([len(x) for x in table])


@lru_cache(2)
def _piece_model(path: str):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    inner = any(" " in x.decode("utf-8", "replace").lstrip(" ") for x in table)
    return sp, table, np.array([len(x) for x in table]), not inner


class Tokenizers:
    """The public byte-level BPE (a) and the public piece model (b)."""

    def __init__(self, ranks: str = "byte_bpe_50k.tiktoken", vocabulary: str = "byte_bpe_50k.json",
                 pieces: str = "piece_bpe_32k.model"):
        self.ranks, self.vocabulary, self.pieces = ranks, vocabulary, pieces

    def _load(self):
        import public_tokenizers as P
        return _byte_table(P.path(self.ranks)), _piece_model(P.path(self.pieces))

    def splits_at_spaces(self) -> bool:
        """No piece has a space behind another character."""
        return self._load()[1][3]

    def encode(self, window: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte lengths of both, of a window that begins with a space;
        None where the bytes of either differ from the window's."""
        (a_bytes, a_len), (sp, b_bytes, b_len, _) = self._load()
        text = window.decode("utf-8", "surrogatepass")
        a = packing.byte_bpe(text, self.ranks, special=False, vocabulary=self.vocabulary).astype(np.int64)
        b = np.array(sp.encode(text[1:]), np.int64)
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            if b"".join([table[i] for i in ids.tolist()]) != window:
                return None
        return a, a_len[a], b, b_len[b]


# ---- the monoid -------------------------------------------------------------

_NONE = np.zeros(0, np.int64)


@dataclass
class Fragment:
    """``pre``, ``suf``: ids and lengths of a, ids and lengths of b.  Without a
    common end (``sync`` false) all tokens are in ``suf``."""
    sync: bool
    pre: tuple = (_NONE,) * 4
    suf: tuple = (_NONE,) * 4
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: bytes = b""            # each group followed by a semicolon
    codes: np.ndarray = None       # linked pairs, distinct
    times: np.ndarray = None

    def __post_init__(self):
        if self.codes is None:
            self.codes = self.times = _NONE


@lru_cache(1)
def _decimals() -> list[bytes]:
    return [b"%d%c" % (i, c) for c in b",|;" for i in range(IDS)]


def closed(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> Fragment:
    """Groups and links of two token sequences over the same bytes."""
    if not len(a):
        return Fragment(True)
    ea, eb = np.cumsum(la), np.cumsum(lb)
    at_a, at_b = np.zeros(ea[-1] + 1, np.int32), np.zeros(ea[-1] + 1, np.int32)
    at_a[ea], at_b[eb] = 1, 1
    ends = np.flatnonzero(at_a | at_b)
    sync = (at_a & at_b)[ends] > 0
    ia, ib = np.cumsum(at_a)[ends - 1], np.cumsum(at_b)[ends - 1]  # tokens that end before
    codes, times = np.unique(b[ib] * IDS + a[ia], return_counts=True)
    ca, cb = ia[sync] + 1, ib[sync] + 1  # tokens up to the end of each group
    na, nb = len(a), len(b)
    ga, gb = np.repeat(np.arange(len(ca)), np.diff(ca, prepend=0)), np.repeat(np.arange(len(cb)), np.diff(cb, prepend=0))
    out = np.empty(na + nb, np.int64)
    last_a, last_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    last_a[ca - 1], last_b[cb - 1] = 1, 2
    out[np.arange(na) + np.concatenate([[0], cb])[ga]] = a + IDS * last_a
    out[np.arange(nb) + ca[gb]] = b + IDS * last_b
    table = _decimals()
    return Fragment(True, n_a=na, n_b=nb, n_groups=len(ca), groups=b"".join([table[i] for i in out.tolist()]),
                    codes=codes, times=times)


def fragment(tokens, at: int, start: int, end: int) -> Fragment:
    """Of the tokens of a window at byte ``at``: those that end in (start, end].
    A range from 0 begins at a common end."""
    a, la, b, lb = tokens
    ea, eb = at + np.cumsum(la), at + np.cumsum(lb)
    ka, kb = (ea > start) & (ea <= end), (eb > start) & (eb <= end)
    a, la, ea, b, lb, eb = a[ka], la[ka], ea[ka], b[kb], lb[kb], eb[kb]
    common = np.intersect1d(ea, eb, assume_unique=True)
    if start == 0:
        common = np.concatenate([[0], common])
    if not len(common):
        return Fragment(False, suf=(a, la, b, lb))
    i, j = np.searchsorted(ea, common[[0, -1]], side="right")
    k, m = np.searchsorted(eb, common[[0, -1]], side="right")
    out = closed(a[i:j], la[i:j], b[k:m], lb[k:m])
    out.pre = (a[:i], la[:i], b[:k], lb[:k])
    out.suf = (a[j:], la[j:], b[m:], lb[m:])
    return out


def compose(x: Fragment, y: Fragment) -> Fragment:
    if not x.sync and not y.sync:
        return Fragment(False, suf=_both(x.suf, y.suf))
    if not x.sync:
        return Fragment(True, _both(x.suf, y.pre), y.suf, y.n_a, y.n_b, y.n_groups, y.groups, y.codes, y.times)
    if not y.sync:
        return Fragment(True, x.pre, _both(x.suf, y.suf), x.n_a, x.n_b, x.n_groups, x.groups, x.codes, x.times)
    mid = closed(*_both(x.suf, y.pre))
    codes, times = hashing.tally(np.concatenate([x.codes, mid.codes, y.codes]),
                                 np.concatenate([x.times, mid.times, y.times]))
    return Fragment(True, x.pre, y.suf, x.n_a + mid.n_a + y.n_a, x.n_b + mid.n_b + y.n_b,
                    x.n_groups + mid.n_groups + y.n_groups, x.groups + mid.groups + y.groups, codes, times)


def _both(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate(z) for z in zip(x, y, strict=True))


# ---- Spark ------------------------------------------------------------------

DONE = ("row long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "links binary")
OPEN = "row long, id string, seq long, ok boolean, fragment binary"


def _pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted codes as differences, and how often each occurs."""
    import zstandard
    both = np.stack([np.diff(codes, prepend=0), times]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(2, 4, -1)
    both = np.ascontiguousarray(flat.transpose(0, 2, 1)).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _done(row: int, key, f: Fragment | None) -> tuple:
    if f is None or not f.n_groups:
        return row, key, 0, 0, 0, 0, "", _pack(_NONE, _NONE)
    return (row, key, f.n_a, f.n_b, f.n_groups, f.n_a + f.n_b - f.n_groups,
            hashlib.sha256(f.groups[:-1]).hexdigest(), _pack(f.codes, f.times))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def ranges(data: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(window start, start, end, window end) of the ranges of a long text."""
    d = np.frombuffer(data, np.uint8)
    letter = _LETTER[d]
    safe = np.flatnonzero(letter[:-2] & (d[1:-1] == 32) & letter[2:]) + 1
    cuts = [(0, 0, 0)]
    for at in range(size, len(data), size):
        k = np.searchsorted(safe, at)
        if 0 < k < len(safe) and at - safe[k - 1] <= size // 2 and safe[k] - at <= size // 2:
            cuts.append((int(safe[k - 1]), at, int(safe[k])))
    cuts.append((len(data),) * 3)
    for (low, start, _), (_, end, high) in zip(cuts, cuts[1:], strict=False):
        yield low, start, end, high


def _whole(rows: DataFrame, tok: Tokenizers) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                row += 1
                f = None
                if text:
                    data = b" " + text.encode("utf-8", "surrogatepass")
                    tokens = tok.encode(data)
                    f = tokens and fragment(tokens, 0, 0, len(data))
                out.append(_done(row, key, f))
            yield _frame(out, DONE)

    return rows.mapInPandas(run, DONE)


def _composed(rows: DataFrame, tok: Tokenizers, size: int, fan: int, longest: int) -> DataFrame:
    import pickle

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = (TaskContext.get().partitionId() << 40) + (1 << 62)
        names = ["row", "id", "seq", "low", "start", "end", "window"]
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                row += 1
                data = b" " + text.encode("utf-8", "surrogatepass")
                for seq, (low, start, end, high) in enumerate(ranges(data, size)):
                    yield pd.DataFrame([(row, key, seq, low, start, end, data[low:high])], columns=names)

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                tokens = tok.encode(r.window)
                f = tokens and fragment(tokens, r.low, r.start, r.end)
                out.append((r.row, r.id, r.seq, f is not None, pickle.dumps(f)))
            yield _frame(out, OPEN)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        ok, f = bool(group["ok"].all()), None
        if ok:
            for raw in group["fragment"]:
                g = pickle.loads(raw)
                f = g if f is None else compose(f, g)
        first = group.iloc[0]
        return _frame([(first["row"], first["id"], first["seq"] // fan, ok, pickle.dumps(f))], OPEN)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([_done(r.row, r.id, pickle.loads(r.fragment) if r.ok else None)
                          for r in pdf.itertuples()], DONE)

    parts = (rows.mapInPandas(cut, "row long, id string, seq long, low long, start long, end long, window binary")
             .repartition("row", "seq").mapInPandas(tokenize, OPEN))
    for _ in range(max(1, math.ceil(math.log(max(2, longest // size + 2), fan)))):
        parts = parts.groupBy("row", F.floor(F.col("seq") / fan).alias("next")).applyInPandas(join, OPEN)
    return parts.mapInPandas(finish, DONE)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: Tokenizers | None = None,
          size: int = RANGE, fan: int = 16, frequent: int = 1 << 20) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row
    per row of ``docs``.

    Null and empty texts, and texts whose bytes a tokenizer doesn't give back,
    have no tokens: zeros and an empty string.  Repeated rows and rows with a null
    id are aligned like others, and their links count; other columns are ignored;
    no rows give none."""
    tok = tokenizers or Tokenizers()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    octets = F.coalesce(F.octet_length("text"), F.lit(0))
    done = _whole(rows.where(octets <= size), tok)
    longest = rows.agg(F.max(octets).alias("n")).first()["n"] or 0
    if longest > size:
        long = rows.where(octets > size)
        done = done.unionByName(_composed(long, tok, size, fan, longest) if tok.splits_at_spaces()
                                else _whole(long, tok).withColumn("row", F.col("row") + (1 << 62)))
    done = materialize(done, "alignment")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (_NONE, _NONE)
        for pdf in batches:
            both = [_unpack(x) for x in pdf["links"]]
            held = hashing.tally(np.concatenate([held[0], *(c for c, _ in both)]),
                                 np.concatenate([held[1], *(n for _, n in both)]))
            if len(held[0]) > HELD:
                yield pd.DataFrame({"code": held[0], "n": held[1]})
                held = (_NONE, _NONE)
        yield pd.DataFrame({"code": held[0], "n": held[1]})

    counts = (done.select("links").mapInPandas(tally, "code long, n long")
              .groupBy("code").agg(F.sum("n").alias("n")))
    counts = materialize(counts, "alignment-pairs")
    b = F.floor(F.col("code") / IDS).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row an id of b: fewer than IDS
    counts = (counts.withColumn("b", b).join(F.broadcast(most), "b")
              .select("code", "n", (F.col("n") == F.col("most")).alias("best")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = counts.where(F.col("n") * frequent > total).toPandas().sort_values("code")
    known = spark.sparkContext.broadcast(
        (top["code"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def find(raw: bytes):
        codes, times = _unpack(raw)
        code, n, best = known.value
        at = np.minimum(np.searchsorted(code, codes), max(len(code) - 1, 0))
        hit = code[at] == codes if len(code) else np.zeros(len(codes), bool)
        return codes, times, hit, at[hit], n, best

    def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, raw in zip(pdf["row"], pdf["links"], strict=True):
                _, times, hit, at, n, best = find(raw)
                out.append((row, int((times[hit] * best[at]).sum()), int((times[hit] * n[at]).sum())))
            yield pd.DataFrame(out, columns=["row", "n_best", "count_sum"])

    def seldom(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, raw in zip(pdf["row"], pdf["links"], strict=True):
                codes, times, hit, *_ = find(raw)
                out.append((np.full(np.count_nonzero(~hit), row, np.int64), codes[~hit], times[~hit]))
            if out:
                yield pd.DataFrame(dict(zip(("row", "code", "times"), map(np.concatenate, zip(*out, strict=True)),
                                            strict=True)))

    rest = (done.select("row", "links").mapInPandas(seldom, "row long, code long, times long")
            .join(counts, "code").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    sums = done.select("row", "links").mapInPandas(often, "row long, n_best long, count_sum long")
    zero = F.lit(0)
    return (done.drop("links").join(sums, "row").join(rest, "row", "left")
            .select(F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links",
                    (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256"))
