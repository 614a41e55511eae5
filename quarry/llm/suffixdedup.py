"""Exact removal of long repeated passages with sorted, front-coded suffix runs.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is
removed.  Sorting the suffixes at all bytes would exchange some hundred times the
input, so the suffix array is sparse, without losing a repeat:

1. Anchors.  In every string of ``length`` bytes the least hash of its
   ``gram``-byte substrings marks an anchor.  Equal strings have their anchors at
   the same offset, so repeats are found among anchors with an equal gram.  An
   anchor's context is all that such strings can reach: length - gram bytes
   before it, length bytes from it on, cut at the ends of the text.
2. Classes.  Anchors with an equal gram meet, sorted by the hash of their context.
   A context that occurs twice is a repeat as a whole.  A gram with one context
   is done; only where contexts differ (the ends of copied passages) is one
   suffix per context needed.  Grams that would fill half a partition are salted;
   one row per context and salt is then joined up again.
3. Suffix sort.  Tasks sort these suffixes into runs, front-code them (shared
   prefix length, rest) and exchange them by gram.  Each receiver merges its runs
   with a loser tree that carries the common prefix with the last output: it
   compares the lengths of known prefixes and looks at bytes only beyond equal
   ones.  In the sorted order, suffixes that share v bytes are neighbours; within
   them the sorted left contexts give the longest left match.  A pair whose left
   and right matches add up to ``length`` covers the whole stretch.

Grams with more than ``max_group`` different contexts are not gathered: the
hashes of all strings around their anchors are counted instead, which is exact
and spread over the cluster.  Texts are bytes; matches never cross documents.
Rows with equal texts are known by two hashes of the text; suffixes are cut out
of one of them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class Hasher:
    """Hashes of the substrings of a buffer by prefix sums."""

    _up = _down = np.ones(1, np.uint64)
    _byte = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hasher._up) <= n:
            size = max(n, 2 * CHUNK)
            Hasher._up, Hasher._down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._byte[data] * self._up[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self._down[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every window of ``w``: two running minima per block."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(texts: list[bytes], length: int, gram: int):
    """(text, pos, gram hash, context hash, left, right) arrays."""
    out = []
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal batch, size
        if batch:
            out.append(_anchors(batch, texts, length, gram))
        batch, size = [], 0

    for i, t in enumerate(texts):
        step = CHUNK - length  # pieces overlap by a string
        for at in range(0, max(1, len(t) - length + 1), step):
            piece = t[at:at + step + length - 1]
            if len(piece) >= length:
                batch.append((i, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    flush()
    flush()
    if not out:
        return [np.zeros(0, d) for d in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)]
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    _, first = np.unique(cols[0] << 40 | cols[1], return_index=True)  # overlaps find some twice
    return [c[first] for c in cols]


def _anchors(batch, texts, length: int, gram: int):
    sizes = np.array([len(p) for _, _, p in batch])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    at = np.arange(len(data) - gram + 1)
    h = Hasher(data).of(at, at + gram)
    w = length - gram + 1
    low = sliding_min((h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), w)
    # only windows inside one piece
    piece = np.repeat(np.arange(len(batch)), sizes)
    inside = piece[:len(low)] == piece[length - 1:length - 1 + len(low)]
    pos = np.unique(low[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)
    piece = piece[pos]
    owner = np.array([b[0] for b in batch])[piece]
    offset = np.array([b[1] for b in batch])[piece]
    local = pos - begin[piece] + offset
    total = np.array([len(texts[b[0]]) for b in batch])[piece]
    left, right = np.minimum(local, length - gram), np.minimum(total - local, length)
    # the context may reach past the piece: hash it from the whole text then
    whole = (pos - left >= begin[piece]) & (pos + right <= begin[piece + 1])
    ctx = np.zeros(len(pos), np.uint64)
    hasher = Hasher(data)
    ctx[whole] = hasher.of((pos - left)[whole], (pos + right)[whole])
    for j in np.flatnonzero(~whole):
        part = np.frombuffer(texts[owner[j]][local[j] - left[j]:local[j] + right[j]], np.uint8)
        ctx[j] = Hasher(part).of(np.array([0]), np.array([len(part)]))[0]
    ctx = ctx * np.uint64(31) ^ (left.astype(np.uint64) << np.uint64(8) | right.astype(np.uint64))
    return owner, local, h[pos], ctx, left, right


def _classes(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (gram, salt, ctx): those that repeat as a whole (kind 0),
    and one suffix (kind 1) for each context of a gram that has several, or of a
    salted gram (salt above 0); ``lone`` says that the context occurs once.  One
    row at most waits for the next batch, so a frequent gram streams through."""
    cols = ["gram", "salt", "ctx", "t1", "t2", "pos", "left", "right"]
    tail = None      # the last row of the batch before
    tail_same = False  # its context was there already
    tail_first = True  # its context is the first of its gram
    for pdf in batches:
        if not len(pdf):
            continue
        if tail is not None:
            pdf = pd.concat([tail, pdf], ignore_index=True)
        g, salt, c = (pdf[x].to_numpy() for x in ("gram", "salt", "ctx"))
        same_g = np.concatenate([[False], (g[1:] == g[:-1]) & (salt[1:] == salt[:-1])])
        same = same_g & np.concatenate([[False], c[1:] == c[:-1]])
        before = same.copy()
        first_ctx = ~same_g
        if tail is not None:
            before[0], first_ctx[0] = tail_same, tail_first
        # first context of its gram: carried along equal contexts
        start_of_class = ~same
        class_no = np.cumsum(start_of_class) - 1
        first_of_class = first_ctx[np.flatnonzero(start_of_class)][class_no]
        n = len(pdf) - 1  # the last row waits
        after = np.concatenate([same[1:], [False]])
        other_next = np.concatenate([same_g[1:] & ~same[1:], [False]])
        twice = (before | after)[:n]
        # a class needs a suffix if its gram has another class
        last_of_class = ~after
        several = ~first_of_class | (other_next & last_of_class) | (salt > 0)
        pick = (last_of_class & several)[:n]
        yield _rows(pdf.iloc[:n], twice, pick, length, cols)
        tail, tail_same, tail_first = pdf.iloc[n:], bool(before[n]), bool(first_of_class[n])
    if tail is not None:
        pick = (not tail_first) | (tail["salt"].to_numpy() > 0)
        yield _rows(tail, np.array([tail_same]), pick, length, cols)


def _rows(pdf: pd.DataFrame, twice: np.ndarray, pick: np.ndarray, length: int, cols) -> pd.DataFrame:
    whole = twice & ((pdf["left"] + pdf["right"]).to_numpy() >= length)
    a = pdf.loc[whole, cols].assign(kind=0, lone=False)
    b = pdf.loc[pick, cols].assign(kind=1, lone=~twice[pick])
    return pd.concat([a, b])[["kind", "lone", *cols]]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    while known < n:
        step = min(16, n - known)
        if a[known:known + step] != b[known:known + step]:
            while a[known] == b[known]:
                known += 1
            return known
        known += step
    return n


def front_code(suffixes: list[bytes]) -> list[tuple[int, bytes]]:
    """(shared bytes, rest) of sorted suffixes."""
    out, last = [], b""
    for s in suffixes:
        shared = common_prefix(last, s, 0)
        out.append((shared, s[shared:]))
        last = s
    return out


def merge_runs(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, index, prefix shared with the row before, suffix) in sorted order.

    A loser tree whose nodes hold the run that lost there.  ``known[r]`` is the
    common prefix of run r's head with the last head that beat it, which on the
    winner's path is the row put out last: the longer one is smaller, and bytes
    are read only beyond equal ones.
    """
    k = len(runs)
    heads: list[bytes | None] = [b""] * k
    index = [-1] * k
    known = [0] * k

    def advance(r: int) -> None:
        index[r] += 1
        if index[r] < len(runs[r]):
            shared, rest = runs[r][index[r]]
            heads[r], known[r] = (heads[r] or b"")[:shared] + rest, shared
        else:
            heads[r], known[r] = None, -1

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's prefix is brought up to date."""
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        n = common_prefix(x, y, known[a])
        a_first = len(x) == n or (len(y) > n and x[n] < y[n])
        known[b if a_first else a] = n
        return a_first

    for r in range(k):
        advance(r)
        known[r] = 0 if heads[r] is not None else -1
    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1) if k > 1 else 0
    while k and heads[winner] is not None:
        yield winner, index[winner], known[winner], heads[winner]
        advance(winner)
        node = (winner + k) >> 1
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node >>= 1


def cover(lcp: np.ndarray, lefts: list[bytes], length: int, gram: int):
    """(left, right) of the stretch around each anchor that repeats (-1: none),
    from suffixes in sorted order: ``lcp[i]`` with the one before, ``lefts`` the
    left contexts read backwards."""
    n = len(lefts)
    max_l, max_r = np.full(n, -1), np.full(n, -1)
    width = length - gram
    sizes = np.array([len(x) for x in lefts], np.int64)
    grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in lefts), np.uint8).reshape(n, width)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lefts.__getitem__)] = np.arange(n)
    lcp = np.minimum(lcp, length).copy()
    lcp[:1] = 0
    levels = np.unique(lcp[lcp >= gram])[::-1]
    for v in levels:
        sub = np.cumsum(lcp < v)
        touched = np.zeros(sub[-1] + 1, bool)
        touched[sub[lcp == v]] = True
        at = np.flatnonzero(touched[sub])
        at = at[np.lexsort((rank[at], sub[at]))]
        i, j = at[:-1], at[1:]
        pair = sub[i] == sub[j]
        i, j = i[pair], j[pair]
        best = np.full(n, -1)
        for s in range(0, len(i), 1 << 15):
            x, y = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
            diff = grid[x] != grid[y]
            same = np.where(diff.any(axis=1), diff.argmax(axis=1), width)
            same = np.minimum(same, np.minimum(sizes[x], sizes[y]))
            np.maximum.at(best, x, same)
            np.maximum.at(best, y, same)
        ok = (best >= 0) & (best + v >= length)
        max_l[ok] = np.maximum(max_l[ok], best[ok])
        max_r[ok] = np.maximum(max_r[ok], v)
    return max_l, max_r


HEAD = struct.Struct("<qqqqHHB")  # gram t1 t2 pos left, stored suffix bytes, lone
ROW = "t1 long, t2 long, a long, b long"


def _pack_run(rows: list[tuple]) -> bytes:
    """Front-coded run of (suffix, left, gram, t1, t2, pos, lone), sorted."""
    rows.sort(key=lambda r: r[0])
    out = []
    for (shared, rest), (_, left, gram, t1, t2, pos, lone) in zip(
            front_code([r[0] for r in rows]), rows, strict=True):
        out.append(HEAD.pack(gram, t1, t2, pos, len(left), len(rest), lone)
                   + struct.pack("<H", shared) + left + rest)
    return b"".join(out)


def _unpack_run(block: bytes):
    at, coded, meta = 0, [], []
    while at < len(block):
        gram, t1, t2, pos, n_left, n_rest, lone = HEAD.unpack_from(block, at)
        at += HEAD.size
        (shared,) = struct.unpack_from("<H", block, at)
        at += 2
        meta.append((t1, t2, pos, lone, block[at:at + n_left]))
        at += n_left
        coded.append((shared, block[at:at + n_rest]))
        at += n_rest
    return coded, meta


def _merge_part(pdf: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """Repeated stretches from all runs of one part."""
    coded, metas = zip(*map(_unpack_run, pdf["run"]), strict=True)
    lcp, rows = [], []
    for r, i, shared, _ in merge_runs(list(coded)):
        lcp.append(shared)
        rows.append(metas[r][i])
    max_l, max_r = cover(np.array(lcp, np.int64), [m[4] for m in rows], length, gram)
    out = [(t1, t2, pos - x, pos + y) for (t1, t2, pos, lone, _), x, y in
           zip(rows, max_l.tolist(), max_r.tolist(), strict=True) if lone and x >= 0]
    return pd.DataFrame(out, columns=["t1", "t2", "a", "b"], dtype="int64")


def _joined_runs(spans: str) -> Column:
    """Maximal runs of an array of (a, b)."""
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        return F.when((F.size(out) > 0) & (last["b"] >= x["a"]), F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))).otherwise(
            F.concat(out, F.array(x)))

    return F.aggregate(F.sort_array(spans), empty, add)


def _with_text(docs: DataFrame, small: DataFrame, how: str, rows: int, max_broadcast_rows: int) -> DataFrame:
    """``docs`` joined to a table by text; it is broadcast only if it has few
    ``rows`` in all its arrays."""
    return docs.join(F.broadcast(small) if rows <= max_broadcast_rows else small, ["t1", "t2"], how)


def _once(texts: DataFrame, wanted: DataFrame, rows: int, max_broadcast_rows: int) -> DataFrame:
    """Each wanted text one time, however many rows have it: copies go before
    the exchange, task by task, so no task gets all rows of a text."""
    if rows <= max_broadcast_rows:  # few: only their texts are exchanged
        texts = texts.join(F.broadcast(wanted.select("t1", "t2")), ["t1", "t2"], "left_semi")
    return _with_text(texts.dropDuplicates(["t1", "t2"]), wanted, "inner", rows, max_broadcast_rows)


def _slices(pdf: pd.DataFrame, size: int = 4 * CHUNK) -> Iterator[pd.DataFrame]:
    """Parts of a batch that hold about ``size`` bytes of text."""
    part = np.cumsum([len(t) for t in pdf["raw"]]) // size
    for _, g in pdf.groupby(part, sort=False):
        yield g


def _anchor_rows(texts: DataFrame, length: int, gram: int, hot: list[int], salts: int) -> DataFrame:
    """Anchors of all texts; those of the ``hot`` grams are dealt to ``salts``."""
    frequent = np.array(hot, np.int64)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in _slices(batch)):
            i, pos, g, c, left, right = anchors([bytes(t) for t in pdf["raw"]], length, gram)
            t1, g = pdf["t1"].to_numpy()[i], g.view(np.int64)
            salt = np.where(np.isin(g, frequent), 1 + (t1 ^ pos * 0x9E3779B1) % salts, 0)
            yield pd.DataFrame({"t1": t1, "t2": pdf["t2"].to_numpy()[i], "pos": pos, "gram": g, "salt": salt,
                                "ctx": c.view(np.int64), "left": left, "right": right})

    return texts.mapInPandas(
        find, "t1 long, t2 long, pos long, gram long, salt int, ctx long, left short, right short")


def _frequent_grams(texts: DataFrame, length: int, gram: int, parts: int, share: int, least: int) -> list[int]:
    """Grams that would fill half a partition by themselves, seen in one of
    ``share`` texts: at most 2 * ``parts`` of them.  They only decide what is
    salted, never what is found."""
    seen = (_anchor_rows(texts.where(F.pmod("t2", F.lit(share)) == 0), length, gram, [], 1)
            .groupBy("gram").count())
    seen = materialize(seen, "gram-sample")
    total = seen.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    bound = max(least, total // (2 * parts))
    return [r["gram"] for r in seen.where(F.col("count") > bound).select("gram").collect()]


def _unsalted(met: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes of all grams, and the salted rows that repeat in another salt."""
    rep = ["t1", "t2", "pos", "left", "right"]
    ends = met.where("kind = 1")
    salted = ends.where("salt > 0")
    classes = salted.groupBy("gram", "ctx").agg(
        F.sum(F.when(F.col("lone"), 1).otherwise(2)).alias("n"), F.min(F.struct(*rep)).alias("r"))
    several = classes.groupBy("gram").count().where("count > 1").select("gram")
    one = classes.join(several, "gram", "left_semi").select("gram", "r.*", (F.col("n") == 1).alias("lone"))
    again = (salted.where("lone").join(classes.where("n > 1").select("gram", "ctx"), ["gram", "ctx"], "left_semi")
             .where(F.col("left") + F.col("right") >= length).select("t1", "t2", "pos", "left", "right"))
    return ends.where("salt = 0").select("gram", *rep, "lone").unionByName(one), again


def repeats(texts: DataFrame, length: int = 200, gram: int = 48, max_group: int = 20_000,
            max_broadcast_rows: int = 200_000, share: int = 16, least: int = 64) -> DataFrame:
    """(t1, t2, runs) of texts (t1, t2, raw) that have a repeated string."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = _frequent_grams(texts, length, gram, parts, share, least)
    found = _anchor_rows(texts, length, gram, frequent, parts)
    met = materialize(
        found.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt", "ctx").mapInPandas(
            lambda it: _classes(it, length),
            "kind int, lone boolean, gram long, salt int, ctx long, t1 long, t2 long, pos long, "
            "left short, right short"),
        "anchors")
    ends, again = _unsalted(met, length)
    whole = (met.where("kind = 0").select("t1", "t2", "pos", "left", "right").unionByName(again)
             .select("t1", "t2", (F.col("pos") - F.col("left")).alias("a"),
                     (F.col("pos") + F.col("right")).alias("b")))
    ends = materialize(ends, "ends")
    sizes = ends.groupBy("gram").count()
    hot = materialize(sizes.where(F.col("count") > max_group).select("gram", F.lit(True).alias("hot")), "hot")
    wanted = (ends.join(hot, "gram", "left").groupBy("t1", "t2").agg(F.collect_set(F.struct(
        "gram", "pos", "left", "right", "lone", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("at")))
    n_ends = ends.count()
    at = _once(texts, materialize(wanted, "wanted"), n_ends, max_broadcast_rows)
    buckets = max(parts, -(-n_ends // 20_000))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[int, list] = {}
        size = 0
        for pdf in batches:
            for t1, t2, raw, places in zip(pdf["t1"], pdf["t2"], pdf["raw"], pdf["at"], strict=True):
                for p in places:  # cut out of the whole text
                    if not p["hot"]:
                        pos, right, left = p["pos"], p["right"], p["left"]
                        rows.setdefault(p["gram"] % buckets, []).append(
                            (raw[pos:pos + right], raw[pos - left:pos][::-1], p["gram"], t1, t2, pos, p["lone"]))
                        size += 2 * length
            if size > 8 << 20:
                yield pd.DataFrame([(k, _pack_run(v)) for k, v in rows.items()], columns=["part", "run"])
                rows, size = {}, 0
        yield pd.DataFrame([(k, _pack_run(v)) for k, v in rows.items()], columns=["part", "run"])

    merged = (at.select("t1", "t2", "raw", "at").mapInPandas(runs, "part long, run binary")
              .groupBy("part").applyInPandas(lambda pdf: _merge_part(pdf, length, gram), ROW))
    spans = whole.union(merged)
    if not hot.isEmpty():
        spans = spans.union(_counted(at, length))
    return (spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("s"))
            .select("t1", "t2", _joined_runs("s").alias("runs")))


def _counted(at: DataFrame, length: int) -> DataFrame:
    """Repeated strings around the anchors of hot grams, by counting hashes."""
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t1, t2, raw, places in zip(pdf["t1"], pdf["t2"], pdf["raw"], pdf["at"], strict=True):
                for p in places:
                    if p["hot"]:
                        for d in range(max(0, length - p["right"]), p["left"] + 1):
                            s = p["pos"] - d
                            h = hashlib.blake2b(raw[s:s + length], digest_size=16).digest()
                            rows.append((*struct.unpack("<qq", h), t1, t2, s))
            yield pd.DataFrame(rows, columns=["h1", "h2", "t1", "t2", "a"])

    seen = materialize(at.select("t1", "t2", "raw", "at").mapInPandas(
        windows, "h1 long, h2 long, t1 long, t2 long, a long").distinct(), "windows")
    twice = seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return (seen.join(twice, ["h1", "h2"], "left_semi")
            .select("t1", "t2", "a", (F.col("a") + length).alias("b")).distinct())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = 200, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row.

    ``kept`` is the remaining bytes.  Null texts are empty; rows that repeat a
    text of ``length`` bytes or more lose all of it; rows with null ids are
    treated like others; no rows give none."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(raw).alias("t1"),
                        F.xxhash64(F.lit(1), raw).alias("t2"), raw.alias("raw"))
    found = materialize(repeats(texts.select("t1", "t2", "raw"), length, **options), "repeats")
    n_runs = found.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    rows = _with_text(texts, found, "left", n_runs, options.get("max_broadcast_rows", 200_000))

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def rest(raws: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, spans in zip(raws, runs, strict=True):
            spans = [] if spans is None else [(s["a"], s["b"]) for s in spans]
            parts, at = [], 0
            for a, b in spans:
                parts.append(t[at:a])
                at = b
            kept = b"".join([*parts, t[at:]])
            out.append((kept, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (rows.withColumn("x", rest("raw", "runs"))
            .select(F.col("id").alias(id_col), "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept_sha256", "x.kept"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, hash(substr(x, 2 * s + 1, 400)) AS h FROM (
      SELECT doc_id, x, unnest(range(length(x) // 2 - 199)) AS s FROM d WHERE length(x) >= 400)),
p AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, s, sum(CASE WHEN prev IS NULL OR s > prev + 200 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
      SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM p)),
u AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM u),
t AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last,
        string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
