"""Helpers of the operators that count word sequences: word hashes of whole
batches in numpy, 64-bit mixing, a count-carrying blocked Bloom filter.

A word's hash is a polynomial in a fixed odd base over a fixed random value per
byte, modulo 2**64, taken from prefix sums over the batch and mixed with its
length.  Words are identified by these 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_U = np.uint64
WINDOW = 1 << 18  # bytes hashed at a time
HELD = 1 << 19    # rows that are packed at a time
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z become a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made of: unmix(mix(x)) == x."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31)) ^ (x >> _U(62))) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = (x ^ (x >> _U(27)) ^ (x >> _U(54))) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, first bytes first (most are alike and
    compress)."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(block: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(block, np.uint8).reshape(8, -1).T.copy().view(_U).ravel(), dtype=_U)


def ranges(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[slice]]:
    """Which of n equal ranges of the 64-bit numbers hold some of the sorted keys,
    and where in ``keys`` each of these ranges lies."""
    low = (((np.arange(1, n, dtype=_U) << _U(32)) + _U(n - 1)) // _U(n)) << _U(32)
    edge = np.concatenate([[0], np.searchsorted(keys, low), [len(keys)]])
    at = np.flatnonzero(edge[1:] > edge[:-1])
    return at, [slice(a, b) for a, b in zip(edge[at].tolist(), edge[at + 1].tolist(), strict=True)]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in this order."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(a, _U) * _U(0x9E3779B97F4A7C15) + np.asarray(b, _U))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, out=out)


_UP: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n, kept for the usual window."""
    if n <= WINDOW:
        if not _UP:
            _UP[0] = _powers(_BASE, WINDOW + 1), _powers(_INVERSE, WINDOW + 1)
        return _UP[0]
    return _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def windows(data: np.ndarray, is_sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that end behind a separator (or at the end)."""
    at = 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            inside = np.flatnonzero(is_sep[data[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:  # one word longer than a window
                while end < len(data) and not is_sep[data[end]]:
                    step = np.flatnonzero(is_sep[data[end:end + WINDOW]])
                    end = end + int(step[0]) if len(step) else min(end + WINDOW, len(data))
        yield at, end
        at = end


def words(data: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the maximal runs of non-separators in ``data``."""
    starts, ends, hashes = [], [], []
    for lo, hi in windows(data, is_sep):
        part = data[lo:hi]
        sep = np.concatenate([[True], is_sep[part], [True]])
        edge = np.flatnonzero(sep[1:] != sep[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = _scale(len(part))
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, _U)
            np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
            h = (total[e] - total[s]) * down[s]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(pair(h, (e - s).astype(_U)))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def parts(texts: list[str | None], size: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``size`` bytes together: the index of the first,
    and their bytes with A-Z lower-cased (a null text is empty)."""
    first, got, total = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if got and total + len(raw) > size:
            yield first, got
            first, got, total = i, [], 0
        got.append(raw)
        total += len(raw) + 1
    if got:
        yield first, got


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, weights
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


class Levels:
    """A Bloom filter in which a key can have levels 1 to q: each is an entry of
    its own, so that a key's level is found by probing until one is missing.
    Levels are never underestimated.

    The filter is cut into shards of SHARD bytes; the key alone decides the
    shard (whoever builds one needs the keys of this shard only), key and level
    the block of 64 bytes within it, in which ``bits`` bits are set."""

    SHARD = 1 << 14
    BLOCKS = SHARD // 64

    def __init__(self, shards: int, bits: int = 4, only: int | None = None):
        """All ``shards``, or the one numbered ``only``."""
        self.shards, self.bits = shards, bits
        self.start = 0 if only is None else only * self.SHARD
        self.data = np.zeros(self.SHARD * (shards if only is None else 1), np.uint8)

    @staticmethod
    def shard(keys: np.ndarray, shards: int) -> np.ndarray:
        return ((mix(keys) >> _U(40)) * _U(shards) >> _U(24)).astype(np.int64)

    def _places(self, keys: np.ndarray, level: np.ndarray | int):
        h = pair(keys, np.asarray(level, _U) + _U(0x5851F42D))
        block = self.shard(keys, self.shards) * self.BLOCKS + (h & _U(self.BLOCKS - 1)).astype(np.int64)
        for k in range(self.bits):
            bit = ((h >> _U(16 + 9 * k)) & _U(511)).astype(np.int64)
            yield block * 64 + (bit >> 3) - self.start, np.left_shift(1, bit & 7).astype(np.uint8)

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        keys = np.repeat(np.asarray(keys, _U), levels)
        last = np.cumsum(levels)
        level = np.arange(len(keys)) - np.repeat(last - levels, levels) + 1
        for byte, bit in self._places(keys, level):
            np.bitwise_or.at(self.data, byte, bit)

    def has(self, keys: np.ndarray, level: int = 1) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for byte, bit in self._places(keys, level):
            out &= (self.data[byte] & bit) != 0
        return out

    def level(self, keys: np.ndarray, most: int = 256) -> np.ndarray:
        """The level of each key, 0 where it has none."""
        out = np.zeros(len(keys), np.int64)
        alive, at = np.arange(len(keys)), 0
        while len(alive) and at < most:
            at += 1
            alive = alive[self.has(keys[alive], at)]
            out[alive] = at
        return out


def gathered(batches: Iterator[pd.DataFrame], *cols: str) -> Iterator[list[np.ndarray]]:
    """The columns of about HELD rows at a time."""
    got, size = [], 0
    for pdf in batches:
        if len(pdf):
            got.append([pdf[c].to_numpy() for c in cols])
            size += len(pdf)
        if size >= HELD:
            yield [np.concatenate(x) for x in zip(*got, strict=True)]
            got, size = [], 0
    if got:
        yield [np.concatenate(x) for x in zip(*got, strict=True)]


def build(keyed: DataFrame, shards: int) -> Levels:
    """The filter of a DataFrame (key long, level int): its keys travel in blocks,
    every shard is made by itself, and ``shards`` x SHARD bytes come to the driver."""
    def pack(batches):
        for key, level in gathered(batches, "key", "level"):
            shard = Levels.shard(key.view(_U), shards)
            order = np.argsort(shard, kind="stable")
            key, level, shard = key[order], level[order].astype(np.int32), shard[order]
            at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            cut = [slice(a, b) for a, b in zip(at, np.append(at[1:], len(key)), strict=True)]
            yield pd.DataFrame({"shard": shard[at].astype(np.int32), "keys": [key[c].tobytes() for c in cut],
                                "levels": [level[c].tobytes() for c in cut]})

    def fill(group):
        shard = int(group["shard"].iloc[0])
        part = Levels(shards, only=shard)
        for key, level in zip(group["keys"], group["levels"], strict=True):
            part.add(np.frombuffer(key, _U), np.frombuffer(level, np.int32))
        return pd.DataFrame({"shard": [shard], "data": [part.data.tobytes()]})

    out = Levels(shards)
    for r in (keyed.select("key", "level").mapInPandas(pack, "shard int, keys binary, levels binary")
              .groupBy("shard").applyInPandas(fill, "shard int, data binary").collect()):
        at = r["shard"] * Levels.SHARD
        out.data[at:at + Levels.SHARD] = np.frombuffer(r["data"], np.uint8)
    return out
