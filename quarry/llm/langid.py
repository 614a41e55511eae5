"""Language identification by cross-parsing entropy.

Per language, labelled text is turned into a suffix automaton.  A text is parsed
against it greedily: each phrase is the longest match that starts where the last
one ended (a character the language never showed is a phrase of its own).  The
fewer phrases a language needs per character, the lower the cross entropy; the
language with the fewest wins.

Text is normalised first: lower case, runs of non-letters become one space.  It
is parsed in blocks of ``block`` characters, a phrase ending at a block's edge,
so any text, however long, is parsed whole in bounded steps; every block of a
batch moves through the automaton's transition table at the same time (numpy).

Training text per language is bounded (``train_chars`` normalised characters, a
documented parameter): documents are taken in the order of a hash of their text
until the bound is reached.  The tables are broadcast; their size is bounded by
languages x 2 x train_chars x letters x 4 bytes, and ``max_table_bytes`` is
checked: with more languages, each gets fewer training characters.  ``letters``
bounds the columns, not the alphabet: letters beyond the most frequent ones are
told apart by sorted transitions (at most 3 x train_chars x 12 bytes a language).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
NEW = np.int32(1 << 30)  # flag of a table entry: a phrase ends before this character


_GAP = re.compile(r"[\W\d_]+")


@lru_cache(1)
def _numerals() -> frozenset[str]:
    """Characters that an expression takes for word characters and that are no letters."""
    return frozenset(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha())


def normalise(text: str) -> str:
    """Lower case, one space for each run of other than letters; numerals of any
    kind are no letters."""
    low = text.lower()
    if not low.isascii():
        for c in _numerals().intersection(set(low)):
            low = low.replace(c, " ")
    return _GAP.sub(" ", low)


class Automaton:
    """Suffix automaton of a string over letters 0..size-2 as a dense table, and
    over ``rare`` letters from ``size`` on as sorted transitions.

    ``table[state * size + letter]`` is the state after the letter; where no
    factor of the string goes on so, it is the state that a new phrase starts
    with, flagged NEW.  ``size - 1`` stands for letters that no language showed;
    like rare letters that this one never showed it ends a phrase on both sides.
    """

    def __init__(self, letters: np.ndarray, size: int, rare: int = 0):
        nexts, link, length = [{}], [-1], [0]
        last = 0
        for c in letters.tolist():
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        dead = len(nexts)  # after a letter never seen: what follows starts a phrase
        table = np.full((dead + 1, size), -1, np.int32)
        keys, to = [], []
        for s, out in enumerate(nexts):
            for c, t in out.items():
                if c < size:
                    table[s, c] = t
                else:
                    keys.append(s * rare + c - size)
                    to.append(t)
        start = np.where(table[0] >= 0, table[0], dead) | NEW
        self.table = np.where(table >= 0, table, start[None, :]).astype(np.int32).ravel()
        self.size, self.rare = size, rare
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.to = np.append(np.array(to, np.int32)[order], np.int32(dead))
        self.start = np.full(rare, dead, np.int32) | NEW
        for c, t in nexts[0].items():
            if c >= size:
                self.start[c - size] = t | NEW

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Table entries for rare letters (counted from 0)."""
        key = state.astype(np.int64) * self.rare + letter
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], self.start[letter])


def parse(blocks: np.ndarray, lengths: np.ndarray, auto: Automaton) -> np.ndarray:
    """Phrases of each row of ``blocks`` (letters by position x row, rows in
    falling order of length)."""
    n = len(lengths)
    state = np.zeros(n, np.int32)
    count = (lengths > 0).astype(np.int64)
    ends = np.zeros(n, np.int32)
    active = np.searchsorted(-lengths, -np.arange(len(blocks)), side="left")
    size, table, low = np.int32(auto.size), auto.table, np.int32(NEW - 1)
    rare = blocks.size and blocks.max() >= auto.size
    for t in range(len(blocks)):
        m = active[t]
        if rare:
            letter = blocks[t, :m].astype(np.int32)
            entry = table[state[:m] * size + np.minimum(letter, size - 1)]
            at = np.flatnonzero(letter >= size)
            entry[at] = auto.step(state[at], letter[at] - size)
        else:
            entry = table[state[:m] * size + blocks[t, :m]]
        if t:
            ends[:m] += entry >> 30
        state[:m] = entry & low
    return count + ends


class Model:
    """Automata of the languages (sorted by name) and the codes of all letters
    of their texts: the ``letters`` most frequent ones have a column in the dense
    tables, the others follow as rare ones."""

    def __init__(self, texts: dict[str, str], letters: int = 62, block: int = 256):
        seen = Counter()
        for t in texts.values():
            seen.update(t)
        ranked = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        kept, rare = sorted(ranked[:letters]), sorted(ranked[letters:])
        self.langs = sorted(texts)
        self.block = block
        self.size = len(kept) + 1
        self.code = np.full(0x110000, self.size - 1, np.min_scalar_type(self.size + len(rare)))
        self.code[[ord(c) for c in kept]] = np.arange(len(kept))
        self.code[[ord(c) for c in rare]] = self.size + np.arange(len(rare))
        self.autos = [Automaton(self.code[_points(texts[lang])], self.size, len(rare)) for lang in self.langs]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) phrases of normalised texts."""
        codes = [self.code[_points(t)] for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        owner = np.repeat(np.arange(len(codes)), -(-size // self.block))
        out = np.zeros((len(codes), len(self.langs)), np.int64)
        if not len(owner):
            return out
        first = np.concatenate([[0], np.cumsum(-(-size // self.block))[:-1]])
        inside = np.arange(len(owner)) - first[owner]
        lengths = np.minimum(self.block, size[owner] - inside * self.block)
        flat = np.concatenate(codes)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])[owner] + inside * self.block
        order = np.argsort(-lengths, kind="stable")
        lengths, begin, owner = lengths[order], begin[order], owner[order]
        step = 1 << 12  # blocks that move together
        for i in range(0, len(owner), step):
            ls, at, own = lengths[i:i + step], begin[i:i + step], owner[i:i + step]
            grid = np.minimum(at[None, :] + np.arange(ls[0])[:, None], len(flat) - 1)
            rows = flat[grid]
            for k, auto in enumerate(self.autos):
                out[:, k] += np.bincount(own, parse(rows, ls, auto), len(codes)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.  The score is the margin of the
        winner, 1 - its phrases / the runner-up's (1 if there is no other
        language); ties go to the first name, with score 0."""
        clean = [normalise(t) if t else "" for t in texts]
        known = np.array([any(c != " " for c in t[:2]) for t in clean], bool)
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at) and self.langs:
            n = self.phrases([clean[i] for i in at])
            best = n.argmin(axis=1)
            fewest = n[np.arange(len(at)), best]
            for i, b in zip(at, best, strict=True):
                lang[i] = self.langs[b]
            rest = np.sort(n, axis=1)[:, 1] if n.shape[1] > 1 else np.full(len(at), np.inf)
            score[at] = 1 - fewest / rest
        return lang, score


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          train_chars: int = 40_000, letters: int = 62, block: int = 256,
          max_table_bytes: int = 128 << 20) -> Model:
    """Fit on rows with text and language.  Per language, distinct texts in the
    order of their hash fill ``train_chars`` characters (the last one may be
    cut: this bounds the sample, not the texts that are judged).  Null texts
    and languages are left out; no labelled row gives a model without
    languages, which answers ``und``."""
    named = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("h"))
    langs = max(1, named.select("lang").distinct().count())
    chars = min(train_chars, max(500, max_table_bytes // (langs * 8 * (letters + 1))))
    order = Window.partitionBy("lang").orderBy("h")
    texts = named.select("lang", "h").distinct()
    sizes = F.broadcast(texts.groupBy("lang").agg(F.count("*").alias("__n")))  # a row a language
    rows = 32
    while True:  # at most ``chars`` rows a language, mostly the first 32
        # the hashes are uniform: those below a share of their range hold the first
        # ``rows`` ones several times over, and only these are ranked
        low = (F.least(F.lit(1.0), 8.0 * rows / F.col("__n")) - 0.5) * 2.0 ** 64
        near = texts.join(sizes, "lang").where(F.col("h").cast("double") <= low)
        first = (near.withColumn("rank", F.row_number().over(order))
                 .where(F.col("rank") <= rows).select("lang", "h"))
        before = F.coalesce(F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0))
        # texts up to the one that reaches ``chars``: under 2 x chars characters a language
        sample = (named.join(F.broadcast(first), ["lang", "h"])
                  .groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
                  .withColumn("text", F.regexp_replace("text", r"[^\p{L}]+", " "))
                  .withColumn("before", before).where(F.col("before") < chars).collect())
        taken: dict[str, list[str]] = {}
        for r in sorted(sample, key=lambda r: (r["lang"], r["h"])):
            taken.setdefault(r["lang"], []).append(normalise(r["text"]))
        joined = {lang: " ".join(t)[:chars] for lang, t in taken.items()}
        if rows >= chars or all(len(joined[k]) >= chars or len(taken[k]) < rows for k in joined):
            return Model(joined, letters, block)
        rows *= 8


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language and score of every row's whole text.  Null
    texts and texts without a letter get ``und`` and score 0.  Columns that
    have the names of the outputs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = [], []
            part, size = [], 0
            for t in [*texts, None]:  # about 2 MB of text at a time
                part.append(t)
                size += len(t or "")
                if size > 1 << 21 or len(lang) + len(part) == len(texts) + 1:
                    a, b = shared.value.predict(part)
                    lang += a
                    score += b.tolist()
                    part, size = [], 0
            yield pd.DataFrame({"lang": lang[:len(texts)], "score": score[:len(texts)]})

    # not to be evaluated again for a filter on what it returns
    judged = judge.asNondeterministic()(F.col(text_col))
    own = free_name("judged", docs)
    return (docs.withColumn(own, judged)
            .withColumn(lang_out, F.col(own).getField("lang"))
            .withColumn(score_out, F.col(own).getField("score")).drop(own))


def free_name(name: str, docs: DataFrame) -> str:
    """``name``, or with underscores before it, that ``docs`` has no column of."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the ids that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **options) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``, learning
    from its labelled rows that are not held out.  Rows with a null id count
    as not held out; repeated rows each get a row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out("id")), **options)
    return predict(rows, model).select(F.col("id").alias(id_col), held_out("id").alias("held_out"),
                                       "lang_pred", "score")
