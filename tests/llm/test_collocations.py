import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import collocations as C


def brute(rows, least, longest=5, most=2000, absorb=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, ws), a in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                inside[lang, ws[i:i + m]] = max(inside[lang, ws[i:i + m]], a)
    out = defaultdict(list)
    for (lang, ws), a in cand.items():
        if inside.get((lang, ws)) and 100 * inside[lang, ws] >= absorb * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, x in out.items()
            for i, (s, a, p, le, r) in enumerate(sorted(x)[:most])}


def fixture():
    rng = random.Random(7)
    vocab = ["The", "of", "a", "wind", "été", "sea", "lamp", "\x01", "x-y", "Ωmega", "\x1c", "😀"]
    rows = [(rng.choice(["en", "en", "fr", None, "und", ""]),
             "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "  "])
                     for _ in range(rng.randrange(80)))) for _ in range(150)]
    rows += [("en", "All rights reserved under the old law; contact us")] * 40
    rows += [("fr", None), (None, None), (None, ""), ("de", " .,;"), ("de", "solo"), ("fr", "a b " * 20_000)]
    return rows


@pytest.mark.parametrize("least, hot, most, absorb, bucket", [
    (4, 1000, 2000, 100, 1 << 18), (3, 30, 7, 100, 50), (2, 1, 2000, 60, 300)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, hot, most, absorb, bucket):
    rows = fixture()
    df = spark.createDataFrame([(i, *r, 1, "w") for i, r in enumerate(rows)],
                               "doc_id long, lang string, text string, n int, word string")
    monkeypatch.setattr(C, "BUCKET", bucket)
    monkeypatch.setattr(C, "HELD", 40)
    got = C.mine(df.repartition(6), least=least, hot=hot, most=most, absorb=absorb).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute(rows, least, most=most, absorb=absorb)


def test_exact_beyond_64_bits_and_empty(spark):
    assert C.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.mine(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0
    big = 9_000_000_000_000
    df = spark.createDataFrame([(big, big - 1, big, big - 7)], "a long, n long, l long, r long")
    got = df.selectExpr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r) AS s").first()["s"]
    assert got == 1000 * big * (big - 1) // (big * (big - 7))


def test_quicksort_counts_prefixes():
    import numpy as np
    rng = np.random.default_rng(1)
    cols = [rng.integers(1, 5, 3000).astype(np.uint64) for _ in range(4)]
    cols[3][::7] = 0
    n = rng.integers(1, 4, 3000)
    want = Counter()
    for i in range(3000):
        for d in range(1, 5):
            if cols[d - 1][i] == 0:
                break
            want[tuple(int(c[i]) for c in cols[:d])] += int(n[i])
    got = {tuple(int(c[r]) for c in cols[:d]): w for d, r, w in C.quicksort(cols, n, 30)}
    assert got == {k: v for k, v in want.items() if v >= 30}
