import hashlib
import random
import re

import pytest

from quarry.llm import decontam as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    wins = []
    for item, text in items:
        ws = words(text)
        if ws:
            n = min(window, len(ws))
            wins += [(("" if item is None else str(item)), tuple(ws[i:i + n])) for i in range(len(ws) - n + 1)]
    out = []
    for i, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, win in set(wins):
            for s in range(len(ws) - len(win) + 1):
                if tuple(ws[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        out.append((i, len(ws), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.drop("th").collect()), key=str)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_equals_brute_force(spark, limit):
    rng = random.Random(4)
    vocab = ["Alpha", "beta", "gämma", "delta", "É", "x1", "the", "of"]
    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 40))) for i in range(12)]
    items += [(100, "beta"), (101, "of the"), (102, None), (None, "É É É x1"), (103, "..."), (3, items[3][1])]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 120))]
        if rng.random() < .5:
            parts.insert(rng.randrange(2), (rng.choice(items)[1] or "").upper().replace("GÄMMA", "GäMMA"))
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "Beta"), (None, "of THE"), (None, "of THE"), (5, docs[5][1]), (5, "of the x"),
             (63, "zz " * 40_000 + items[1][1])]
    d = spark.createDataFrame([(*r, 1, "g", 2) for r in docs], "doc_id long, text string, n int, gram string, id int")
    b = spark.createDataFrame([(*r, 3, 4) for r in items], "item_id long, text string, win int, th int")
    got = D.contamination(d, b, max_broadcast_rows=limit)
    assert got.columns == ["doc_id", "th", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got) == sorted(brute(docs, items), key=str)
    if limit:
        clean = D.drop_contaminated(d, b)
        assert clean.columns == d.columns
        assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(
            str(r[0]) for r in brute(docs, items) if not r[5])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert rows(D.contamination(d, b.limit(0))) == brute([(1, "a b c")], [])
    assert D.contamination(d.limit(0), b).count() == 0
