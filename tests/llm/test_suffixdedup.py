import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import suffixdedup as S


def brute(texts, length):
    """Removed runs of every text by counting all substrings."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[:-1], [False]]).astype(int)))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def test_merge_is_sorted_with_right_prefixes():
    rng = random.Random(0)
    for n_runs in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(rng.randrange(30)))
                for _ in range(n_runs)]
        got = list(S.merge_runs([S.front_code(r) for r in runs]))
        flat = sorted(x for r in runs for x in r)
        assert [g[3] for g in got] == flat
        last = b""
        for _, _, shared, s in got:
            assert shared == S.common_prefix(last, s, 0)
            last = s


def corpus(rng, n):
    words = [bytes(rng.choices(b"abcdefgh", k=rng.randrange(2, 9))) for _ in range(300)]
    def text(k):
        return b" ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randrange(5, 60)) for _ in range(8)]
    out = []
    for _ in range(n):
        t = b" ".join(rng.choice(passages) if rng.random() < .4 else text(rng.randrange(1, 40))
                      for _ in range(rng.randrange(1, 6)))
        out.append(t)
        if rng.random() < .3:  # a near copy
            at = rng.randrange(len(t))
            out.append(t[:at] + b"X" + t[at + rng.randrange(3):])
    return out


@pytest.mark.parametrize("options", [
    {"max_group": 1}, {}, {"share": 1, "least": 1, "max_broadcast_rows": 0}])
def test_equals_counting_all_substrings(spark, options):
    check(spark, options)


def test_salted_grams(spark, monkeypatch):
    monkeypatch.setattr(S, "_frequent_grams", lambda texts, length, gram, *_: [
        r["gram"] for r in S._anchor_rows(texts, length, gram, [], 1).select("gram").distinct().collect()])
    check(spark, {})


def check(spark, options):
    rng = random.Random(len(options))
    texts = corpus(rng, 120) + [b"a" * 500, b"", b"short", "é".encode() * 300]
    texts += [texts[3], texts[5] + texts[7], texts[5][:199], texts[5][:200]]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.remove_repeats(df, **options).collect()}
    for i, runs in enumerate(brute(texts, 200)):
        kept = bytearray()
        at = 0
        for a, b in runs:
            kept += texts[i][at:a]
            at = b
        kept += texts[i][at:]
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(texts[i]), len(texts[i]) - len(kept), len(runs)), i
        assert bytes(r.kept) == bytes(kept) and r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abc ", k=3 * S.CHUNK // 2))
    rows = [(1, None), (2, None), (3, "x" * 199), (3, "x" * 199), (4, "y" * 200), (4, "y" * 200),
            (None, long[-900:]), (5, long)]
    df = spark.createDataFrame([(*r, b"1", 2) for r in rows], "doc_id long, text string, raw binary, t1 long")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.remove_repeats(df).collect())
    assert got == [(0, 900, 900), (1, 0, 0), (2, 0, 0), (3, 199, 0), (3, 199, 0), (4, 200, 200),
                   (4, 200, 200), (5, len(long), 900)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_copies_of_a_text_send_one_suffix(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = word(400)
    copied, other = word(300) + passage + word(300), word(200) + passage + word(200)
    rows = [(i, copied) for i in range(300)] + [(1000, other), (1001, word(900))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    merge, log = S._merge_part, str(tmp_path)

    def counted(pdf, length, gram):
        n = sum(len(S._unpack_run(r)[1]) for r in pdf["run"])
        with open(f"{log}/{pdf['part'].iloc[0]}", "w") as f:
            f.write(str(n))
        return merge(pdf, length, gram)

    monkeypatch.setattr(S, "_merge_part", counted)
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(df).collect()}
    sent = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 0 < sent < 100  # not one for each of the 300 copies
    assert got == {i: 1000 for i in range(300)} | {1000: 400, 1001: 0}
