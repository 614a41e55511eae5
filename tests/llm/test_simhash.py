import numpy as np
import pandas as pd
import pytest
import xxhash

from quarry.llm import simhash as S
from quarry.llm.components import components


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, bits):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


def test_code_is_perfect_and_near_words_share_a_key():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 4000)
    y = x.copy()
    for _ in range(2):
        y ^= np.where(rng.random(len(x)) < .8, 1 << rng.integers(0, 23, len(x)), 0)
    a, b = S.fuzzy_keys(x), S.fuzzy_keys(y)
    assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b, strict=True))
    assert set(np.unique((a >= 0).sum(1))) <= {1, 6}


def test_every_pair_meets_in_a_bucket():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64, endpoint=False)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    for p, q in zip(x, y, strict=True):
        assert set(S.bucket_keys(np.array([p]))[0]) & set(S.bucket_keys(np.array([q]))[0])


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("bucket", [2, 2048])
def test_links_give_the_components_of_all_pairs(spark, bits, bucket):
    rng = np.random.default_rng(2)
    fps = [rng.integers(0, 2**64, 40, dtype=np.uint64, endpoint=False)]
    for _ in range(4):  # random walks of one bit: chains and dense groups
        fps.append(fps[-1] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)))
    fps = np.unique(np.concatenate(fps))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    got = components(S.links(df, bits, bucket)).toPandas()
    roots = dict(zip(got.node, got.root, strict=True))
    mine = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    want = brute_roots(fps, bits)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_near_duplicates_handles_odd_rows(spark):
    long = "wort " * 30000
    rows = [(1, "A b c d"), (2, "a B  c\td"), (3, None), (4, ""), (5, " \n"), (6, long),
            (6, long), (None, "a b c d"), (7, "e"), (8, "É x y"), (9, "é x y"),
            (None, "only here")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows],
                               "doc_id long, text string, fp int, component_id string")
    got = S.near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    of = got.dropna(subset=["doc_id"]).set_index("doc_id")
    for i, t in rows:
        if i is not None:
            assert set(of.loc[[i], "fingerprint"]) == {f"{brute_fingerprint(t):016x}"}
    assert of.component_id[1] == of.component_id[2] == 1
    assert of.component_id[3] == of.component_id[4] == of.component_id[5] == 3
    assert of.component_id[9] == 9
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(r.doc_id or -1 for r in S.keep_one(df).collect())
    assert kept == [-1, -1, 1, 3, 6, 6, 7, 8, 9]
