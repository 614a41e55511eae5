import hashlib
import itertools
import math
import random
import re

from quarry.llm import secrets as S


# paths of words in one expression
NESTED = r"^[A-Za-z]+([/_-][A-Za-z]*[0-9]*)+$"


def test_paths_equal_the_nested_expression():
    for n in range(8):
        for run in map("".join, itertools.product("a1/-" if n > 5 else "aZ19/_-+", repeat=min(n, 7) if n != 5 else 5)):
            assert bool(re.search(NESTED, run)) == bool(re.search(S.PATHS[0], run) and not re.search(S.PATHS[1], run)), run


def test_very_long_runs(spark):
    n = 1_000_000
    texts = ["x" + c * n for c in "-_/"] + ["password" + " " * n + "= abcdefgh", "=" * n, "-" * n + "x", "a/b1-" * (n // 5),
             " " * n + "token=abcdef", "AKIA" + "A" * n, "0" * n, "token:" * (n // 600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in S.scan(df).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert got[i].spans == join(base)  # rules, blanks, paths and single letters hold no entropy


def brute_base(t):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return out


def brute_entropy(t):
    out = []
    for rank, c in enumerate(S.CLASSES, 3):
        for m in re.finditer(c.pattern + "+", t):
            run, spans = m[0], []
            if len(run) < c.window or any(re.search(p, run) for p in (*S.ALLOW, NESTED)):
                continue
            for i in range(len(run) - c.window + 1):
                win = run[i:i + c.window]
                h = -sum(win.count(x) / c.window * math.log2(win.count(x) / c.window) for x in set(win))
                if h >= c.threshold - 1e-9 / c.window:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + c.window
                    else:
                        spans.append([i, i + c.window])
            out += [(m.start() + a, rank, m.start() + b, c.name) for a, b in spans]
    return out


def join(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_scan_equals_brute_force(spark):
    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    def bit():
        k = rng.randrange(11)
        n = rng.randrange(5, 70)
        return ["é words and ", 'PassWord = "abc', "api_key:" + "x" * rng.randrange(4, 9) + " ",
                "token: 'a.b/c=d-e", "AKIA" + "".join(rng.choice("ABC019") for _ in range(n)),
                "".join(rng.choice("0123456789abcdef") for _ in range(n)) + " ",
                "".join(rng.choice(b64) for _ in range(n)), "AKIAAKIA" * 3, "aaaaaaaa" * 5 + " ",
                "secret =abcdefgh ", "😀 thequickbrownfoxjumpsoverthelazydog "][k]
    texts = ["".join(bit() for _ in range(rng.randrange(12))).encode("utf-16", "surrogatepass").decode("utf-16")
             for _ in range(150)]
    texts += [None, "", "0123456789abcdef" * 500 + " " + "".join(rng.choice(b64) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)] + [(None, "token=abcdef", "b", 1)] * 2,
                               "doc_id long, text string, base string, id int")
    got = S.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = (texts[r.doc_id] if r.doc_id is not None else "token=abcdef") or ""
        base = brute_base(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in S.BASE)
        assert r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert r.spans == join(base + brute_entropy(t)), t
    assert S.scan(df.limit(0)).count() == 0
