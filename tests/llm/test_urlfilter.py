import random

from quarry.llm import urlfilter as U


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:].split("?")[0].split("#")[0]
    best = None
    for rule, h, p in (("net/", "net", "/"), ("example.net/en/", "example.net", "/en/"),
                       ("example.com/de/", "example.com", "/de/"), ("org/fr/", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


URLS = ["http://A.Example.NET/en/x?y#z", "https://net", "https://net/", "x://notexample.net/en/", None, "",
        "no scheme/en/", "a://b://c.org/fr/", "http://example.com/de", "http://example.com/de/é?q",
        "http://example.com#/de/", "http://É.ORG/fr/", "http://org/fr/" + "z" * 100_000, "://", "http://x\ny.net/a"]
VERDICT = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_judge_rules_and_odd_urls(spark):
    df = spark.createDataFrame([(i, u, 0, "r") for i, u in enumerate(URLS)] + [(None, URLS[0], 0, "r")] * 2,
                               "page_id long, url string, host int, rule string")
    got = U.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule = brute(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (VERDICT[rule] if rule else r.verdict) and r.verdict in ("allow", "block")
    assert U.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(df.where("url is null")).collect()} == {"allow"}


def test_model_held_out_accuracy(spark):
    rng = random.Random(0)
    def url(bad):
        words = ["casino", "pills", "winbig"] if bad else ["school", "garden", "archive"]
        return f"www.{rng.choice(words)}{rng.randrange(99)}.example", f"/{rng.choice(words)}/{rng.randrange(999)}"
    rows = [(*url(i % 2), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "host string, path string, block int")
    train, test = df.limit(0).union(spark.createDataFrame(rows[:400], df.schema)), rows[400:]
    model = U.UrlModel(train)
    got = model.score(spark.createDataFrame(test, df.schema)).collect()
    assert sum((r.score >= .5) == r.block for r in got) / len(got) > .95
    assert U.UrlModel(df.where("block = 1")).only == 1.0
