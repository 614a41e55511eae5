import random

import pytest

from quarry.llm import linededup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("ab é"))
        elif s and kind == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("ab é")
    return "".join(s)


def brute(docs, edits, min_chars):
    first = {}
    for i, text in docs:
        for no, line in enumerate(text.split("\n")):
            if line.strip():
                first[line] = min(first.get(line, (i, no)), (i, no))
    out = []
    for i, text in docs:
        kept = []
        for no, line in enumerate(text.split("\n")):
            near = line.strip() and first[line] == (i, no) and not any(
                f < (i, no) and min(len(o), len(line)) >= min_chars and abs(len(o) - len(line)) <= edits
                and distance(o, line) <= edits for o, f in first.items())
            if not line.strip() or near:
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 30)))
        rows.append((a, mutate(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in L.with_edit_distance(df, "a", "b", edits, "d").collect():
        want = distance(r.a, r.b)
        assert r.d == (want if want <= edits else None), r


@pytest.mark.parametrize("edits", [1, 2])
def test_dedup_equals_brute_force(spark, edits):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh  é") for _ in range(rng.randrange(8, 40))) for _ in range(25)]
    docs = [(i, "\n".join(mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) if rng.random() < .9
                          else rng.choice(["", "  "]) for _ in range(rng.randrange(1, 9))))
            for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in L.dedup(df, max_edits=edits, min_chars=12).collect())
    assert got == brute(docs, edits, 12)
    got = sorted((r.doc_id, r.text) for r in
                 L.dedup(df, max_edits=edits, min_chars=12, max_broadcast_rows=0).collect())
    assert got == brute(docs, edits, 12)


def test_odd_rows(spark):
    line = "a line that is long enough to have near copies"
    rows = [(1, line), (2, line + "s"), (3, None), (4, ""), (None, line), (5, "own text\n" + line),
            (6, "again"), (6, "again"), (7, "x" * 200_000), (8, "x" * 199_999)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows],
                               "doc_id long, text string, no int, h1 int")
    got = {r.doc_id: r.text for r in L.dedup(df).collect()}
    assert got == {1: line, 2: "", 3: None, 4: "", None: "", 5: "own text", 6: "again",
                   7: "x" * 200_000, 8: ""}
    left = L.drop_repeated_lines(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6, 6, 7]
    assert L.dedup(df.limit(0)).count() == 0


def test_any_column_names(spark):
    line = "a line that is long enough to have near copies"
    names = ["nos", "__nos", "__id", "__th", "__parts", "__stay", "__lines", "__dropped", "id", "own", "th", "doc",
             "kept", "lines", "dropped", "h1", "a.b"]
    df = spark.createDataFrame([(1, line, *names), (2, line + "s\nnew", *names)],
                               ["doc_id", "text", *names])
    got = {r[0]: tuple(r) for r in L.drop_repeated_lines(df).collect()}
    assert got == {1: (1, line, *names), 2: (2, "new", *names)}
    out = L.dedup(df)
    assert out.columns == ["doc_id", "text", *(n for n in names if n not in ("__lines", "__dropped")),
                           "__lines", "__dropped"]
    assert sorted((r["doc_id"], r["__lines"], r["__dropped"]) for r in out.collect()) == [(1, 1, 0), (2, 2, 1)]


@pytest.mark.parametrize("edits", [1, 2])
def test_hot_segments_split_to_the_same_pairs(spark, edits):
    rng = random.Random(edits)
    head = "the same opening of every line "
    lines = [head + "".join(rng.choice("ab é") for _ in range(9)) for _ in range(60)]
    lines += [mutate(rng, rng.choice(lines), rng.randrange(1, edits + 2)) for _ in range(60)]
    lines = sorted({x for x in lines if len(x) >= 20})
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    names = {(r.h1, r.h2): r.line for r in df.select("line", *L._hashes()).collect()}
    got = [frozenset((names[r.h1, r.h2], names[r.g1, r.g2]))
           for r in L.near_pairs(df, edits, 20, split_pairs=4).collect()]
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and distance(a, b) <= edits}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
