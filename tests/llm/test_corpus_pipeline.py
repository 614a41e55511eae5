import numpy as np

import corpus_pipeline as C
from quarry.llm import decontam, langid, linededup, simhash
from quarry.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**9, None, None, "s", None), (10**9 + 1, "12 34", "en", "s", 5)],
                                  docs.schema)
    docs = docs.union(extra)
    cols, seen = docs.columns, {}
    for name, stage in C.STAGES:
        seen[name] = (docs, docs := materialize(stage(spark, docs, SF), "t"))
        if name != "pack":
            assert docs.columns == cols
    before, after = seen["language_id"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert gone == {r.doc_id for r in before.collect()
                    if not any(c.isalpha() for c in r.text or "")} >= {10**9, 10**9 + 1}
    before, after = seen["line_dedup"]
    assert {r.doc_id: r.text for r in after.collect()} == {
        r.doc_id: r.text for r in linededup.drop_repeated_lines(before).collect()}
    before, after = seen["near_dedup"]
    rows = before.collect()
    fp = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    label = np.array([r.doc_id for r in rows])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    assert {r.doc_id for r in after.collect()} == set(label.tolist())
    before, after = seen["decontaminate"]
    bad = decontam.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
    assert {r.doc_id for r in after.collect()} == ({r.doc_id for r in before.collect()}
                                                   - {r.doc_id for r in bad.collect()})
    before, after = seen["pack"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert langid.UNKNOWN not in {r.lang for r in before.collect()}


def test_one_row_of_each_group_stays(spark):
    long = "wort " * 300
    rows = [(1, "A b c d", "x"), (2, "a B  c\td", "x"), (None, "a b c d", "x"), (6, long, "x"), (6, long, "x"),
            (6, long, "y"), (None, "only here", "x"), (None, "only here", "x"), (9, "one clean text here", "x"),
            (9, "a b c d", "x"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = C.near_dedup(spark, df, SF)
    assert got.columns == df.columns
    got = sorted(((r.doc_id or -1, r.text) for r in got.collect()), key=str)
    assert got == sorted([(1, "A b c d"), (6, long), (-1, "only here"), (9, "one clean text here"), (3, None)], key=str)
    assert C.near_dedup(spark, df.limit(0), SF).count() == 0
