"""Golden rows worked by hand (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import analysis as AN
from quarry.operators import metrics as M


def test_metrics_golden(spark):
    # q1,q3,q4,q5 have p1..p10; q2 has p1..p4; q6 has none
    preds = [(q, r, f"p{r}") for q in (1, 3, 4, 5) for r in range(1, 11)]
    preds += [(2, r, f"p{r}") for r in range(1, 5)]
    pdf = spark.createDataFrame(preds, "query_id long, rank int, product_id string")
    labels = [(1, "p3", "E"), (1, "p3", "S"), (1, "p9", "S"), (2, "p1", "S"), (3, "z", "E"),
              (4, "p1", "C"), (4, "p2", "I"), (6, "p1", "E")]
    ldf = spark.createDataFrame(labels, "query_id long, product_id string, esci_label string")
    from quarry.operators.prepare import relevant_set
    queries = spark.createDataFrame([(q,) for q in range(1, 7)], "query_id long")
    row = M.evaluate(pdf, relevant_set(ldf), queries).first()
    assert abs(row["Hits@1"] - 1 / 3) < 1e-6
    assert abs(row["Hits@5"] - 0.5) < 1e-6
    assert abs(row["Hits@10"] - 0.5) < 1e-6
    assert abs(row["MRR"] - 1 / 3) < 1e-6
    assert row["Num_Queries"] == 4
    assert (row["n_at_1"], row["n_at_5"], row["n_at_10"]) == (3, 2, 2)


def test_metrics_empty_is_zero(spark):
    pdf = spark.createDataFrame([], "query_id long, rank int, product_id string")
    rel = spark.createDataFrame([], "query_id long, product_id string")
    row = M.evaluate(pdf, rel).first()
    assert row["Hits@1"] == 0.0 and row["MRR"] == 0.0 and row["Num_Queries"] == 0


TEXT_ROWS = [
    ("g1", "Acme Mug", "acme", None, None, "Nice  mug"),
    ("g2", "Red Mug", "Zeta", "Blue", " big \t handle ", "Holds tea"),
    ("g3", "Red Mug", None, "red", None, None),
    ("g4", None, "One", None, None, "x"),
    ("g5", "Mug", "", "  ", None, ""),
    ("g6", None, None, None, None, None),
]
SCHEMA = ("product_id string, product_title string, product_brand string, product_color string, "
          "product_bullet_point string, product_description string")


def test_product_text_golden(spark):
    df = spark.createDataFrame(TEXT_ROWS, SCHEMA)
    got = {r["product_id"]: (r["b"], r["e"]) for r in
           df.select("product_id", TX.basic_text().alias("b"), TX.enhanced_text().alias("e")).collect()}
    assert got["g1"] == ("Acme Mug Nice  mug", "Acme Mug Product: Acme Mug Brand: acme Nice mug")
    assert got["g2"] == ("Red Mug Brand: Zeta Holds tea",
                         "Zeta Red Mug Product: Red Mug Color: Blue Brand: Zeta big handle Holds tea")
    assert got["g3"] == ("Red Mug", "Red Mug Product: Red Mug")
    assert got["g4"] == ("Brand: One x", "One Brand: One x")
    assert got["g5"] == ("Mug ", "Mug Product: Mug")
    assert got["g6"] == ("", "")


def test_truncation_counts_code_points(spark):
    s = "é" * 700
    df = spark.createDataFrame([("a", None, None, None, None, s)], SCHEMA)
    r = df.select(TX.basic_text(max_description=600).alias("b"), TX.basic_text().alias("whole")).first()
    assert (len(r["b"]), len(r["whole"])) == (600, 700)
    df = spark.createDataFrame([("a", None, None, None, s, None)], SCHEMA)
    r = df.select(TX.enhanced_text(max_bullets=400).alias("b"), TX.enhanced_text().alias("whole")).first()
    assert len(r["whole"]) - len(r["b"]) == 300


def test_unicode_whitespace_collapse(spark):
    df = spark.createDataFrame([(" a  b\x1c c  ",)], "s string")
    r = df.select(TX.collapse_ws("s").alias("c"), TX.word_count("s").alias("n")).first()
    assert r["c"] == "a b c" == " ".join(" a  b\x1c c  ".split())
    assert r["n"] == 3


def test_failure_classes_golden(spark):
    # one query per row of FIXTURES §4.3 (top-10 predictions)
    judged, preds, queries = [], [], []

    def add(qid, labels, pred_ids):
        queries.append((qid, "a b c"))
        for pid, lab in labels:
            judged.append((qid, pid, lab))
        for r, pid in enumerate(pred_ids, 1):
            preds.append((qid, r, pid))

    add(1, [("e", "E"), ("s", "S")], ["e", "x"])                         # success rank 1
    add(2, [("e", "E")], ["a", "b", "c", "d", "f", "e"])                 # success, low rank
    add(3, [("e", "E"), ("s", "S")], ["s"])                              # substitute only
    add(4, [("e", "E")], ["x"])                                          # complete miss (+example)
    add(5, [("s", "S")], ["x"])                                          # complete miss
    add(6, [("s", "S")], ["s"])                                          # unclassified
    add(7, [("c", "C"), ("i", "I")], ["c"])                              # skipped
    j = spark.createDataFrame(judged, "query_id long, product_id string, esci_label string")
    p = spark.createDataFrame(preds, "query_id long, rank int, product_id string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    rows = AN.classify(p, j, q)
    got = {r["query_id"]: (r["outcome"], r["low_rank"], r["first_exact_rank"]) for r in rows.collect()}
    assert got == {1: ("success", False, 1), 2: ("success", True, 6),
                   3: ("substitute_only", False, 0), 4: ("complete_miss", False, 0),
                   5: ("complete_miss", False, 0), 6: ("unclassified", False, 0)}
    b = AN.breakdown(rows).first()
    assert b["success_pct"] == 50.0            # 2 / (2 + 2)
    assert b["success_pct_all"] == 33.3        # 2 / 6
    assert b["n_low_rank"] == 1
    jr = j.withColumn("example_id", F.monotonically_increasing_id()) \
          .withColumn("product_title", F.concat(F.lit("T-"), "product_id"))
    texts = spark.createDataFrame([("x", "text of x")], "product_id string, text string")
    fx = AN.failure_examples(rows, jr, p, texts, q).collect()
    assert [r["query_id"] for r in fx] == [4]
    assert fx[0]["expected"] == "T-e" and fx[0]["got"] == "text of x"


def test_model_keys_and_display(spark):
    """T11 short model name / cache key, T12 4-decimal display, T9 preview."""
    df = spark.createDataFrame([("sentence-transformers/all-MiniLM-L6-v2", 0.48871, None),
                                ("plain", 1.0, "abcdef")], "m string, x double, t string")
    r = df.select(TX.model_short_name("m").alias("s"), TX.model_cache_key("m").alias("k"),
                  TX.fmt4("x").alias("f"), TX.preview("t", 3).alias("p"),
                  TX.preview("t", 3, "None").alias("p2")).collect()
    assert (r[0]["s"], r[0]["k"], r[0]["f"]) == ("all-MiniLM-L6-v2",
                                                  "sentence_transformers_all_MiniLM_L6_v2", "0.4887")
    assert (r[1]["s"], r[1]["k"], r[1]["f"]) == ("plain", "plain", "1.0000")
    assert (r[0]["p"], r[0]["p2"], r[1]["p"]) == ("", "None", "abc...")
