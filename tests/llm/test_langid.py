import random
import zlib

import numpy as np

from quarry.llm import langid as L


def brute_phrases(text, train, block):
    """Greedy phrases by substring search, a phrase ending at a block's edge."""
    n = 0
    for i in range(0, len(text), block):
        part, j = text[i:i + block], 0
        while j < len(part):
            k = j
            while k < len(part) and part[j:k + 1] in train:
                k += 1
            j = max(k, j + 1)
            n += 1
    return n


def test_phrases_equal_substring_search():
    rng = random.Random(0)
    train = {g: "".join(rng.choice(a) for _ in range(400)) for g, a in
             (("x", "abc "), ("y", "bcd "), ("z", "é "))}
    model = L.Model(train, block=16)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (0, 1, 15, 16, 17, 300, 999)]
    want = [[brute_phrases(t, train[g], 16) for g in model.langs] for t in texts]
    assert model.phrases(texts).tolist() == want


def test_identify_learns_and_answers_odd_rows(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "and", "with", "this"], "bb": ["und", "der", "nicht", "auch"]}
    rows = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(4, 60))), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", None), (903, "der und " * 9000, None),
             (None, "the and with", None), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, 0.5, "no") for r in rows],
                               "doc_id long, text string, lang string, score double, lang_pred string")
    got = L.identify(df).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    for i in range(200):
        assert by.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert np.mean([by.lang_pred[i] == ("aa", "bb")[i % 2] for i in range(200)]) > .98
    assert [by.lang_pred[i] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert got.score.between(0, 1).all()
    assert set(L.identify(df.where("text is null or lang is null")).toPandas().lang_pred) == {"und"}
    assert L.identify(df.limit(0)).count() == 0


def test_letters_beyond_the_dense_columns_are_told_apart():
    rng = random.Random(3)
    train = {g: "".join(rng.choice(a) for _ in range(400)) for g, a in
             (("x", "abcd "), ("y", "漢字仮名 "), ("z", "漢語한글 "))}
    model = L.Model(train, letters=3, block=16)
    texts = ["".join(rng.choice("abc漢字名한Ω ") for _ in range(n)) for n in (0, 1, 15, 16, 17, 300, 999)]
    want = [[brute_phrases(t, train[g], 16) for g in model.langs] for t in texts]
    assert model.phrases(texts).tolist() == want


def test_scripts_outside_the_most_frequent_letters():
    rng = random.Random(4)
    latin = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    words = {"la": latin, "cy": "".join(map(chr, range(0x430, 0x450))), "el": "αβγδεζηθικλμνξοπρστυφχψω",
             "zh": "".join(map(chr, range(0x4E00, 0x4F00))), "ko": "".join(map(chr, range(0xAC00, 0xAD00)))}
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(n))
    model = L.Model({g: text(a, 3000) for g, a in words.items()})
    for g, a in words.items():
        assert model.predict([text(a, 20) for _ in range(10)])[0] == [g] * 10


def test_numerals_are_no_letters_and_long_texts_stay_whole(spark):
    train = [(i, "the and with this " * 5, "aa") for i in range(40)] + [(100 + i, "und der nicht auch " * 5, "bb")
                                                                       for i in range(40)]
    odd = [(200, "½ ²³", None), (201, "①②", None), (202, "Ⅷ ٣ 四", None), (203, "", None),
           (204, " " * 1_000_000 + "und der", None), (205, "½nicht²auch", None)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(df).collect()}
    assert [got[i] for i in (200, 201, 203)] == ["und"] * 3
    assert got[204] == got[205] == "bb"
    assert "四".isalpha() and got[202] != "und"  # a letter by category, though a numeral
    assert L.normalise("½a²③b٣_c") == " a b c"


def test_training_sample_is_the_same_on_any_partitioning(spark):
    rows = [(f"{g} word{i} and some more of it", g) for i in range(1500) for g in ("aa", "bb")] + [("x", "cc")] * 900
    df = spark.createDataFrame(rows, "text string, lang string")
    a, b = (L.train(df.repartition(n), train_chars=3000) for n in (1, 7))
    assert a.langs == b.langs == ["aa", "bb", "cc"]
    for x, y in zip(a.autos, b.autos, strict=True):
        assert (x.table == y.table).all()
