"""Property tests: text expressions against plain-Python statements of the
same rules (str.split / str.strip / slicing), on random Unicode strings."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.functions import text as TX

WS_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0   　"
ALPHABET = st.sampled_from(list(WS_CHARS) + list("abcXYZéßÅ0123-/,."))
TEXT = st.one_of(st.none(), st.text(ALPHABET, max_size=40))


def py_present(x):
    return x is not None and x.strip() != ""


def py_enhanced(title, brand, color, bullets, desc):
    """The enhanced-text rule with null and blank fields absent."""
    t = title.strip() if title is not None else None
    b = brand.strip() if brand is not None else None
    c = color.strip() if color is not None else None
    tl = (t or "").lower()
    parts = []
    if py_present(b) and b.lower() not in tl:
        parts.append(b)
    if py_present(t):
        parts += [t, "Product: " + t]
    if py_present(c) and c.lower() not in tl:
        parts.append("Color: " + c)
    if py_present(b):
        parts.append("Brand: " + b)
    if py_present(bullets):
        parts.append(bullets.strip()[:400])
    if py_present(desc):
        parts.append(desc.strip()[:600])
    return " ".join(" ".join(parts).split())


def py_basic(title, brand, desc):
    parts = []
    if title is not None:
        parts.append(title)
    if brand is not None and brand.lower() not in (title or "").lower():
        parts.append("Brand: " + brand)
    if desc is not None:
        parts.append(desc[:600])
    return " ".join(parts)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(TEXT, TEXT, TEXT, TEXT, TEXT), min_size=40, max_size=60))
def test_text_rules_match_python(spark, rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, product_title string, product_brand string, product_color string, "
        "product_bullet_point string, product_description string")
    got = df.select("i", TX.enhanced_text().alias("e"), TX.basic_text().alias("b"),
                    TX.collapse_ws("product_title").alias("c"),
                    TX.word_count("product_title").alias("w")).collect()
    for r in got:
        t, b, c, bl, d = rows[r["i"]]
        assert r["e"] == py_enhanced(t, b, c, bl, d)
        assert r["b"] == py_basic(t, b, d)
        if t is not None:
            assert r["c"] == " ".join(t.split())
            assert r["w"] == len(t.split())
