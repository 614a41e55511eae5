"""Product-text and string expressions (T1-T12). Column expressions only:
everything stays in the JVM and in whole-stage codegen, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text recipes (must equal the reference's settings):
MAX_DESCRIPTION_LENGTH = 600
MAX_BULLETS_LENGTH = 400

# Whitespace as Python's str.split()/strip() see it: ASCII whitespace,
# the file/group/record/unit separators, NEL and Unicode separators.
# Written as an explicit class because Java's \s and RE2's \s differ.
WS = "[\\t\\n\\x0B\\f\\r \\x1c-\\x1f\\x85\\p{Z}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (``str.strip``)."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def collapse_ws(c) -> Column:
    """``" ".join(s.split())`` -- runs of whitespace to one space, trimmed."""
    return strip_ws(F.regexp_replace(_c(c), f"{WS}+", " "))


def icontains(haystack, needle) -> Column:
    """T5: case-insensitive containment; an empty needle is contained."""
    return F.contains(F.lower(_c(haystack)), F.lower(_c(needle)))


def prefix(c, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(_c(c), 1, n)


def _cut(c: Column, limit: int | None) -> Column:
    return c if limit is None else prefix(c, limit)


def basic_text(title="product_title", brand="product_brand", desc="product_description",
               max_description: int | None = None) -> Column:
    """Title; "Brand: b" unless the brand occurs in the title; the
    description (its first ``max_description`` characters, if given). Null
    parts are skipped, whitespace is kept as is."""
    t, b, d = _c(title), _c(brand), _c(desc)
    brand_part = F.when(b.isNotNull() & ~icontains(F.coalesce(t, F.lit("")), b),
                        F.concat(F.lit("Brand: "), b))
    return F.concat_ws(" ", t, brand_part, _cut(d, max_description))


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def enhanced_text(title="product_title", brand="product_brand", color="product_color",
                  bullets="product_bullet_point", desc="product_description",
                  max_bullets: int | None = None, max_description: int | None = None) -> Column:
    """Brand (if not in title), title, "Product: title", "Color: c"
    (if not in title), "Brand: b", bullets and description, cut to the given
    numbers of characters, if any; each field stripped before that; null or
    blank fields are absent; whitespace collapsed at the end."""
    t, b, c = strip_ws(title), strip_ws(brand), strip_ws(color)
    bl, d = strip_ws(bullets), strip_ws(desc)
    t_or_empty = F.coalesce(t, F.lit(""))
    parts = [
        F.when(_present(b) & ~icontains(t_or_empty, b), b),
        F.when(_present(t), t),
        F.when(_present(t), F.concat(F.lit("Product: "), t)),
        F.when(_present(c) & ~icontains(t_or_empty, c), F.concat(F.lit("Color: "), c)),
        F.when(_present(b), F.concat(F.lit("Brand: "), b)),
        F.when(_present(bl), _cut(bl, max_bullets)),
        F.when(_present(d), _cut(d, max_description)),
    ]
    return collapse_ws(F.concat_ws(" ", *parts))


def product_text(strategy: str, limits: bool = False) -> Column:
    """The text of a strategy; ``limits`` cuts it as the recipes do."""
    d, b = (MAX_DESCRIPTION_LENGTH, MAX_BULLETS_LENGTH) if limits else (None, None)
    if strategy == "basic":
        return basic_text(max_description=d)
    if strategy == "enhanced":
        return enhanced_text(max_bullets=b, max_description=d)
    raise ValueError(f"unknown text strategy {strategy!r} (basic, enhanced)")


def word_count(c) -> Column:
    """``len(s.split())``."""
    return F.size(F.filter(F.split(strip_ws(c), f"{WS}+"), lambda x: x != ""))


def preview(c, n: int, default: str = "") -> Column:
    """First n characters plus "..."; ``default`` for a missing text."""
    return F.coalesce(F.concat(prefix(c, n), F.lit("...")), F.lit(default))


def model_short_name(c) -> Column:
    """Text after the last '/'."""
    return F.element_at(F.split(_c(c), "/"), -1)


def model_cache_key(c) -> Column:
    """T11: '/' and '-' become '_'."""
    return F.translate(_c(c), "/-", "__")


def fmt4(c) -> Column:
    """4-decimal display string."""
    return F.format_string("%.4f", _c(c))
