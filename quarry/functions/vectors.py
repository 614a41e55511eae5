"""Dense-vector expressions (A8, A9). Vectors are ``array<float>``;
arithmetic is accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_float32(v) -> Column:
    """Store vectors as float32."""
    return _c(v).cast("array<float>")


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v) -> Column:
    """Unit length; a zero vector stays zero. Result is float32."""
    v = _c(v)
    n = F.sqrt(sq_norm(v))
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))) \
            .otherwise(as_float32(v))
