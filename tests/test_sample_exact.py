"""Samples of an exact size."""

import hashlib
from collections import Counter

import pytest

from quarry.operators import prepare as P


def _order(i):
    return hashlib.md5(f"42-{'' if i is None else i}".encode()).hexdigest()


@pytest.mark.parametrize("frac", [0.001, 0.1, 0.37, 0.5, 1.0])
def test_exact_size_on_any_partitioning(spark, frac):
    ids = list(range(999))
    want = set(sorted(ids, key=_order)[:round(frac * 999)])
    for parts in (1, 7):
        df = spark.range(999).withColumnRenamed("id", "example_id").repartition(parts)
        got = [r.example_id for r in P.sample_exact(df, frac).collect()]
        assert len(got) == len(want) and set(got) == want


def test_one_key_of_most_rows_and_equal_rows(spark):
    rows = [(7, f"v{i % 50}") for i in range(400)] + [(None, "n")] * 30 + [(i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "example_id long, v string")
    all_of = Counter(rows)
    for frac in (0.03, 0.25, 0.5, 0.9):
        runs = [Counter(map(tuple, P.sample_exact(df.repartition(n), frac).collect())) for n in (1, 5)]
        assert runs[0] == runs[1] and sum(runs[0].values()) == round(frac * len(rows))
        assert not runs[0] - all_of


def test_empty_table_and_bad_fraction(spark):
    empty = spark.createDataFrame([], "example_id long, `odd.name` string")
    assert P.sample_exact(empty, 0.5).count() == 0
    for frac in (0.0, 1.5):
        with pytest.raises(ValueError):
            P.sample_exact(empty, frac)
