"""Student's t distribution against its finite sums and tabulated values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidalspan.functions.student import t_p_value, t_quantile


def finite_sum(t, n):
    """The p value for whole degrees of freedom."""
    theta, square = math.atan(t / math.sqrt(n)), n / (n + t * t)
    term = total = math.cos(theta) if n % 2 else 1.0
    for i in range(1, (n - 1) // 2 if n % 2 else n // 2):
        term *= square * (2 * i / (2 * i + 1) if n % 2 else (2 * i - 1) / (2 * i))
        total += term
    if n % 2:
        return 1 - 2 / math.pi * (theta + math.sin(theta) * (total if n > 1 else 0))
    return 1 - math.sin(theta) * total


def test_p_values(spark):
    rows = [(t, n) for t in (0.001, 0.4, 1.0, 1.7, 1.75, 2.6, 8.0, 40.0) for n in (1, 2, 3, 4, 5, 9, 20, 77, 1000, 20001)]
    df = spark.createDataFrame(rows, "t double, n int")
    for r in df.select("t", "n", t_p_value(F.col("t"), F.col("n")).alias("p"), t_p_value(-F.col("t"), F.col("n")).alias("q")).collect():
        assert r.p == r.q and abs(r.p - finite_sum(r.t, r.n)) < 1e-11, r


def test_small_tail_is_relative(spark):
    # 1 - A loses small tails; with one degree of freedom p is 2 / pi * atan(1 / t).
    p = spark.range(1).select(t_p_value(F.lit(1e9), F.lit(1)).alias("p")).first().p
    assert math.isclose(p, 2 / math.pi * math.atan(1e-9), rel_tol=1e-11)


@pytest.mark.parametrize("level", [0.5, 0.9, 0.95, 0.99, 0.999])
def test_quantiles_are_the_inverse(spark, level):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 7, 12, 40, 200, 5001)], "n int")
    for r in df.select("n", t_quantile(F.col("n"), level).alias("t")).collect():
        assert abs(finite_sum(r.t, r.n) - (1 - level)) < 1e-11, r


def test_tabulated_quantiles(spark):
    # Two-sided 5 % and 1 % quantiles to nine decimals.
    known = {(1, 0.95): 12.706204736, (2, 0.95): 4.302652730, (10, 0.95): 2.228138852, (30, 0.95): 2.042272456, (100, 0.95): 1.983971519,
             (1, 0.99): 63.656741162, (5, 0.99): 4.032142984, (60, 0.99): 2.660283029}
    for (n, level), t in known.items():
        assert abs(spark.range(1).select(t_quantile(F.lit(n), level).alias("t")).first().t - t) < 2e-9
    assert abs(spark.range(1).select(t_quantile(F.lit(2.5), 0.95).alias("t")).first().t - 3.5581) < 0.05  # between its neighbours


def test_edges(spark):
    rows = [(0.0, 5.0), (float("inf"), 5.0), (None, 5.0), (1.0, None), (1.0, 0.0), (1.0, 0.5), (float("nan"), 5.0)]
    df = spark.createDataFrame(rows, "t double, n double").select(t_p_value(F.col("t"), F.col("n")).alias("p"), t_quantile(F.col("n")).alias("q"))
    got = [(r.p, r.q) for r in df.collect()]
    assert [p for p, _ in got[:6]] == [1.0, 0.0, None, None, None, None] and math.isnan(got[6][0])
    assert [q is None for _, q in got] == [False, False, False, True, True, True, False]
    with pytest.raises(ValueError):
        t_quantile(F.lit(3), 1.0)
