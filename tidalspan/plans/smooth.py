"""Smooth curves through plot series by local regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import index_rows
from ..schema import KEY

POINTS, SPAN = 80, 0.75
FLAT = 1e-10  # a determinant below this share of its scale has no solution


def smooth_curve(points: DataFrame, span: float = SPAN, grid: int = POINTS) -> DataFrame:
    """Local quadratic fits of y over x at ``grid`` evenly spaced places of every test and variable.

    ``points`` has test_id, variable, x and y; rows with a null x or y don't count.  A place is fitted to the share
    ``span`` of the points that lie nearest to it (rounded down), weighted by the tricube of their distance over that of
    the farthest.  A place with too few different x for a parabola gets a line, then a mean; series of fewer than three
    such neighbours have no curve.  Gives test_id, variable, place (from 0), x, y.

    The neighbours at a place are a run of the points in order of x, so their distance follows from the ends of runs of
    that length, found by rank.  Every point then adds to the sums of its places: no two points are ever joined, and the
    work is that of the points times ``grid``.
    """
    if not 0 < span <= 1 or grid < 2:
        raise ValueError("span must lie in (0, 1] and grid be 2 at least")
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.struct(KEY, "variable").alias(KEY), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = index_rows(rows, ["x", "y"]).withColumn("_q", F.floor(F.col("n") * span + 1e-5).cast("bigint")).where(F.col("_q") >= 3)
    limits = rows.groupBy(KEY).agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    places = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda g: F.struct(g.alias("place"), (F.col("_low") + (F.col("_high") - F.col("_low")) * g / (grid - 1)).alias("at")))
    places = limits.select(KEY, places.alias("places"))
    last = rows.select(F.col(KEY).alias("_key"), F.col("rn").alias("_rn"), F.col("x").alias("_to"))
    runs = rows.join(last, (F.col(KEY) == F.col("_key")) & (F.col("rn") + F.col("_q") - 1 == F.col("_rn"))).select(KEY, "x", "_to")
    runs = runs.join(places, KEY).select(KEY, "x", "_to", F.inline("places"))
    reach = runs.groupBy(KEY, "place", "at").agg(F.min(F.greatest(F.col("at") - F.col("x"), F.col("_to") - F.col("at"))).alias("reach"))
    reach = reach.groupBy(KEY).agg(F.collect_list(F.struct("place", "at", "reach")).alias("places"))  # ``grid`` of them
    near = rows.select(KEY, "x", "y").join(reach, KEY).select(KEY, "x", "y", F.inline("places"))
    off = (F.col("x") - F.col("at")) / F.nullif("reach", F.lit(0.0))
    # Without reach all neighbours lie at the place itself.
    near = near.withColumn("u", F.when(F.col("reach") > 0, off).when(F.col("x") == F.col("at"), 0.0)).where(F.abs("u") < 1)
    weight = F.pow(1 - F.pow(F.abs("u"), 3), 3)
    near = near.select(KEY, "place", "at", "u", "y", weight.alias("w"))
    sums = [F.sum(F.col("w") * F.pow("u", i)).alias(f"s{i}") for i in range(5)] + [F.sum(F.col("w") * F.pow("u", i) * F.col("y")).alias(f"t{i}") for i in range(3)]
    fitted = near.groupBy(KEY, "place", "at").agg(*sums)
    return fitted.select(F.col(f"{KEY}.{KEY}").alias(KEY), F.col(f"{KEY}.variable").alias("variable"), "place", F.col("at").alias("x"), _at_zero().alias("y"))


def _at_zero() -> Column:
    """The value at u = 0 of the parabola that fits the weighted sums, else of the line, else the mean."""
    s0, s1, s2, s3, s4 = (F.col(f"s{i}") for i in range(5))
    t0, t1, t2 = (F.col(f"t{i}") for i in range(3))
    three = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    parabola = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    two = s0 * s2 - s1 * s1
    line = t0 * s2 - s1 * t1
    enough = lambda d, scale: d > FLAT * scale
    return F.when(enough(three, s0 * s0 * s0), parabola / F.nullif(three, F.lit(0.0))).when(enough(two, s0 * s0), line / F.nullif(two, F.lit(0.0))).otherwise(t0 / F.nullif(s0, F.lit(0.0)))
