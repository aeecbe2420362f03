"""Averaging over time bins, breath counts or rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, signals, texts
from .layout import index_rows, total_order
from .rolling import average_rolling


def _bin_means(df: DataFrame, group: str) -> DataFrame:
    numeric = ["time_s", *signals(df)]
    means = [F.avg(c).alias(c) for c in numeric]
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("time_s", "rn"))).alias(c) for c in texts(df)
    ]
    return df.groupBy(KEY, group).agg(*means, *first, F.count(F.lit(1)).alias("n_breaths"))


def average_by_time(breaths: DataFrame, window: float = 30.0) -> DataFrame:
    """A1: mean of every signal per time bin; time is the mean breath time of the bin.

    Partial aggregation runs before the shuffle, which is keyed on (test_id, bin).
    """
    df = breaths if "rn" in breaths.columns else breaths.withColumn("rn", total_order(breaths)[1] if "source_row" not in breaths.columns else F.col("source_row"))
    bins = df.withColumn("bin", F.floor(F.col("time_s") / F.lit(float(window))))
    return _bin_means(bins, "bin").drop("bin")


def average_by_breath(breaths: DataFrame, window: int = 30) -> DataFrame:
    """A2: mean of every signal per group of ``window`` consecutive breaths."""
    df = breaths if "rn" in breaths.columns else index_rows(breaths, total_order(breaths))
    groups = df.withColumn("bin", F.floor((F.col("rn") - 1) / F.lit(window)))
    return _bin_means(groups, "bin").drop("bin")


def average(breaths: DataFrame, method: str = "time", window: float = 30) -> DataFrame:
    """Average by ``time``, ``breath`` or ``rolling``.

    The result carries ``is_averaged``, ``averaging_window`` and ``averaging_method``;
    averaging averaged data again is allowed and reported in ``reaveraged``.
    """
    again = F.col("is_averaged") if "is_averaged" in breaths.columns else None
    run = {"time": average_by_time, "breath": average_by_breath, "rolling": average_rolling}
    if method not in run:
        raise ValueError(f"unknown averaging method: {method}")
    flags = None
    if again is not None:
        flags = breaths.groupBy(KEY).agg(F.bool_or(again).alias("reaveraged"))
        breaths = breaths.drop("is_averaged", "averaging_window", "averaging_method", "reaveraged")
    out = run[method](breaths, window)
    out = out.join(flags, KEY, "left") if flags is not None else out.withColumn("reaveraged", F.lit(False))
    return (
        out.withColumn("is_averaged", F.lit(True))
        .withColumn("averaging_window", F.lit(float(window)))
        .withColumn("averaging_method", F.lit(method))
    )
