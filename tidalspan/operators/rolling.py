"""Rolling statistics whose width differs per test.

``rolling_means`` costs the same for any width: a window is the difference of two running sums.  Running sums of doubles
would carry their rounding from row to row, so they are sums of decimals, which are exact.  ``rolling`` takes any
aggregate and costs the width per row; it is meant for narrow windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import KEY, LAYOUT, PREPARED, signals
from .layout import framed, is_split, prepare, with_chunks

# A frame of k rows is a RANGE frame on rn / k.  The slack separates "just inside"
# from "just outside" for every k below 5 million rows.
_FRAMES = {
    "center": "RANGE BETWEEN 0.4999999D PRECEDING AND 0.5000001D FOLLOWING",
    "right": "RANGE BETWEEN 0.9999999D PRECEDING AND CURRENT ROW",
}


def rolling(
    df: DataFrame,
    columns: Sequence[str],
    k: str,
    align: str = "center",
    functions: dict[str, str] | None = None,
    index: str = "rn",
) -> DataFrame:
    """Add ``<column><suffix>``: a mean over ``k`` rows (suffix ``_roll``), ``k`` a per-test column.

    ``functions`` maps other suffixes to other SQL aggregates over the same frame.

    Centred frames hold ``(k - 1) div 2`` rows before and ``k div 2`` after.  A value
    is null unless the frame holds ``k`` non-null values.
    """

    def build(part: list[str]) -> dict[str, Column]:
        # In a block, count from its start so that the position stays small.
        row = "(_offset + (_home - _block) * _length)" if "_block" in part else index
        order = f"CAST({row} AS DOUBLE) / {k}"
        over = f"OVER (PARTITION BY {', '.join(part)} ORDER BY {order} {_FRAMES[align]})"
        return {
            c + suffix: F.expr(f"CASE WHEN count({c}) {over} = {k} THEN {function}({c}) {over} END")
            for c in columns
            for suffix, function in (functions or {"_roll": "avg"}).items()
        }

    return framed(df, build, F.col(k), index)


#: Running sums up to the last row of a window, and up to the row before its first, by ``rn / k``.
_ENDS = {
    "center": ("RANGE BETWEEN UNBOUNDED PRECEDING AND 0.50000001D FOLLOWING", "RANGE BETWEEN UNBOUNDED PRECEDING AND 0.49999999D PRECEDING"),
    "right": ("RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "RANGE BETWEEN UNBOUNDED PRECEDING AND 0.99999999D PRECEDING"),
}
EXACT = "decimal(36,12)"
LARGEST = 1e14  # a billion rows of such values add up within EXACT


def _measures(columns: Sequence[str]) -> dict[str, Column]:
    """What is summed: each column's exact values, its non-null values, and those that have no exact value."""
    out = {}
    for c in columns:
        fits = F.abs(c) < LARGEST  # false for NaN, which is the largest of all
        out[f"_s_{c}"] = F.coalesce(F.when(fits, F.col(c)).try_cast(EXACT), F.lit(0).cast(EXACT))
        out[f"_n_{c}"] = F.col(c).isNotNull().cast("bigint")
        out[f"_x_{c}"] = (F.col(c).isNotNull() & ~fits).cast("bigint")
    return out


def rolling_means(df: DataFrame, columns: Sequence[str], k: str, align: str = "center", index: str = "rn") -> DataFrame:
    """Add ``<column>_roll``, the mean over ``k`` rows as ``rolling`` has it, at a cost that doesn't depend on ``k``.

    Values count to twelve decimals.  A full window with a value that is not finite, or 10^14 or more in size, is NaN.
    """
    sums = list(_measures(columns))

    def mean(c: str, last: Column, first: Column) -> Column:
        here = {x: last[f"{x}{c}"] - first[f"{x}{c}"] for x in ("_s_", "_n_", "_x_")}
        value = F.when(here["_x_"] > 0, F.lit(float("nan"))).otherwise(here["_s_"].cast("double") / F.col(k))
        return F.when(here["_n_"] == F.col(k), value).alias(f"{c}_roll")

    def whole(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", *[v.alias(n) for n, v in _measures(columns).items()])
        order = f"CAST({index} AS DOUBLE) / {k}"
        upto = [F.struct(*[F.expr(f"coalesce(sum({c}) OVER (PARTITION BY {KEY} ORDER BY {order} {end}), 0)").cast(EXACT if c.startswith("_s_") else "bigint").alias(c) for c in sums])
                for end in _ENDS[align]]
        rows = rows.select(*df.columns, upto[0].alias("_last"), upto[1].alias("_first"))
        return rows.select(*df.columns, *[mean(c, F.col("_last"), F.col("_first")) for c in columns])

    if not is_split(df):
        return whole(df)
    cut = with_chunks(df.where("split"), index)
    known = _running(cut, columns, index)
    back = F.floor((F.col(k) - 1) / 2) if align == "center" else F.col(k) - 1
    ahead = F.floor(F.col(k) / 2) if align == "center" else F.lit(0)
    rows = df.where("split").withColumn("_to", (F.col(index) + ahead).cast("bigint")).withColumn("_from", (F.col(index) - back - 1).cast("bigint"))
    nothing = F.struct(*[F.lit(0).cast(EXACT if c.startswith("_s_") else "bigint").alias(c) for c in sums])
    for end, into in (("_to", "_last"), ("_from", "_first")):
        at = known.select(F.col(KEY).alias("_key"), F.col(index).alias("_at"), F.col("_sums").alias(into))
        rows = rows.join(at, (F.col(KEY) == F.col("_key")) & (F.col(end) == F.col("_at")), "left").drop("_key", "_at")
    rows = rows.withColumn("_first", F.when(F.col("_from") == 0, nothing).otherwise(F.col("_first")))
    rows = rows.select(*df.columns, *[mean(c, F.col("_last"), F.col("_first")) for c in columns])
    return whole(df.where("not split")).unionByName(rows)


def _running(cut: DataFrame, columns: Sequence[str], index: str) -> DataFrame:
    """Key, ``index`` and the running sums ``_sums`` of split tests: within chunks first, then over the chunks before."""
    cut = cut.select(KEY, "chunk", index, *[v.alias(n) for n, v in _measures(columns).items()])
    sums = list(_measures(columns))
    upto = Window.partitionBy(KEY, "chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut.groupBy(KEY, "chunk").agg(*[F.sum(c).alias(c) for c in sums])
    chunks = chunks.select(KEY, "chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    local = cut.select(KEY, "chunk", index, *[F.sum(c).over(upto).alias(c) for c in sums]).join(chunks, [KEY, "chunk"])
    return local.select(KEY, index, F.struct(*[(F.col(c) + F.col(f"{c}_before")).cast(EXACT if c.startswith("_s_") else "bigint").alias(c) for c in sums]).alias("_sums"))


def average_rolling(breaths: DataFrame, window: float = 30.0) -> DataFrame:
    """Centred rolling mean of every signal, rows without a full window dropped.

    k = max(1, round(window / mean interval)); tests with fewer than 2 rows unchanged.
    Row numbers are dropped, since rows at both ends of a test go away.
    """
    df = prepare(breaths)
    # Without any time between the breaths no window is full.
    wanted = F.coalesce(F.rint(ratio(F.lit(float(window)), F.col("interval"))), F.col("n") + 1)
    width = F.when(F.col("n") < 2, 1).otherwise(F.greatest(F.lit(1.0), wanted))
    df = df.withColumn("k", width.cast("bigint"))
    cols = signals(breaths)
    rolled = rolling_means(df, cols, "k")
    kept = rolled.where(F.col("vo2_ml_roll").isNotNull() | (F.col("n") < 2))
    names = [c for c in breaths.columns if c not in {*cols, *LAYOUT, *PREPARED}]
    return kept.select(*names, *[F.col(c + "_roll").alias(c) for c in cols])


def outlier_scores(breaths: DataFrame, rule: str = "quality") -> DataFrame:
    """Z-score of each VO2 value against its own centred window.

    Window: ``max(5, min(11, n div 4))`` for ``quality``, ``min(11, n)`` for
    ``validate``.  Windows have eleven rows at most, so a sliding frame is cheap.
    Tests with fewer than 10 rows get no score.  A z-score that
    includes its own point is at most (k - 1) / sqrt(k), so threshold 3 needs k = 11.
    """
    df = prepare(breaths)
    n = F.col("n")
    if rule == "quality":
        width = F.greatest(F.lit(5), F.least(F.lit(11), F.floor(n / 4)))
    elif rule == "validate":
        width = F.least(F.lit(11), n)
    else:
        raise ValueError(f"unknown rule: {rule}")
    df = df.withColumn("_k", width.cast("bigint"))
    df = rolling(df, ["vo2_ml"], "_k", functions={"_mean": "avg", "_sd": "stddev_samp"})
    z = F.abs(F.col("vo2_ml") - F.col("vo2_ml_mean")) / F.nullif(F.col("vo2_ml_sd"), F.lit(0.0))
    return df.withColumn("z", F.when(n >= 10, z)).drop("_k", "vo2_ml_mean", "vo2_ml_sd")


def aberrant_breaths(breaths: DataFrame, threshold: float = 3.0, rule: str = "quality") -> DataFrame:
    """The flagged breaths themselves, one row each (artifact time stamps)."""
    scored = outlier_scores(breaths, rule)
    return scored.where(F.col("z") > threshold).select(KEY, "rn", "time_s", "vo2_ml", "z")
