"""Peak values, time to peak and stage plateau."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import KEY
from .layout import prepare
from .rolling import rolling
from .stages import last_stages

_PEAKS = {
    "vo2_peak": "vo2_ml", "ve_peak": "ve_l", "rer_peak": "rer",
    "hr_peak": "hr_bpm", "power_peak": "power_w", "speed_peak": "speed_kmh",
}


def _smoothed(breaths: DataFrame, averaging: float, columns: list[str]) -> DataFrame:
    """Centred rolling means over max(3, round(averaging / interval)) rows, at most n."""
    df = prepare(breaths)
    wanted = F.coalesce(F.rint(ratio(F.lit(float(averaging)), F.col("interval"))), F.col("n"))
    df = df.where(F.col("n") >= 3)
    df = df.withColumn("_k", F.least(F.greatest(F.lit(3.0), wanted), F.col("n")).cast("bigint"))
    return rolling(df, columns, "_k")


def find_peaks(
    breaths: DataFrame, participants: DataFrame | None = None, averaging: float = 30.0
) -> DataFrame:
    """Highest rolling mean of each signal, one row per test.

    Tests with fewer than 3 rows yield no row.  ``participants`` adds VO2 per kg.
    """
    columns = {name: c for name, c in _PEAKS.items() if c in breaths.columns}
    smooth = _smoothed(breaths, averaging, list(columns.values()))
    peaks = smooth.groupBy(KEY).agg(*[F.max(c + "_roll").alias(name) for name, c in columns.items()])
    for name in _PEAKS:
        if name not in columns:
            peaks = peaks.withColumn(name, F.lit(None).cast("double"))
    peaks = peaks.withColumn("averaging_s", F.lit(float(averaging)))
    if participants is None:
        return peaks
    weights = participants.select(KEY, "weight_kg")
    return (
        peaks.join(weights, KEY, "left")
        .withColumn("vo2_kg_peak", ratio(F.col("vo2_peak"), F.col("weight_kg")))
        .drop("weight_kg")
    )


def time_to_peak(breaths: DataFrame, averaging: float = 30.0) -> DataFrame:
    """Time of the first maximum of the rolling VO2 mean."""
    smooth = _smoothed(breaths, averaging, ["vo2_ml"])
    value = F.col("vo2_ml_roll")
    key = F.when(value.isNotNull(), F.struct(-value, F.col("rn")))
    return smooth.groupBy(KEY).agg(F.min_by("time_s", key).alias("time_to_peak_s"))


def stage_plateau(staged: DataFrame, threshold: float = 150.0) -> DataFrame:
    """Does VO2 level off between the last two stages while power rises?

    Stage 0 counts as a stage here.  Tests with fewer than two stages yield no row;
    without power the verdict is null unless VO2 alone rules the plateau out.
    """
    means = (
        staged.where(F.col("stage").isNotNull())
        .groupBy(KEY, "stage")
        .agg(F.avg("vo2_ml").alias("vo2"), F.avg("power_w").alias("power"))
    )
    last_two = last_stages(means)
    pick = lambda c, i: F.max(F.when(F.col("back") == i, F.col(c)))
    out = last_two.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_stages"),
        (pick("vo2", 1) - pick("vo2", 2)).alias("vo2_increase"),
        (pick("power", 1) - pick("power", 2)).alias("power_increase"),
    )
    verdict = (F.col("vo2_increase") < threshold) & (F.col("power_increase") > 0)
    return out.where(F.col("_stages") == 2).drop("_stages").withColumn("plateau", verdict)
