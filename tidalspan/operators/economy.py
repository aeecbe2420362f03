"""Economy and efficiency at a reference stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import economy_modality, gross_efficiency, ratio, running_economy
from ..schema import KEY


def reference_row(summary: DataFrame, position: int) -> DataFrame:
    """T5: the stage row at a position (1-based) in stage order of each test.

    A rank filter of this shape keeps ``position`` rows per test before the shuffle.
    """
    ordered = W.partitionBy(KEY).orderBy("stage")
    ranked = summary.withColumn("_at", F.row_number().over(ordered)).where(F.col("_at") <= position)
    return ranked.where(F.col("_at") == position).drop("_at")


def economy_metrics(
    summary: DataFrame,
    participants: DataFrame,
    tests: DataFrame,
    reference_stage: int,
    speed_kmh: float | None = None,
    config: DataFrame | None = None,
) -> DataFrame:
    """Gross efficiency (cycling) or running economy (treadmill), one row per test.

    ``reference_stage`` is a row position, not a stage number.  Treadmill speed comes from
    the argument, else the stage summary, else the protocol configuration.  Any other
    modality has null metrics.  Tests without that many stages yield no row.
    """
    if reference_stage < 1:
        raise ValueError("reference_stage starts at 1")
    df = reference_row(summary, reference_stage)
    df = df.join(participants.select(KEY, "weight_kg"), KEY, "left").join(tests.select(KEY, "protocol"), KEY, "left")
    if config is None:
        df = df.withColumns({
            "_modality": F.lit(None).cast("string"),
            "_planned": F.lit(None).cast("double"),
        })
    else:
        planned = F.col("starting_intensity") + F.col("increment_size") * (reference_stage - 1)
        df = df.join(config.select(KEY, F.col("modality").alias("_modality"), planned.alias("_planned")), KEY, "left")
    df = df.withColumn("modality", economy_modality(F.col("protocol"), F.col("_modality")))
    cycling, treadmill = F.col("modality") == "cycling", F.col("modality") == "treadmill"
    given = F.lit(speed_kmh).cast("double")
    df = df.withColumn("_speed", F.coalesce(given, F.col("speed_kmh"), F.col("_planned")))
    power = F.when(cycling & (F.col("power_w") > 0), F.col("power_w"))
    speed = F.when(treadmill & (F.col("_speed") > 0), F.col("_speed"))
    rer = F.coalesce("rer", F.lit(0.90))
    return df.select(
        KEY,
        "modality",
        F.lit(reference_stage).alias("reference_stage"),
        gross_efficiency(F.col("vo2_ml"), power, rer).alias("gross_efficiency"),
        running_economy(ratio(F.col("vo2_ml"), F.col("weight_kg")), speed).alias("running_economy"),
        power.alias("reference_power"),
        speed.alias("reference_speed"),
    )
