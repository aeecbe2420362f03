"""Plot-ready series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import o2_pulse, ratio, ve_vco2, ve_vo2
from ..functions.student import t_quantile
from ..operators.layout import attach, is_split, prepare, spread
from ..operators.peaks import find_peaks
from ..operators.stages import display_stages
from ..operators.thresholds import nearest_values
from ..schema import KEY, named

def with_time_axis(breaths: DataFrame, axis: str = "auto") -> DataFrame:
    """``time_plot`` in minutes for tests beyond 300 s, else seconds."""
    if axis not in ("auto", "minutes", "seconds"):
        raise ValueError(f"unknown time axis: {axis}")
    df = prepare(breaths)
    minutes = F.col("t_last") > 300 if axis == "auto" else F.lit(axis == "minutes")
    return df.withColumns({
        "time_unit": F.when(minutes, "min").otherwise("s"),
        "time_plot": F.when(minutes, F.col("time_s") / 60).otherwise(F.col("time_s")),
    })


def long_signals(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Chosen signals in long form."""
    return df.unpivot(ids, columns, "variable", "value")


def panel_fits(averages: DataFrame, level: float = 0.95) -> DataFrame:
    """Line fits of the panels VO2~power, HR~power (power > 0), VE~VCO2 and VCO2~VO2.

    Gives slope, intercept, residual standard error, n, mean and Sxx of x, and the t quantile of ``level`` (named by
    its percent); the band at x is fit +- t * se * sqrt(1/n + (x - mean)^2 / Sxx).
    """
    quantile = _quantile_name(level)
    loaded = F.col("power_w") > 0
    pairs = [
        ("vo2_power", F.when(loaded, F.col("power_w")), F.when(loaded, F.col("vo2_ml"))),
        ("hr_power", F.when(loaded, F.col("power_w")), F.when(loaded, F.col("hr_bpm"))),
        ("ve_vco2", F.col("vco2_ml"), F.col("ve_l")),
        ("vco2_vo2", F.col("vo2_ml"), F.col("vco2_ml")),
    ]
    points = F.array(*[F.struct(F.lit(p).alias("panel"), x.alias("x"), y.alias("y")) for p, x, y in pairs])
    long = averages.select(KEY, F.inline(points)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    fit = long.groupBy(KEY, "panel").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("mean_x"), F.avg("y").alias("_my"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("_sxy"), F.regr_syy("y", "x").alias("_syy"),
    )
    slope = F.when(F.col("sxx") > 0, F.col("_sxy") / F.nullif("sxx", F.lit(0.0)))
    fit = fit.withColumn("slope", slope)
    sse = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    freedom = F.col("n_points") - 2
    fit = fit.withColumns({
        "intercept": F.col("_my") - F.col("slope") * F.col("mean_x"),
        "residual_se": F.when(freedom > 0, F.sqrt(sse / F.nullif(freedom, F.lit(0)))),
        quantile: t_quantile(freedom, level),
    })
    return fit.select(KEY, "panel", "n_points", "slope", "intercept", "residual_se", "mean_x", "sxx", quantile)


def _quantile_name(level: float) -> str:
    return "t_" + f"{level * 100:g}".replace(".", "_")


def fit_bands(averages: DataFrame, level: float = 0.95) -> DataFrame:
    """Fitted value and band of ``level`` at every point of the panels."""
    fits = panel_fits(averages, level)
    loaded = F.col("power_w") > 0
    points = F.array(
        F.struct(F.lit("vo2_power").alias("panel"), F.when(loaded, F.col("power_w")).alias("x")),
        F.struct(F.lit("hr_power").alias("panel"), F.when(loaded & F.col("hr_bpm").isNotNull(), F.col("power_w")).alias("x")),
        F.struct(F.lit("ve_vco2").alias("panel"), F.col("vco2_ml").alias("x")),
        F.struct(F.lit("vco2_vo2").alias("panel"), F.col("vo2_ml").alias("x")),
    )
    long = averages.select(KEY, F.inline(points)).where(F.col("x").isNotNull())
    df = long.join(fits, [KEY, "panel"])
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    off = F.col("x") - F.col("mean_x")
    half = F.col(_quantile_name(level)) * F.col("residual_se") * F.sqrt(1 / F.col("n_points") + off * off / F.nullif("sxx", F.lit(0.0)))
    return df.select(KEY, "panel", "x", fitted.alias("fit"), (fitted - half).alias("low"), (fitted + half).alias("high"))


def panel_series(breaths: DataFrame, window: float = 30.0, axis: str = "auto") -> DataFrame:
    """Points of the nine panels: ``panel, series, x, y`` per test.

    Power panels use the rows with power above 0; tests without positive power use time
    instead; the end-tidal panel falls back to O2 pulse over VO2.
    """
    df = prepare(breaths)
    averages = display_stages(df, window)
    shape = {"_power": F.max("power_w"), "_hr": F.count("hr_bpm"), "_pet": F.count("peto2_mmhg")}
    if is_split(df):
        averages = averages.join(averages.groupBy(KEY).agg(*named(shape)), KEY)
    else:
        averages = attach(averages, shape)
    last = df.groupBy(KEY).agg(F.max("time_s").alias("_t_last"))
    averages = averages.join(last, KEY)
    minutes = F.col("_t_last") > 300 if axis == "auto" else F.lit(axis == "minutes")
    time = F.when(minutes, F.col("time_s") / 60).otherwise(F.col("time_s"))
    powered, has_hr, has_pet = F.col("_power") > 0, F.col("_hr") > 0, F.col("_pet") > 0
    powered = F.coalesce(powered, F.lit(False))
    load = F.when(F.col("power_w") > 0, F.col("power_w"))
    pulse = o2_pulse(F.col("vo2_ml"), F.col("hr_bpm"))

    def point(panel: int, series: str, x: Column, y: Column, when: Column) -> Column:
        inside = when & x.isNotNull() & y.isNotNull()
        return F.when(inside, F.struct(
            F.lit(panel).alias("panel"), F.lit(series).alias("series"), x.alias("x"), y.alias("y")
        ))

    by_load = F.when(powered, load).otherwise(time)
    always = F.lit(True)
    points = [
        point(1, "o2_pulse", by_load, pulse, has_hr),
        point(2, "vo2", by_load, F.col("vo2_ml"), always),
        point(3, "ve", F.col("vco2_ml"), F.col("ve_l"), always),
        point(4, "vco2", F.col("vo2_ml"), F.col("vco2_ml"), always),
        point(5, "ve_vo2", F.col("vo2_ml"), ve_vo2(), always),
        point(5, "ve_vco2", F.col("vo2_ml"), ve_vco2(), always),
        point(6, "rer", F.col("vo2_ml"), F.col("rer"), always),
        point(7, "peto2", F.col("vo2_ml"), F.col("peto2_mmhg"), has_pet),
        point(7, "petco2", F.col("vo2_ml"), F.col("petco2_mmhg"), has_pet),
        point(7, "o2_pulse", F.col("vo2_ml"), pulse, ~has_pet & has_hr),
        point(8, "hr", by_load, F.col("hr_bpm"), has_hr),
        point(9, "ve", time, F.col("ve_l"), always),
    ]
    return averages.select(KEY, F.inline(F.array_compact(F.array(*points))))


def peak_markers(breaths: DataFrame, averaging: float = 30.0) -> DataFrame:
    """Time, power, VO2 and heart rate of the peak marker (nearest breath to peak VO2)."""
    df = prepare(breaths)
    peaks = find_peaks(df, averaging=averaging).select(KEY, "vo2_peak", "hr_peak")
    at = nearest_values(df, peaks, "vo2_peak", ["time_s", "power_w"])
    return peaks.join(at, KEY).select(KEY, "time_s", "power_w", "vo2_peak", "hr_peak")


def v_slope_series(breaths: DataFrame, thresholds: DataFrame) -> DataFrame:
    """VCO2 over VO2 with threshold marker rows.

    Marker VT1 carries the VCO2 of the nearest breath, VT2 the highest VCO2 (label height).
    """
    points = breaths.select(KEY, F.lit("breath").alias("series"), F.col("vo2_ml").alias("x"), F.col("vco2_ml").alias("y"))
    marks = thresholds.where(F.col("vt1_vo2").isNotNull())
    first = nearest_values(breaths, marks, "vt1_vo2", ["vco2_ml"]).join(marks.select(KEY, "vt1_vo2"), KEY)
    first = first.select(KEY, F.lit("vt1").alias("series"), F.col("vt1_vo2").alias("x"), F.col("vco2_ml").alias("y"))
    top = breaths.groupBy(KEY).agg(F.max("vco2_ml").alias("y"))
    second = thresholds.where(F.col("vt2_vo2").isNotNull()).join(top, KEY)
    second = second.select(KEY, F.lit("vt2").alias("series"), F.col("vt2_vo2").alias("x"), "y")
    return points.unionByName(first).unionByName(second)


def ventilatory_series(breaths: DataFrame, x_axis: str = "time") -> DataFrame:
    """D3: VE/VO2 and VE/VCO2 over time (minutes) or VO2, in long form."""
    if x_axis not in ("time", "vo2"):
        raise ValueError(f"unknown x axis: {x_axis}")
    x = F.col("time_s") / 60 if x_axis == "time" else F.col("vo2_ml")
    wide = breaths.select(KEY, "rn", x.alias("x"), ve_vo2().alias("ve_vo2"), ve_vco2().alias("ve_vco2"))
    return long_signals(wide, [KEY, "rn", "x"], ["ve_vo2", "ve_vco2"])


def gas_exchange_series(
    breaths: DataFrame, participants: DataFrame, variables: tuple[str, ...] = ("vo2", "vco2", "rer"), normalize: bool = False
) -> DataFrame:
    """Chosen gas-exchange signals over time in minutes; P4: VO2 per kg on request."""
    source = {"vo2": "vo2_ml", "vco2": "vco2_ml", "rer": "rer", "ve": "ve_l"}
    unknown = [v for v in variables if v not in source]
    if unknown:
        raise ValueError(f"unknown variables: {unknown}")
    df = weight_normalised(breaths, participants) if normalize else breaths
    columns = {v: F.col("vo2_per_kg" if normalize and v == "vo2" else source[v]) for v in variables}
    wide = df.select(KEY, "rn", (F.col("time_s") / 60).alias("time_min"), *[c.alias(v) for v, c in columns.items()])
    return long_signals(wide, [KEY, "rn", "time_min"], list(variables))


def weight_normalised(breaths: DataFrame, participants: DataFrame) -> DataFrame:
    """VO2 divided by body weight."""
    df = spread(breaths, participants.select(KEY, "weight_kg"))
    return df.withColumn("vo2_per_kg", ratio(F.col("vo2_ml"), F.col("weight_kg"))).drop("weight_kg")


def heart_rate_zones(breaths: DataFrame, participants: DataFrame) -> DataFrame:
    """Zone limits at 50 to 100 % of the larger of 220 - age and the observed peak.

    Tests without heart rate have no zones.
    """
    peak = breaths.groupBy(KEY).agg(F.max("hr_bpm").alias("_peak")).where(F.col("_peak").isNotNull())
    df = peak.join(participants.select(KEY, "age"), KEY)
    reference = F.greatest(F.lit(220.0) - F.col("age"), F.col("_peak"))
    # Zone limits in percent.
    zones = F.explode(F.array(*[F.lit(p) for p in (50, 60, 70, 80, 90, 100)]))
    return df.select(KEY, reference.alias("hr_reference"), zones.alias("zone_pct")).withColumn(
        "zone_bpm", F.col("hr_reference") * F.col("zone_pct") / 100
    )


def heart_rate_series(breaths: DataFrame, participants: DataFrame, x_axis: str = "time") -> DataFrame:
    """Heart rate over time (minutes) or VO2, plus zone rows (x null)."""
    x = F.col("time_s") / 60 if x_axis == "time" else F.col("vo2_ml")
    points = breaths.where(F.col("hr_bpm").isNotNull()).select(
        KEY, F.lit("hr").alias("series"), x.alias("x"), F.col("hr_bpm").alias("y")
    )
    zones = heart_rate_zones(breaths, participants).select(
        KEY, F.concat(F.lit("zone_"), F.col("zone_pct").cast("string")).alias("series"),
        F.lit(None).cast("double").alias("x"), F.col("zone_bpm").alias("y"),
    )
    return points.unionByName(zones)


def two_axis_scale(breaths: DataFrame) -> DataFrame:
    """Scale and offset that map VO2 onto the power axis; null for constant VO2."""
    df = attach(breaths, {
        "_p0": F.min("power_w"), "_p1": F.max("power_w"), "_v0": F.min("vo2_ml"), "_v1": F.max("vo2_ml"),
    })
    scale = ratio(F.col("_p1") - F.col("_p0"), F.col("_v1") - F.col("_v0"))
    df = df.withColumn("scale", scale)
    df = df.withColumn("offset", F.col("_p0") - F.col("_v0") * F.col("scale"))
    return df.drop("_p0", "_p1", "_v0", "_v1")


def power_series(breaths: DataFrame) -> DataFrame:
    """Power and VO2 rescaled to the power axis over time in minutes; tests with power."""
    df = two_axis_scale(breaths).where(F.col("scale").isNotNull())
    return df.select(
        KEY, "rn", (F.col("time_s") / 60).alias("time_min"), "power_w",
        (F.col("vo2_ml") * F.col("scale") + F.col("offset")).alias("vo2_scaled"),
    )
