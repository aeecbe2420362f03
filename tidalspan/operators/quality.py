"""Effort, protocol and data quality.

Most measures are aggregates over the rows of a test.  Each is kept as a pair: the
aggregates (``_*_values``) and the columns made from them (``_*_columns``), so that a
composite takes all of its measures from one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, rating, steps, tally, test_modality
from ..functions.student import t_p_value
from ..schema import KEY, named
from .layout import attach, prepare, rank_rows
from .rolling import outlier_scores, rolling
from .stages import power_levels

# Phase names of the exercise, warm-up and rest parts.
EXERCISE_NAMES = ["exercise", "ex", "work", "load"]
WARMUP_NAMES = ["rest", "warmup", "warm-up", "baseline"]
BASELINE_NAMES = ["rest", "baseline", "warmup"]
DRIFT_NAMES = ["rest", "baseline"]

EXPECTED_SLOPE = 10.0  # mL/min per watt on a cycle ergometer
REST_VO2 = 250.0  # mL/min at zero load


# ---------------------------------------------------------------- effort


def end_plateau(breaths: DataFrame, threshold: float = 150.0, window_s: float = 30.0) -> DataFrame:
    """Does smoothed VO2 level off over the last 20 % of the test?

    With at least 10 smoothed power values there: power range above 10 W and VO2 range
    below the threshold; otherwise the mean rises by [0, threshold) from the first to
    the second half.  Tests below 60 rows, with k below 5 or with fewer than 10
    smoothed values: not detected, delta null.
    """
    df = prepare(breaths)
    tests = df.select(KEY).distinct()
    return tests.join(_plateau(df, threshold, window_s), KEY, "left").select(
        KEY, F.coalesce("_flat", F.lit(False)).alias("plateau_detected"), "plateau_delta"
    )


def _plateau(df: DataFrame, threshold: float, window_s: float = 30.0) -> DataFrame:
    """Verdict and delta of the tests that have enough rows."""
    gap = F.when(F.col("interval") > 0, F.col("interval")).otherwise(F.lit(1.0))
    wanted = F.greatest(F.lit(5.0), F.rint(F.lit(float(window_s)) / gap))
    df = df.withColumn("_k", F.least(wanted, F.floor(F.col("n") / 2)).cast("bigint"))
    usable = df.where((F.col("n") >= 60) & (F.col("_k") >= 5))
    smooth = rolling(usable, ["vo2_ml", "power_w"], "_k", "right")
    tail = smooth.where(F.col("rn") >= F.floor(F.col("n") * 0.8))
    tail = attach(tail, {"_m": F.count("vo2_ml_roll")})
    tail = tail.withColumn("_absent", F.col("vo2_ml_roll").isNull())
    tail = rank_rows(tail, ["_absent", "rn"], "_i")
    vo2, power = F.col("vo2_ml_roll"), F.col("power_w_roll")
    early = F.col("_i") <= F.floor(F.col("_m") / 2)
    late = (F.col("_i") > F.floor(F.col("_m") / 2)) & (F.col("_i") <= F.col("_m"))
    found = tail.groupBy(KEY).agg(
        F.count(vo2).alias("_m"), F.count(power).alias("_p"),
        (F.max(power) - F.min(power)).alias("_power_range"),
        (F.max(vo2) - F.min(vo2)).alias("_vo2_range"),
        (F.avg(F.when(late, vo2)) - F.avg(F.when(early, vo2))).alias("_rise"),
    ).where(F.col("_m") >= 10)
    by_power = F.col("_p") >= 10
    flat = F.when(
        by_power, (F.col("_power_range") > 10) & (F.col("_vo2_range") < threshold)
    ).otherwise((F.col("_rise") < threshold) & (F.col("_rise") >= 0))
    delta = F.when(by_power, F.col("_vo2_range")).otherwise(F.col("_rise"))
    return found.select(KEY, flat.alias("_flat"), delta.alias("plateau_delta"))


def assess_maximal_criteria(
    breaths: DataFrame,
    participants: DataFrame,
    reports: DataFrame | None = None,
    rer_threshold: float = 1.10,
    hr_threshold_pct: float = 85.0,
    plateau_threshold: float = 150.0,
) -> DataFrame:
    """Which signs of maximal effort a test shows, from raw peaks.

    ``reports`` optionally holds ``test_id, rpe, lactate``.  A criterion without data is
    null and does not count as available.
    """
    df = prepare(breaths)
    raw = df.groupBy(KEY).agg(*named(_effort_values()))
    out = _effort(raw, df, participants, reports, rer_threshold, hr_threshold_pct, plateau_threshold)
    return out.select(KEY, *EFFORT)


EFFORT = [
    "peak_rer", "rer_met", "peak_hr", "predicted_hr_max", "hr_pct_predicted", "hr_met", "plateau_detected", "plateau_delta",
    "plateau_met", "rpe", "rpe_met", "lactate", "lactate_met", "criteria_met", "criteria_available", "is_maximal", "determination",
]


def _effort_values() -> dict[str, Column]:
    return {"peak_rer": F.max("rer"), "peak_hr": F.max("hr_bpm")}


def _effort(
    raw: DataFrame, rows: DataFrame, participants: DataFrame, reports: DataFrame | None,
    rer_threshold: float = 1.10, hr_threshold_pct: float = 85.0, plateau_threshold: float = 150.0,
) -> DataFrame:
    """Add the effort columns to a per-test frame that has ``_effort_values``."""
    out = raw.join(participants.select(KEY, "age"), KEY, "left")
    out = out.join(_plateau(rows, plateau_threshold), KEY, "left")
    out = out.withColumn("plateau_detected", F.coalesce("_flat", F.lit(False)))
    if reports is None:
        out = out.withColumns({"rpe": F.lit(None).cast("double"), "lactate": F.lit(None).cast("double")})
    else:
        out = out.join(reports.select(KEY, "rpe", "lactate"), KEY, "left")
    hr_max = F.when(F.col("peak_hr").isNotNull(), F.lit(220.0) - F.col("age"))
    out = out.withColumn("predicted_hr_max", hr_max)
    out = out.withColumn("hr_pct_predicted", ratio(F.col("peak_hr") * 100, F.col("predicted_hr_max")))
    out = out.withColumns({
        "rer_met": F.col("peak_rer") >= rer_threshold,
        "hr_met": F.col("hr_pct_predicted") >= hr_threshold_pct,
        "plateau_met": F.col("plateau_detected"),
        "rpe_met": F.col("rpe") >= 17,
        "lactate_met": F.col("lactate") >= 8.0,
    })
    flags = ["rer_met", "hr_met", "plateau_met", "rpe_met", "lactate_met"]
    met, available = F.lit(0), F.lit(0)
    for f in flags:
        met = met + F.coalesce(F.col(f), F.lit(False)).cast("int")
        available = available + F.col(f).isNotNull().cast("int")
    out = out.withColumns({"criteria_met": met, "criteria_available": available})
    count, by_rer = F.col("criteria_met"), F.coalesce(F.col("rer_met"), F.lit(False))
    determination = (
        F.when(count >= 3, "maximal")
        .when((count == 2) & by_rer, "likely_maximal")
        .when(count >= 1, "submaximal")
        .otherwise("indeterminate")
    )
    return out.withColumns({
        "is_maximal": (count >= 3) | ((count >= 2) & by_rer),
        "determination": determination,
    }).drop("age", "_flat")


def exercise_score(criteria: DataFrame) -> DataFrame:
    """Score by determination, +5 for RER >= 1.15, +5 for HR >= 95 %, at most 100."""
    base = (
        F.when(F.col("determination") == "maximal", 100)
        .when(F.col("determination") == "likely_maximal", 85)
        .when(F.col("determination") == "submaximal", 60)
        .otherwise(40)
    )
    bonus = F.when(F.col("peak_rer") >= 1.15, 5).otherwise(0) + F.when(F.col("hr_pct_predicted") >= 95, 5).otherwise(0)
    return criteria.withColumn("exercise_score", F.least(F.lit(100), base + bonus))


# -------------------------------------------------------------- protocol


def exercise_duration(breaths: DataFrame) -> DataFrame:
    """Exercise and warm-up seconds.

    By phase where the test has phases (null if the part is missing), else by power
    above 20 W (more than 10 rows), else all but the first 120 s.
    """
    return breaths.groupBy(KEY).agg(*named(_duration_values())).select(KEY, *named(_duration_columns()))


def _duration_values() -> dict[str, Column]:
    phase, t = F.lower("phase"), F.col("time_s")
    working, easy, loaded = phase.isin(EXERCISE_NAMES), phase.isin(WARMUP_NAMES), F.col("power_w") > 20
    span = lambda c: F.max(F.when(c, t)) - F.min(F.when(c, t))
    return {
        "_phases": F.count("phase"), "_ex": span(working), "_warm": span(easy), "_loaded": F.count_if(loaded),
        "_load_span": span(loaded), "_load_start": F.min(F.when(loaded, t)), "_t0": F.min(t), "_t1": F.max(t),
    }


def _duration_columns() -> dict[str, Column]:
    by_phase, by_power = F.col("_phases") > 0, F.col("_loaded") > 10
    total = F.col("_t1") - F.col("_t0")
    exercise = F.when(by_phase, F.col("_ex")).when(by_power, F.col("_load_span")).otherwise(total - 120)
    warmup = F.when(by_phase, F.col("_warm")).when(by_power, F.col("_load_start") - F.col("_t0")).otherwise(F.lit(120.0))
    return {"exercise_s": exercise, "warmup_s": warmup, "test_s": total}


def loaded_rows(breaths: DataFrame) -> DataFrame:
    """rows under load, with power above 20 W and VO2 present."""
    return breaths.where((F.col("power_w") > 20) & F.col("vo2_ml").isNotNull())


def workload_regression(breaths: DataFrame, expected_slope: float | None = EXPECTED_SLOPE) -> DataFrame:
    """VO2 on power over loaded rows, for tests with at least 30 of them.

    R2 is null for constant VO2.  The caller restricts the result to cycling.
    """
    fit = loaded_rows(breaths).groupBy(KEY).agg(*named(_fit_values())).where(F.col("n_loaded") >= 30)
    return fit.select(KEY, "n_loaded", *named(_fit_columns(F.lit(expected_slope).cast("double"))))


def _fit_values() -> dict[str, Column]:
    loaded = (F.col("power_w") > 20) & F.col("vo2_ml").isNotNull()
    y, x = F.when(loaded, F.col("vo2_ml")), F.when(loaded, F.col("power_w"))
    return {
        "n_loaded": F.count_if(loaded), "_slope": F.regr_slope(y, x),
        "_xx": F.regr_sxx(y, x), "_xy": F.regr_sxy(y, x), "_yy": F.regr_syy(y, x),
    }


def _fit_columns(expected: Column) -> dict[str, Column]:
    xx, xy, yy = F.col("_xx"), F.col("_xy"), F.col("_yy")
    explained = F.when(xx > 0, xy * xy / F.nullif(xx, F.lit(0.0))).otherwise(0.0)
    deviation = ratio((F.col("_slope") - expected) * 100, expected)
    return {
        "slope": F.col("_slope"), "r_squared": F.when(yy > 0, explained / F.nullif(yy, F.lit(0.0))),
        "slope_deviation_pct": deviation, "slope_acceptable": F.abs(deviation) <= 15,
    }


def _level_rows(breaths: DataFrame) -> DataFrame:
    return power_levels(breaths.where(F.col("power_w") > 0)).where(F.col("power_rounded") > 0)


def expected_vo2_by_level(breaths: DataFrame, expected_slope: float = EXPECTED_SLOPE) -> DataFrame:
    """A10: mean VO2 per power level against rest + slope * power, levels of >= 5 rows."""
    levels = _level_rows(breaths).groupBy(KEY, F.col("power_rounded").alias("power_level_w")).agg(
        F.avg("vo2_ml").alias("actual_vo2"), F.count(F.lit(1)).alias("n_breaths")
    ).where(F.col("n_breaths") >= 5)
    levels = levels.withColumn("expected_vo2", F.lit(REST_VO2) + F.col("power_level_w") * expected_slope)
    deviation = ratio((F.col("actual_vo2") - F.col("expected_vo2")) * 100, F.col("expected_vo2"))
    return levels.withColumn("deviation_pct", deviation)


def stage_consistency(breaths: DataFrame) -> DataFrame:
    """Number of power levels with >= 5 rows and their mean coefficient of variation."""
    levels = _level_rows(breaths).groupBy(KEY, "power_rounded").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("vo2_ml").alias("_mean"), F.stddev_samp("vo2_ml").alias("_sd")
    ).where(F.col("_n") >= 5)
    cv = ratio(F.col("_sd") * 100, F.col("_mean"))
    return levels.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_stages"), F.avg(cv).alias("stage_cv"))


def assess_protocol_quality(
    breaths: DataFrame,
    tests: DataFrame,
    modality: str = "auto",
    expected_slope: float | None = None,
) -> DataFrame:
    """Slope, linearity, stage consistency, duration and warm-up, scored to 100.

    The lowest possible score is 40, so ``unable_to_assess`` never occurs in practice.
    """
    facts = breaths.groupBy(KEY).agg(*named(_protocol_values()))
    return _protocol(facts, breaths, tests, modality, expected_slope).select(KEY, *PROTOCOL)


PROTOCOL = [
    "modality", "expected_slope", "slope", "slope_deviation_pct", "slope_acceptable", "r_squared", "r_squared_acceptable",
    "n_stages", "stage_cv", "stage_cv_acceptable", "test_s", "exercise_s", "duration_optimal", "warmup_s", "warmup_adequate",
    "protocol_score", "protocol_rating",
]


def _protocol_values() -> dict[str, Column]:
    powers = {"_np": F.count("power_w"), "_top": F.max("power_w")}
    return {**powers, **_duration_values(), **_fit_values()}


def _protocol(
    facts: DataFrame, rows: DataFrame, tests: DataFrame, modality: str = "auto", expected_slope: float | None = None
) -> DataFrame:
    """Add the protocol columns to a per-test frame that has ``_protocol_values``."""
    out = facts.join(tests.select(KEY, "protocol"), KEY, "left").join(stage_consistency(rows), KEY, "left")
    found = test_modality(F.col("protocol"), F.col("_np"), F.col("_top")) if modality == "auto" else F.lit(modality)
    out = out.withColumn("modality", found)
    cycling = F.col("modality") == "cycling"
    given = F.lit(expected_slope).cast("double")
    out = out.withColumn("expected_slope", F.coalesce(given, F.when(cycling, F.lit(EXPECTED_SLOPE))))
    fitted = cycling & (F.col("n_loaded") >= 30)
    fit = _fit_columns(F.col("expected_slope"))
    out = out.withColumns({**_duration_columns(), **{name: F.when(fitted, c) for name, c in fit.items()}})
    out = out.withColumns({
        "r_squared_acceptable": F.col("r_squared").isNotNull() & (F.col("r_squared") >= 0.90),
        "stage_cv_acceptable": F.col("stage_cv").isNotNull() & (F.col("stage_cv") <= 10),
        "duration_optimal": F.coalesce(F.col("exercise_s").between(480, 720), F.lit(False)),
        "warmup_adequate": F.coalesce(F.col("warmup_s") >= 120, F.lit(False)),
    })
    score = (
        F.when(F.col("slope_acceptable"), 25).when(F.col("slope_acceptable").isNotNull(), 10).otherwise(15)
        + F.when(F.col("r_squared_acceptable"), 25).when(F.col("r_squared").isNotNull(), 10).otherwise(15)
        + F.when(F.col("stage_cv_acceptable"), 15).when(F.col("stage_cv").isNotNull(), 5).otherwise(10)
        + F.when(F.col("duration_optimal"), 20).otherwise(10)
        + F.when(F.col("warmup_adequate"), 15).otherwise(5)
    )
    out = out.withColumn("protocol_score", score)
    verdict = F.when(F.col("protocol_score") >= 40, rating(F.col("protocol_score"))).otherwise("unable_to_assess")
    return out.withColumn("protocol_rating", verdict)


# ------------------------------------------------------------------ data


def baseline_stability(breaths: DataFrame) -> DataFrame:
    """CV of VO2 over >= 10 rest rows, else over the first 2 min (>= 10 rows), else null."""
    return prepare(breaths).groupBy(KEY).agg(*named(_baseline_values())).select(KEY, *named(_baseline_columns()))


def _baseline_values() -> dict[str, Column]:
    parts = {"rest": F.lower("phase").isin(BASELINE_NAMES), "early": F.col("time_s") <= F.col("t_first") + 120}
    values = {}
    for name, inside in parts.items():
        vo2 = F.when(inside, F.col("vo2_ml"))
        values[f"_n_{name}"] = F.count_if(F.coalesce(inside, F.lit(False)))
        values[f"_cv_{name}"] = ratio(F.stddev_samp(vo2) * 100, F.avg(vo2))
    return values


def _baseline_columns() -> dict[str, Column]:
    cv = F.when(F.col("_n_rest") >= 10, F.col("_cv_rest")).when(F.col("_n_early") >= 10, F.col("_cv_early"))
    return {"baseline_cv": cv}


def calibration_drift(breaths: DataFrame) -> DataFrame:
    """Significant RER trend above 0.001 per second over >= 20 rest rows.

    Significance is a two-sided p value below 5 %; that of a perfect fit is 0.
    """
    return breaths.groupBy(KEY).agg(*named(_drift_values())).select(KEY, *named(_drift_columns()))


def _drift_values() -> dict[str, Column]:
    rest = F.lower("phase").isin(DRIFT_NAMES)
    rer, t = F.when(rest, F.col("rer")), F.when(rest, F.col("time_s"))
    return {
        "_rest": F.count_if(F.coalesce(rest, F.lit(False))), "_dn": F.regr_count(rer, t),
        "_dxx": F.regr_sxx(rer, t), "_dxy": F.regr_sxy(rer, t), "_dyy": F.regr_syy(rer, t),
    }


def _drift_columns() -> dict[str, Column]:
    xx, xy, yy = F.nullif("_dxx", F.lit(0.0)), F.col("_dxy"), F.col("_dyy")
    slope, freedom, enough = xy / xx, F.nullif(F.col("_dn") - 2, F.lit(0)), F.col("_rest") >= 20
    se = F.sqrt(F.greatest(yy - xy * xy / xx, F.lit(0.0)) / freedom / xx)
    t = F.when(slope == 0, 0.0).when(se == 0, float("inf")).otherwise(slope / F.nullif(se, F.lit(0.0)))
    p_value = F.when(enough, t_p_value(t, freedom))
    drift = (F.abs(slope) > 0.001) & (p_value < 0.05)
    return {
        "n_rest": F.col("_rest"), "rest_slope": F.when(enough, slope), "p_value": p_value,
        "drift_detected": F.coalesce(drift, F.lit(False)),
    }


def missing_signals(breaths: DataFrame) -> DataFrame:
    """A15 (data quality part): missing heart rate and power; null if never recorded."""
    return breaths.groupBy(KEY).agg(*named(_missing_values())).select(KEY, *named(_missing_columns()))


def _missing_values() -> dict[str, Column]:
    return {"_rows": F.count(F.lit(1)), "_hr": F.count("hr_bpm"), "_power": F.count("power_w")}


def _missing_columns() -> dict[str, Column]:
    rows = F.col("_rows")
    columns = {"n_breaths": rows}
    for c in ("hr", "power"):
        missing = F.when(F.col(f"_{c}") > 0, rows - F.col(f"_{c}"))
        columns[f"n_missing_{c}"] = missing
        columns[f"pct_missing_{c}"] = missing * 100 / rows
    return columns


def signal_score(pct_aberrant: Column, pct_missing_hr: Column, baseline_cv: Column) -> Column:
    """Signal quality score."""
    return tally(
        steps(pct_aberrant, (10, 40), (5, 20), (2, 10)),
        steps(pct_missing_hr, (20, 30), (10, 15), (5, 5)),
        steps(baseline_cv, (20, 30), (15, 20), (10, 10)),
    )


def overall_data_score(
    pct_aberrant: Column, pct_missing_hr: Column, pct_missing_power: Column, baseline_cv: Column, drift: Column
) -> Column:
    """Overall data quality score."""
    return tally(
        steps(pct_aberrant, (10, 30), (5, 15), (2, 5)),
        steps(pct_missing_hr, (20, 25), (10, 15), (5, 5)),
        steps(pct_missing_power, (20, 15), (10, 10), (5, 5)),
        steps(baseline_cv, (20, 20), (15, 15), (10, 10)),
        F.when(drift, 10).otherwise(0),
    )


def recommendations(
    pct_aberrant: Column, pct_missing_hr: Column, pct_missing_power: Column, baseline_cv: Column, drift: Column
) -> Column:
    """C11: recommendation codes; ``acceptable`` if there is nothing to recommend."""
    found = F.array_compact(F.array(
        F.when(pct_aberrant > 5, "filter_aberrant_breaths"),
        F.when(pct_missing_hr > 10, "check_hr_monitor"),
        F.when(pct_missing_power > 10, "check_ergometer"),
        F.when(baseline_cv > 15, "stabilise_baseline"),
        F.when(drift, "recalibrate"),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("acceptable"))).otherwise(found)


def assess_data_quality(breaths: DataFrame, aberrant_threshold: float = 3.0) -> DataFrame:
    """Aberrant breaths, missing signals, baseline and drift, with both scores.

    The time stamps of the aberrant breaths are a table of their own
    (``rolling.aberrant_breaths``), since their number grows with the test.
    """
    scored = outlier_scores(prepare(breaths))
    return _data(scored.groupBy(KEY).agg(*named(_data_values(aberrant_threshold)))).select(KEY, *DATA)


DATA = [
    "n_breaths", "n_aberrant", "pct_aberrant", "aberrant_acceptable", "n_missing_hr", "pct_missing_hr", "hr_acceptable",
    "n_missing_power", "pct_missing_power", "baseline_cv", "baseline_stable", "drift_detected", "signal_score", "signal_rating",
    "data_score", "data_rating", "recommendations",
]


def _data_values(aberrant_threshold: float = 3.0) -> dict[str, Column]:
    flagged = {"n_aberrant": F.count_if(F.col("z") > aberrant_threshold)}
    return {**flagged, **_missing_values(), **_baseline_values(), **_drift_values()}


def _data(facts: DataFrame) -> DataFrame:
    """Add the data quality columns to a per-test frame that has ``_data_values``."""
    out = facts.withColumns({**_missing_columns(), **_baseline_columns(), **_drift_columns()})
    out = out.withColumn("pct_aberrant", F.col("n_aberrant") * 100 / F.col("n_breaths"))
    ab, hr, power, cv, drift = (
        F.col(c) for c in ("pct_aberrant", "pct_missing_hr", "pct_missing_power", "baseline_cv", "drift_detected")
    )
    out = out.withColumns({
        "aberrant_acceptable": ab <= 5,
        "hr_acceptable": hr <= 10,
        "baseline_stable": F.coalesce(cv <= 10, F.lit(False)),
        "signal_score": signal_score(ab, hr, cv),
        "data_score": overall_data_score(ab, hr, power, cv, drift),
        "recommendations": recommendations(ab, hr, power, cv, drift),
    })
    return out.withColumns({
        "signal_rating": rating(F.col("signal_score")), "data_rating": rating(F.col("data_score"))
    })


# --------------------------------------------------------------- overall


def quality_summary(criteria_met: Column, criteria_available: Column) -> Column:
    """C14: one line with the grade first, then what it rests on; ratings and verdict are given as codes."""
    use = F.when(F.col("grade").isin("A", "B", "C"), "usable").when(F.col("grade") == "D", "use with care").otherwise("do not rely on it")
    return F.concat(
        F.lit("Grade "), F.col("grade"), F.lit(", "), use,
        F.lit(": effort "), F.col("determination"), F.lit(" by "), criteria_met.cast("string"), F.lit(" of "), criteria_available.cast("string"),
        F.lit(" signs, recording "), F.col("data_rating"), F.lit(", course "), F.col("protocol_rating"),
    )


def assess_quality(
    breaths: DataFrame, participants: DataFrame, tests: DataFrame, reports: DataFrame | None = None
) -> DataFrame:
    """40 % effort, 30 % protocol, 30 % data; grade, interpretability and summary."""
    df = prepare(breaths)
    values = {**_effort_values(), **_protocol_values(), **_data_values()}
    facts = outlier_scores(df).groupBy(KEY).agg(*named(values))
    out = _data(_protocol(exercise_score(_effort(facts, df, participants, reports)), df, tests))
    score = F.col("exercise_score") * 0.40 + F.col("protocol_score") * 0.30 + F.col("data_score") * 0.30
    out = out.withColumn("overall_score", score)
    s = F.col("overall_score")
    grade = F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")
    out = out.withColumns({"grade": grade, "interpretable": (s >= 60) & (F.col("data_rating") != "poor")})
    out = out.withColumn("summary", quality_summary(F.col("criteria_met"), F.col("criteria_available")))
    overall = ["exercise_score", "overall_score", "grade", "interpretable", "summary"]
    return out.select(KEY, *EFFORT, *PROTOCOL, *DATA, *overall)
