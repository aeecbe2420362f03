"""Validation of a test before analysis (C1 and its checks, S9, S10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import KEY, REQUIRED, named
from .layout import framed, prepare
from .rolling import outlier_scores


def _codes(*pairs: tuple[Column, str]) -> Column:
    """Codes of the conditions that hold; null conditions do not."""
    return F.array_compact(F.array(*[F.when(c, code) for c, code in pairs]))


def rest_phase_check(breaths: DataFrame, participants: DataFrame, rest_minutes: float = 2.0) -> DataFrame:
    """Presence, length, VO2 and RER of the rest phase.

    Tests without any phase use the first minutes as a proxy for RER only.
    """
    facts = prepare(breaths).groupBy(KEY).agg(*named(_rest_values(rest_minutes)))
    facts = facts.join(participants.select(KEY, "weight_kg"), KEY, "left")
    return facts.select(KEY, "rest_rows", "rest_min", "rest_vo2", "rest_rer", *named(_rest_columns(rest_minutes)))


def _rest_values(rest_minutes: float) -> dict[str, Column]:
    rest = F.coalesce(F.lower("phase") == "rest", F.lit(False))
    early = F.col("time_s") < F.col("t_first") + F.lit(rest_minutes * 60)
    t = F.when(rest, F.col("time_s"))
    return {
        "_phases": F.count("phase"), "rest_rows": F.count_if(rest), "rest_min": (F.max(t) - F.min(t)) / 60,
        "rest_vo2": F.avg(F.when(rest, F.col("vo2_ml"))), "rest_rer": F.avg(F.when(rest, F.col("rer"))),
        "_early_rer": F.avg(F.when(early, F.col("rer"))),
    }


def _rest_columns(rest_minutes: float) -> dict[str, Column]:
    has, normal = F.col("_phases") > 0, F.col("weight_kg") * 3.5
    warnings = _codes(
        (has & (F.col("rest_rows") == 0), "no_rest_phase"),
        (has & (F.col("rest_min") < rest_minutes), "rest_too_short"),
        (has & (F.col("rest_vo2") < normal * 0.5), "rest_vo2_low"),
        (has & (F.col("rest_vo2") > normal * 1.5), "rest_vo2_high"),
        (has & ((F.col("rest_rer") < 0.70) | (F.col("rest_rer") > 0.90)), "rest_rer_unusual"),
    )
    info = _codes((has & (F.col("rest_rows") > 0), "rest_phase"), (~has, "early_rer_only"))
    return {"early_rer": F.when(~has, F.col("_early_rer")), "rest_warnings": warnings, "rest_info": info}


_RANGES = ["vo2_min", "vo2_max", "rer_min", "rer_max", "hr_min", "hr_max", "ve_max"]


def physiological_check(breaths: DataFrame, participants: DataFrame) -> DataFrame:
    """Implausible VO2, RER, heart rate and ventilation."""
    facts = breaths.groupBy(KEY).agg(*named(_range_values())).join(participants.select(KEY, "age"), KEY, "left")
    return facts.select(KEY, *_RANGES, *named(_range_columns()))


def _range_values() -> dict[str, Column]:
    return {
        "vo2_min": F.min("vo2_ml"), "vo2_max": F.max("vo2_ml"), "rer_min": F.min("rer"), "rer_max": F.max("rer"),
        "hr_min": F.min("hr_bpm"), "hr_max": F.max("hr_bpm"), "ve_max": F.max("ve_l"),
    }


def _range_columns() -> dict[str, Column]:
    return {
        "range_errors": _codes((F.col("vo2_min") < 0, "negative_vo2")),
        "range_warnings": _codes(
            (F.col("vo2_max") > 7000, "very_high_vo2"),
            ((F.col("rer_min") < 0.5) | (F.col("rer_max") > 1.5), "rer_out_of_range"),
            (F.col("hr_min") < 30, "very_low_hr"), (F.col("hr_max") > 220, "very_high_hr"),
            (F.col("ve_max") > 200, "very_high_ve"),
        ),
        "range_info": _codes(
            (F.col("hr_max") > F.lit(220.0) - F.col("age") + 20, "hr_above_predicted"),
            (F.col("vo2_min").isNotNull(), "vo2_range"), (F.col("rer_min").isNotNull(), "rer_range"),
        ),
    }


_SHARES = ["hr_bpm", "power_w", *REQUIRED]


def completeness_check(breaths: DataFrame) -> DataFrame:
    """A15 (validation part): share of missing heart rate, power and required values."""
    facts = breaths.groupBy(KEY).agg(*named(_share_values()))
    return facts.select(KEY, *[f"missing_{c}" for c in _SHARES], *named(_share_columns()))


def _share_values() -> dict[str, Column]:
    shares = {f"missing_{c}": F.count_if(F.col(c).isNull()) * 100 / F.count(F.lit(1)) for c in _SHARES}
    return {**shares, "_hr": F.count("hr_bpm"), "_power": F.count("power_w")}


def _share_columns() -> dict[str, Column]:
    has_hr, has_power = F.col("_hr") > 0, F.col("_power") > 0
    return {
        "missing_warnings": _codes(
            (has_hr & (F.col("missing_hr_bpm") > 10), "hr_missing"),
            *[(F.col(f"missing_{c}") > 0, f"{c}_missing") for c in REQUIRED],
        ),
        "missing_info": _codes((~has_hr, "no_hr"), (has_power & (F.col("missing_power_w") > 10), "power_missing")),
    }


def effort_check(breaths: DataFrame, participants: DataFrame) -> DataFrame:
    """Effort level by peak RER and by heart rate relative to 220 - age."""
    facts = breaths.groupBy(KEY).agg(F.max("rer").alias("peak_rer"), F.max("hr_bpm").alias("peak_hr"))
    facts = facts.join(participants.select(KEY, "age"), KEY, "left")
    return facts.select(KEY, "peak_rer", "peak_hr", *named(_effort_columns(F.col("peak_rer"), F.col("peak_hr"))))


def _effort_columns(r: Column, peak_hr: Column) -> dict[str, Column]:
    h = ratio(peak_hr * 100, F.lit(220.0) - F.col("age"))
    return {
        "hr_pct": h,
        "rer_effort": F.when(r >= 1.15, "strong").when(r >= 1.10, "good").when(r >= 1.05, "moderate").otherwise("submaximal"),
        "hr_effort": F.when(h >= 95, "maximal").when(h >= 85, "near_maximal").when(h.isNotNull(), "submaximal"),
    }


def duration_check(breaths: DataFrame) -> DataFrame:
    """Fewer than 10 rows is an error, less than 5 minutes a warning."""
    facts = breaths.groupBy(KEY).agg(*named(_length_values()))
    return facts.select(KEY, "n_breaths", "duration_min", *named(_length_columns()))


def _length_values() -> dict[str, Column]:
    return {"n_breaths": F.count(F.lit(1)), "duration_min": (F.max("time_s") - F.min("time_s")) / 60}


def _length_columns() -> dict[str, Column]:
    return {
        "length_errors": _codes((F.col("n_breaths") < 10, "too_few_breaths")),
        "length_warnings": _codes((F.col("duration_min") < 5, "short_test")),
    }


def validate(
    breaths: DataFrame, participants: DataFrame, rest_minutes: float = 2.0, aberrant_threshold: float = 3.0
) -> DataFrame:
    """Seven checks; arrays of finding codes and ``is_valid`` (no errors).

    All checks are aggregates, taken in one pass over the rows.
    """
    values = {
        **_length_values(), **_rest_values(rest_minutes), **_range_values(), **_share_values(),
        "n_aberrant": F.count_if(F.col("z") > aberrant_threshold),
    }
    out = outlier_scores(prepare(breaths), "validate").groupBy(KEY).agg(*named(values))
    out = out.join(participants.select(KEY, "age", "weight_kg"), KEY, "left")
    out = out.withColumns({
        **_length_columns(), **_rest_columns(rest_minutes), **_range_columns(), **_share_columns(),
        **_effort_columns(F.col("rer_max"), F.col("hr_max")), "pct_aberrant": F.col("n_aberrant") * 100 / F.col("n_breaths"),
    })
    many, some = F.col("pct_aberrant") > 5, (F.col("n_aberrant") > 0) & (F.col("pct_aberrant") <= 5)
    errors = F.concat("length_errors", "range_errors")
    warnings = F.concat("length_warnings", "rest_warnings", "range_warnings", _codes((many, "many_aberrant")), "missing_warnings")
    info = F.concat(
        F.array(F.lit("test_duration")), "rest_info", "range_info", _codes((some, "some_aberrant")), "missing_info",
        F.array_compact(F.array(
            F.concat(F.lit("rer_effort_"), F.col("rer_effort")), F.concat(F.lit("hr_effort_"), F.col("hr_effort"))
        )),
    )
    return out.select(
        KEY, (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"),
        info.alias("info"), "duration_min", "n_aberrant", "pct_aberrant",
    )


def order_audit(breaths: DataFrame) -> DataFrame:
    """Per test, missing required columns and steps back in time.

    ``breaths`` must carry ``rn`` in recorded order (not re-sorted by time).  Absent
    columns are found from the schema; a column that is null throughout a test counts
    as missing from it.
    """
    missing = [c for c in REQUIRED if c not in breaths.columns]
    lag = lambda part: {"_prev": F.lag("time_s").over(W.partitionBy(*part).orderBy("rn"))}
    df = framed(breaths, lag, 1) if "time_s" not in missing else breaths.withColumn("_prev", F.lit(None))
    back = F.count_if(F.col("time_s") < F.col("_prev")) if "time_s" not in missing else F.lit(0)
    present = [c for c in REQUIRED if c not in missing]
    absent = [F.when(F.count(c) == 0, c) for c in present]
    return df.groupBy(KEY).agg(
        F.array_compact(F.array(*[F.lit(c) for c in missing], *absent)).alias("missing_columns"),
        back.alias("steps_back"),
    ).withColumn("is_ordered", F.col("steps_back") == 0)


# Allowed range of each numeric property, by table.
RANGES: dict[str, list[tuple[str, float, float]]] = {
    "participants": [("age", 0, 120), ("height_cm", 50, 250), ("weight_kg", 10, 300)],
    "tests": [("temperature_c", 10, 40), ("pressure_mmhg", 600, 900), ("humidity_pct", 0, 100)],
    "pretest": [("last_meal_hours", 0, 48), ("caffeine_mg", 0, 1000)],
    "protocol": [("stage_duration_s", 30, 600)],
    "economy": [("gross_efficiency", 10, 35), ("running_economy", 100, 350)],
    "peaks": [
        ("vo2_peak", 0, 8000), ("vo2_kg_peak", 0, 100), ("ve_peak", 0, 250), ("rer_peak", 0.5, 2),
        ("hr_peak", 30, 250), ("power_peak", 0, 600), ("speed_peak", 0, 40),
    ],
    "quality": [
        ("peak_rer", 0.5, 2), ("rpe", 6, 20), ("lactate", 0, 30),
        ("overall_score", 0, 100), ("protocol_score", 0, 100), ("data_score", 0, 100), ("r_squared", 0, 1), ("pct_aberrant", 0, 100),
        ("pct_missing_hr", 0, 100), ("pct_missing_power", 0, 100), ("signal_score", 0, 100),
    ],
}

# Allowed codes of each text property, by table.
CODES: dict[str, dict[str, list[str]]] = {
    "participants": {"sex": ["M", "F", "O"]},
    "tests": {},
    "pretest": {"nutritional_state": ["fed", "fasted"], "fatigue_state": ["rested", "fatigued"]},
    "protocol": {"modality": ["cycling", "treadmill", "other"]},
    "economy": {"modality": ["cycling", "treadmill"]},
    "peaks": {},
    "quality": {
        "grade": ["A", "B", "C", "D", "F"],
        "determination": ["maximal", "likely_maximal", "submaximal", "indeterminate"],
        "protocol_rating": ["excellent", "good", "acceptable", "poor", "unable_to_assess"],
        "signal_rating": ["excellent", "good", "acceptable", "poor"],
        "data_rating": ["excellent", "good", "acceptable", "poor"],
    },
}


def range_audit(df: DataFrame, table: str) -> DataFrame:
    """One row per value of ``df`` outside the allowed range or code list of ``table``."""
    checks = []
    for c, low, high in RANGES[table]:
        if c in df.columns:
            value = F.col(c).cast("double")
            checks.append(F.when((value < low) | (value > high), F.struct(F.lit(c).alias("property"), value.cast("string").alias("value"))))
    for c, allowed in CODES[table].items():
        if c in df.columns:
            checks.append(F.when(~F.col(c).isin(allowed), F.struct(F.lit(c).alias("property"), F.col(c).alias("value"))))
    found = df.select(KEY, F.explode(F.array_compact(F.array(*checks))).alias("_found"))
    return found.select(KEY, F.lit(table).alias("source"), "_found.property", "_found.value")
