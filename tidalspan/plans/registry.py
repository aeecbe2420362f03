"""One runnable query per operator, over tests derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fx
from ..functions import sql_functions
from ..operators import averaging, economy, labels, norms, peaks, quality, rolling, stages, thresholds, validation
from ..operators.layout import prepare, rank_rows
from ..schema import KEY
from ..shared import keep, new_folder
from ..sources import export, grid, ledger, store
from ..sources import stand_ins as src
from . import analysis, batch, report, series, smooth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def out(df: DataFrame, *columns: str | Column, digits: int = 4) -> DataFrame:
    """Chosen columns (all if none), floating point values rounded.

    Rounding is that of ``settled``.
    """
    df = df.select(*columns) if columns else df
    return df.select(*[fx.settled(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def breaths(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(src.breaths(spark, folder))


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


SIGNALS = ["vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "speed_kmh", "peto2_mmhg", "petco2_mmhg"]
ROW = [KEY, "rn"]


# ---------------------------------------------------------- sources and sinks


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder."""
    return new_folder(spark, "scratch")


@query("s1_read_grids")
def _(s, d):
    path = scratch_folder(s)
    sheets = src.grids(s, d).select(KEY, "row", F.array_join("cells", ",").alias("line"))
    sheets = sheets.repartition(KEY).sortWithinPartitions(KEY, "row").select(KEY, "line")
    sheets.write.partitionBy(KEY).text(path)
    grids = grid.read_grids(s, path)
    key = F.regexp_extract(KEY, r"test_id=(\d+)", 1).cast("bigint").alias(KEY)
    filled = F.size(F.filter("cells", lambda c: c.isNotNull() & (c != "")))
    return grids.select(key, F.col("row").cast("bigint").alias("row"), filled.cast("bigint").alias("filled"))


def _write_sheets(sheets: DataFrame, path: str) -> None:
    """One CSV file per test; a test that is there already is replaced."""
    lines = sheets.select(KEY, "row", F.array_join("cells", ",").alias("line")).repartition(KEY).sortWithinPartitions(KEY, "row").select(KEY, "line")
    writer = lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY)
    writer.options(sep="\u0001", quote="\u0000", emptyValue="", ignoreLeadingWhiteSpace=False).csv(path)


@query("s1_incremental_ingest")
def _(s, d):
    """Even tests first, those divisible by ten cut short; then the odd ones, and the cut ones again in full."""
    exports, store, sheets = scratch_folder(s), scratch_folder(s), src.grids(s, d)
    number = lambda path: F.regexp_extract(path, r"test_id=(\d+)", 1)
    later = (F.col(KEY) % 2 == 1) | (F.col(KEY) % 10 == 0)
    _write_sheets(sheets.where((F.col(KEY) % 2 == 0) & ((F.col(KEY) % 10 != 0) | (F.col("row") <= 20))), exports)
    ledger.ingest_new(s, exports, store, number)
    _write_sheets(sheets.where(later), exports)
    ledger.ingest_new(s, exports, store, number)
    rows = ledger.current(s, store, "breaths").withColumn(KEY, F.col(KEY).cast("bigint"))
    return out(rows, KEY, "batch", (F.col("source_row") - 3).alias("rn"), "time_s", "vo2_ml", "rer", "phase")


@query("s2_participants_from_grid")
def _(s, d):
    return out(grid.parse_participants(src.grids(s, d)), KEY, "participant_id", "name", "sex", "age", "height_cm", "weight_kg")


@query("s3_tests_from_grid")
def _(s, d):
    parsed = grid.parse_tests(src.grids(s, d), date(2024, 1, 1))
    return out(parsed, KEY, F.date_format("test_date", "yyyy-MM-dd").alias("test_date"), "device", "protocol",
               "temperature_c", "pressure_mmhg", "humidity_pct")


@query("s4_breaths_from_grid")
def _(s, d):
    parsed = grid.parse_breaths(src.grids(s, d))
    return out(parsed, KEY, (F.col("source_row") - 3).alias("rn"), "time_s", "vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "phase")


@query("s5_day_fraction_time")
def _(s, d):
    df = src.breaths(s, d)
    days = F.when(F.col(KEY) % 2 == 1, F.col("time_s") / 86400).otherwise(F.col("time_s"))
    return out(grid.repair_time(df.withColumn("time_s", days)), *ROW, "time_s")


@query("s6_format_routing")
def _(s, d):
    ending = F.when(F.col(KEY) % 9 == 0, "txt").otherwise("csv")
    return grid.detect_format(src.grids(s, d).withColumn("extension", ending)).select(KEY, "format", "supported")


@query("s7_data_type")
def _(s, d):
    return out(grid.detect_data_type(breaths(s, d)))


@query("s8_export_breaths")
def _(s, d):
    path = scratch_folder(s)
    export.export_breaths(src.breaths(s, d), path, "parquet")
    return out(s.read.parquet(path), *ROW, "time_s", "vo2_ml", "phase")


def _stored(s: SparkSession, rows: DataFrame) -> str:
    """A store of all tests in a new folder; its name."""
    name = "store_" + uuid.uuid4().hex
    store.create(rows, name, scratch_folder(s), folders=16, buckets=4, row_group_bytes=1 << 18)
    return name


@query("s8_replaced_tests")
def _(s, d):
    """Every twentieth test comes again: one millilitre more, and without its first breath."""
    rows = breaths(s, d).drop("split", "chunk")
    name = _stored(s, rows)
    again = rows.where((F.col(KEY) % 20 == 0) & (F.col("rn") > 1)).withColumn("vo2_ml", F.col("vo2_ml") + 1)
    store.replace_tests(again, name)
    return out(s.table(name), *ROW, "time_s", "vo2_ml", "phase")


@query("s8_point_lookup")
def _(s, d):
    """A handful of tests out of the whole store."""
    name = _stored(s, breaths(s, d).drop("split", "chunk"))
    return out(store.read_tests(s, name, [1, 8, 13, 40, 10**12]), *ROW, "time_s", "vo2_ml", "phase")


@query("s8_stored_join")
def _(s, d):
    """Rows that two versions of a store have in common, and how they differ, test by test."""
    rows = breaths(s, d).drop("split", "chunk")
    old, new = _stored(s, rows), _stored(s, rows.where(F.col("rn") % 7 != 0).withColumn("ve_l", F.col("ve_l") + F.col("rn") % 3))
    both = store.compare(s.table(old), s.table(new), ["ve_l"])
    return out(both.groupBy(KEY).agg(F.count("*").alias("n_common"), F.count_if(F.col("ve_l_old") != F.col("ve_l_new")).alias("n_changed"),
                                     F.sum(F.col("ve_l_new") - F.col("ve_l_old")).alias("change")))


@query("s9_order_audit")
def _(s, d):
    # Event order is the recorded order; every 13th event is stamped 60 s early.
    df = src.breaths(s, d)
    stamped = F.when(F.col("rn") % 13 == 0, F.col("time_s") - 60).otherwise(F.col("time_s"))
    audit = validation.order_audit(df.withColumn("time_s", stamped))
    return audit.select(KEY, joined("missing_columns"), F.col("steps_back").cast("bigint").alias("steps_back"), "is_ordered")


@query("s10_range_audit")
def _(s, d):
    found = validation.range_audit(src.tests(s, d), "tests").unionByName(validation.range_audit(src.pretest(s, d), "pretest"))
    found = found.unionByName(validation.range_audit(src.participants(s, d), "participants"))
    eco = src.participants(s, d).select(
        KEY, fx.gross_efficiency(F.col("height_cm") * 20, F.col("age") * 4, F.lit(0.9)).alias("gross_efficiency")
    )
    # Values that leave every range for some tests.
    key, tall = F.col(KEY), F.col("height_cm")
    peak = src.participants(s, d).select(
        KEY, (tall * 50).alias("vo2_peak"), (tall / 2).alias("vo2_kg_peak"), (tall * 1.5).alias("ve_peak"), (key % 30 / 10).alias("rer_peak"),
        (key % 280).cast("double").alias("hr_peak"), (tall * 4 - 50).alias("power_peak"), (key % 45).cast("double").alias("speed_peak"))
    grade = src.reports(s, d).select(
        KEY, (key % 30 / 10).alias("peak_rer"), (F.col("rpe") + key % 3 * 4).alias("rpe"), (F.col("lactate") * 3).alias("lactate"),
        (key % 110).cast("double").alias("overall_score"), (key % 13 / 10).alias("r_squared"), F.get(F.split(F.lit("A,B,C,D,F,E"), ","), key % 6).alias("grade"),
        F.get(F.split(F.lit("excellent,good,acceptable,poor,unable_to_assess,fair"), ","), key % 6).alias("protocol_rating"),
        F.get(F.split(F.lit("excellent,good,acceptable,poor,unable_to_assess,fair"), ","), key % 6).alias("data_rating"))
    plan = src.tests(s, d).select(KEY, (key % 80 * 10).cast("double").alias("stage_duration_s"), F.get(F.split(F.lit("cycling,treadmill,other,rowing"), ","), key % 4).alias("modality"))
    for table, df in (("economy", eco), ("peaks", peak), ("quality", grade), ("protocol", plan)):
        found = found.unionByName(validation.range_audit(df, table))
    number = F.col("value").try_cast("double")
    return found.select(KEY, "source", "property", F.round(number, 4).alias("value"), F.when(number.isNull(), F.col("value")).alias("code"))


# ------------------------------------------- projections and scalar expressions


@query("p1_ventilatory_equivalents")
def _(s, d):
    return out(src.breaths(s, d), *ROW, fx.ve_vo2().alias("ve_vo2"), fx.ve_vco2().alias("ve_vco2"))


@query("p2_o2_pulse")
def _(s, d):
    return out(src.breaths(s, d), *ROW, fx.o2_pulse(F.col("vo2_ml"), F.col("hr_bpm")).alias("o2_pulse"))


@query("p3_time_axis")
def _(s, d):
    return out(series.with_time_axis(breaths(s, d)), *ROW, "time_unit", "time_plot")


@query("p4_weight_normalised_vo2")
def _(s, d):
    return out(series.weight_normalised(src.breaths(s, d), src.participants(s, d)), *ROW, "vo2_per_kg")


@query("p5_bmi")
def _(s, d):
    return src.participants(s, d).select(KEY, F.bround(fx.bmi(F.col("weight_kg"), F.col("height_cm")), 1).alias("bmi"))


@query("p6_running_economy")
def _(s, d):
    df = series.weight_normalised(src.breaths(s, d), src.participants(s, d))
    return df.select(*ROW, fx.running_economy(F.col("vo2_per_kg"), F.col("speed_kmh")).alias("running_economy"))


@query("p7_gross_efficiency")
def _(s, d):
    ge = fx.gross_efficiency(F.col("vo2_ml"), F.col("power_w"), F.col("rer"))
    return src.breaths(s, d).select(*ROW, ge.alias("gross_efficiency"))


@query("p8_predicted_values")
def _(s, d):
    return out(norms.with_predicted(src.participants(s, d)), KEY, "pred_hr", "pred_vo2_kg", "pred_vo2", "pred_ve",
               "pred_power", "pred_o2_pulse")


@query("p9_age_group")
def _(s, d):
    return norms.with_age_group(src.participants(s, d)).select(KEY, "age_group", "age_midpoint")


@query("p10_rating")
def _(s, d):
    return src.tests(s, d).select(KEY, fx.rating(F.col("humidity_pct")).alias("rating"))


@query("p12_modality")
def _(s, d):
    shape = src.breaths(s, d).groupBy(KEY).agg(F.count("power_w").alias("n"), F.max("power_w").alias("top"))
    df = shape.join(src.tests(s, d).select(KEY, "protocol"), KEY)
    return df.select(KEY, fx.test_modality(F.col("protocol"), F.col("n"), F.col("top")).alias("modality"))


@query("p13_economy_modality")
def _(s, d):
    configured = F.when(F.col(KEY) % 9 == 0, "other")
    return src.tests(s, d).select(KEY, fx.economy_modality(F.col("protocol"), configured).alias("modality"))


@query("p14_duration_text")
def _(s, d):
    spans = src.breaths(s, d).groupBy(KEY).agg((F.max("time_s") + 0.5).alias("seconds"))
    return spans.select(KEY, fx.duration_text(F.col("seconds")).alias("duration"))


@query("p15_heart_rate_zones")
def _(s, d):
    return out(series.heart_rate_zones(src.breaths(s, d), src.participants(s, d)))


def _views(s: SparkSession, d: str) -> tuple[str, str]:
    """Breaths and participants as views that SQL text can name."""
    sql_functions.register(s)
    names = tuple(f"{x}_{uuid.uuid4().hex}" for x in ("breaths", "participants"))
    for name, frame in zip(names, (src.breaths(s, d), src.participants(s, d))):
        frame.createOrReplaceTempView(name)
    return names


@query("p_sql_scalars")
def _(s, d):
    """P6, P7, P9, P10 and P14 as functions of SQL text."""
    rows, people = _views(s, d)
    return s.sql(f"""SELECT b.test_id, b.rn, running_economy(vo2_ml / weight_kg, speed_kmh) AS running_economy, gross_efficiency(vo2_ml, power_w, rer) AS gross_efficiency,
      age_group(age) AS age_group, score_rating(hr_bpm / 2) AS hr_rating, duration_text(time_s + 0.5) AS at
      FROM {rows} b JOIN {people} p ON p.test_id = b.test_id""")


@query("p15_sql_zones")
def _(s, d):
    """P15 as a table function of SQL text."""
    rows, people = _views(s, d)
    return out(s.sql(f"""SELECT t.test_id, z.hr_reference, z.zone_pct, z.zone_bpm
      FROM (SELECT b.test_id, max(p.age) AS age, max(b.hr_bpm) AS peak FROM {rows} b JOIN {people} p ON p.test_id = b.test_id GROUP BY b.test_id) t,
      LATERAL heart_rate_zones(t.age, t.peak) z"""))


@query("p16_two_axis_scale")
def _(s, d):
    return out(series.two_axis_scale(src.breaths(s, d)), *ROW, "scale", "offset")


@query("p17_long_signals")
def _(s, d):
    return out(series.long_signals(src.breaths(s, d), ROW, ["vo2_ml", "vco2_ml", "hr_bpm"]))


@query("p18_state_labels")
def _(s, d):
    df = labels.state_labels(src.pretest(s, d), ["nutritional_state", "fatigue_state"], "fr")
    return df.select(KEY, "nutritional_state_label", "fatigue_state_label")


@query("p19_rounded_columns")
def _(s, d):
    return report.rounded(src.breaths(s, d).select(*ROW, "vo2_ml", "ve_l", "hr_bpm", "phase"))


# -------------------------------------------------------------------- filters


@query("f1_complete_rows")
def _(s, d):
    df = src.breaths(s, d)
    return out(grid.complete_rows(df.withColumn("vo2_ml", F.when(F.col("hr_bpm").isNotNull(), F.col("vo2_ml")))), *ROW, "vo2_ml")


@query("f2_exercise_rows")
def _(s, d):
    return out(stages.exercise_rows(src.breaths(s, d)), *ROW, "time_s", "phase")


@query("f3_loaded_rows")
def _(s, d):
    return out(quality.loaded_rows(src.breaths(s, d)), *ROW, "power_w", "vo2_ml")


@query("f4_rest_rows")
def _(s, d):
    return out(stages.rest_rows(src.breaths(s, d), ("rest", "baseline", "warmup")), *ROW, "vo2_ml")


@query("f5_first_seconds")
def _(s, d):
    return out(stages.first_seconds(breaths(s, d), 120), *ROW, "time_s")


@query("f6_last_seconds")
def _(s, d):
    return out(stages.last_seconds(stages.stages_by_time(breaths(s, d)), "stage", 30), *ROW, "stage", "time_s")


# ---------------------------------------------------------------------- joins


@query("j1_join_stages")
def _(s, d):
    df = breaths(s, d)
    return stages.join_stages(df, stages.stages_by_time(df)).select(*ROW, "stage", "stage_name")


@query("j2_smoothed_power")
def _(s, d):
    smooth = stages.ramp_power(breaths(s, d), 180.0)
    return out(smooth, *ROW, F.coalesce("power_used", "power_w").alias("power_used"))


@query("j3_stage_names")
def _(s, d):
    staged = stages.stages_from_phase(breaths(s, d))
    named = stages.name_stages(stages.summarize_stages(staged, "mean"), stages.stage_names(staged))
    return out(named, KEY, "stage", "vo2_ml", "stage_name")


@query("j4_asof_stage")
def _(s, d):
    df = breaths(s, d)
    starts = stages.stages_by_time(df).where("stage > 1").groupBy(KEY, "stage").agg(F.min("time_s").alias("time_s"))
    return stages.asof_stage(df, starts).select(*ROW, "stage")


@query("j5_nearest_value")
def _(s, d):
    df = src.breaths(s, d)
    targets = df.groupBy(KEY).agg(F.avg("vo2_ml").alias("target"))
    return out(thresholds.nearest_values(df, targets, "target", ["hr_bpm", "power_w", "time_s", "vco2_ml"]))


@query("j6_normative_lookup")
def _(s, d):
    return norms.normative_lookup(src.participants(s, d)).select(
        KEY, "age_group", "norm_low", "norm_typical", "norm_high", "norm_hr_max", "norm_efficiency", "norm_economy"
    )


@query("j7_translate")
def _(s, d):
    df = src.pretest(s, d).select(KEY, F.coalesce("nutritional_state", F.lit("unknown_state")).alias("state"))
    return labels.translate(labels.translate(df, "state", "text_en", "de"), "state", "text_fr", "fr")


@query("j8_compose_record")
def _(s, d):
    df = breaths(s, d)
    p = src.participants(s, d)
    staged = stages.summarize_stages(stages.stages_by_time(df))
    counts = staged.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_stages"))
    record = report.compose(p, src.tests(s, d), peaks.find_peaks(df, p), quality.end_plateau(df), counts)
    return out(record, KEY, "test.protocol", "participant.name", "peaks.vo2_peak", "thresholds.plateau_delta", "n_stages")


@query("j9_participant_override")
def _(s, d):
    return report.override_participants(src.participants(s, d), src.edits(s, d)).select(KEY, "name", "age", "weight_kg")


@query("j10_category_members")
def _(s, d):
    return norms.category_members(src.participants(s, d))


# --------------------------------------------------------------- aggregations


@query("a1_average_by_time")
def _(s, d):
    return out(averaging.average_by_time(src.breaths(s, d), 30), KEY, "time_s", *SIGNALS, "phase", "n_breaths")


@query("a2_average_by_breath")
def _(s, d):
    return out(averaging.average_by_breath(src.breaths(s, d), 7), KEY, "time_s", *SIGNALS, "phase", "n_breaths")


SUMMARY = [KEY, "stage", "stage_name", "time_s", "duration_s", "vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "n_breaths"]


@query("a3_stage_summary_mean")
def _(s, d):
    return out(stages.summarize_stages(stages.extract_stages(breaths(s, d)), "mean"), *SUMMARY)


@query("a4_stage_summary_last")
def _(s, d):
    staged = stages.extract_stages(breaths(s, d))
    return out(stages.summarize_last(staged, (30, 60)), "method", *SUMMARY)


@query("a5_stage_summary_peak")
def _(s, d):
    return out(stages.summarize_stages(stages.extract_stages(breaths(s, d)), "peak"), *SUMMARY)


@query("a6_display_stages")
def _(s, d):
    return out(stages.display_stages(breaths(s, d), 30), KEY, "group_kind", "stage_group", "time_s", *SIGNALS, "n_breaths")


@query("a7_find_peaks")
def _(s, d):
    return out(peaks.find_peaks(breaths(s, d), src.participants(s, d)))


@query("a8_power_increment")
def _(s, d):
    return out(stages.power_increment(src.breaths(s, d)))


@query("a9_workload_regression")
def _(s, d):
    return out(quality.workload_regression(src.breaths(s, d)))


@query("a10_expected_vo2")
def _(s, d):
    return out(quality.expected_vo2_by_level(src.breaths(s, d)))


@query("a11_stage_consistency")
def _(s, d):
    return out(quality.stage_consistency(src.breaths(s, d)))


@query("a12_exercise_duration")
def _(s, d):
    return out(quality.exercise_duration(src.breaths(s, d)))


@query("a13_baseline_stability")
def _(s, d):
    return out(quality.baseline_stability(breaths(s, d)))


@query("a14_calibration_drift")
def _(s, d):
    return out(quality.calibration_drift(src.breaths(s, d)), digits=6)


@query("a15_completeness")
def _(s, d):
    df = src.breaths(s, d)
    checked = validation.completeness_check(df).select(KEY, "missing_ve_l", joined("missing_warnings"), joined("missing_info"))
    return out(quality.missing_signals(df).join(checked, KEY))


@query("a16_physiological_ranges")
def _(s, d):
    found = validation.physiological_check(src.breaths(s, d), src.participants(s, d))
    arrays = ["range_errors", "range_warnings", "range_info"]
    return out(found, *[c for c in found.columns if c not in arrays], *[joined(c) for c in arrays])


@query("a17_rest_phase")
def _(s, d):
    found = validation.rest_phase_check(breaths(s, d), src.participants(s, d))
    return out(found, KEY, "rest_rows", "rest_min", "rest_vo2", "rest_rer", "early_rer", joined("rest_warnings"), joined("rest_info"))


@query("a18_effort_level")
def _(s, d):
    return out(validation.effort_check(src.breaths(s, d), src.participants(s, d)))


@query("a19_panel_fits")
def _(s, d):
    return out(series.panel_fits(stages.display_stages(breaths(s, d))), KEY, "panel", "n_points", "slope", "intercept", "residual_se", "mean_x", "t_95")


@query("a19_fit_bands")
def _(s, d):
    return out(series.fit_bands(stages.display_stages(breaths(s, d))), digits=3)


@query("a20_duration_check")
def _(s, d):
    found = validation.duration_check(src.breaths(s, d))
    return out(found, KEY, "n_breaths", "duration_min", joined("length_errors"), joined("length_warnings"))


# -------------------------------------------------------------------- windows


@query("w1_average_rolling")
def _(s, d):
    return out(averaging.average_rolling(breaths(s, d), 30), KEY, "time_s", *SIGNALS)


@query("w1_wide_rolling")
def _(s, d):
    """A width that is a large part of the test: half of its duration."""
    half = breaths(s, d).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("bigint"))
    return out(rolling.rolling_means(half, SIGNALS, "k"), *ROW, "k", *[f"{c}_roll" for c in SIGNALS])


@query("w2_right_rolling")
def _(s, d):
    df = breaths(s, d)
    k = F.least(F.greatest(F.lit(5.0), F.rint(fx.ratio(F.lit(30.0), F.col("interval")))), F.floor(F.col("n") / 2))
    df = rolling.rolling_means(df.withColumn("k", k.cast("bigint")), ["vo2_ml", "power_w"], "k", "right")
    return out(df, *ROW, "k", "vo2_ml_roll", "power_w_roll")


@query("w3_outlier_scores")
def _(s, d):
    rows = breaths(s, d)  # read and sorted once for both
    both = [rolling.outlier_scores(rows, r).select(*ROW, F.lit(r).alias("rule"), "z") for r in ("quality", "validate")]
    return out(both[0].unionByName(both[1]))


@query("w3_aberrant_breaths")
def _(s, d):
    return out(rolling.aberrant_breaths(breaths(s, d), 0.13), *ROW, "time_s", "vo2_ml")


@query("w4_intensity_runs")
def _(s, d):
    return out(stages.intensity_runs(breaths(s, d)), KEY, "modality", "run", "level", "start_s", "duration_s", "rows")


@query("w5_sustained_rise")
def _(s, d):
    smooth = thresholds.smooth_for_thresholds(breaths(s, d))
    return out(thresholds.sustained_changes(smooth, {"ve_vo2_s": "rise", "ve_vco2_s": "rise", "peto2_s": "rise"}))


@query("w6_sustained_drop")
def _(s, d):
    return out(thresholds.sustained_changes(thresholds.smooth_for_thresholds(breaths(s, d)), {"petco2_s": "drop"}))


@query("w7_v_slope")
def _(s, d):
    return out(thresholds.v_slope(thresholds.smooth_for_thresholds(breaths(s, d))), KEY, "split_row", "v_slope_vo2", "sse", digits=2)


@query("w8_time_to_peak")
def _(s, d):
    return out(peaks.time_to_peak(breaths(s, d)))


@query("w9_end_plateau")
def _(s, d):
    return out(quality.end_plateau(breaths(s, d)))


@query("w10_stage_plateau")
def _(s, d):
    return out(peaks.stage_plateau(stages.stages_from_power(breaths(s, d))))


@query("w11_stages_step")
def _(s, d):
    return out(stages.stages_from_power(breaths(s, d), "step"), *ROW, "power_rounded", "stage", "stage_name")


@query("w12_stages_ramp")
def _(s, d):
    return out(stages.stages_from_power(breaths(s, d), "ramp"), *ROW, "power_rounded", "stage", "stage_name")


@query("w13_stages_phase")
def _(s, d):
    return stages.stages_from_phase(breaths(s, d)).select(*ROW, "stage", "stage_name")


@query("w14_stages_time")
def _(s, d):
    return stages.stages_by_time(breaths(s, d), 60).select(*ROW, "stage", "stage_name")


@query("w15_breath_interval")
def _(s, d):
    return out(breaths(s, d).groupBy(KEY).agg(F.min("interval").alias("interval_s")))


# ------------------------------------------------- sorts, top-k and set operations


@query("t1_time_order")
def _(s, d):
    df = rank_rows(src.breaths(s, d), [F.desc("time_s")], "from_end")
    return out(df, *ROW, "from_end", "time_s")


@query("t2_vo2_order")
def _(s, d):
    return out(rank_rows(src.breaths(s, d), ["vo2_ml", "rn"], "vo2_rank"), *ROW, "vo2_rank", "vo2_ml")


@query("t3_last_two_stages")
def _(s, d):
    summary = stages.summarize_stages(stages.stages_by_time(breaths(s, d)), "mean")
    return out(stages.last_stages(summary), KEY, "stage", "vo2_ml", F.col("back").cast("bigint").alias("back"))


@query("t4_extreme_rows")
def _(s, d):
    low = F.struct("ve_l", "rn")
    high = F.struct(-F.col("ve_l"), F.col("rn"))
    return out(src.breaths(s, d).groupBy(KEY).agg(F.min_by("time_s", low).alias("t_low"), F.min_by("time_s", high).alias("t_high")))


@query("t5_reference_row")
def _(s, d):
    summary = stages.summarize_stages(stages.stages_from_phase(breaths(s, d)), "mean")
    return out(economy.reference_row(summary, 2), KEY, "stage", "vo2_ml", "rer")


@query("u1_append_rows")
def _(s, d):
    df = src.breaths(s, d)
    a = df.where(F.col("power_w").isNotNull()).groupBy(KEY).agg(F.max("power_w").alias("max_power"))
    b = df.where(F.col("speed_kmh").isNotNull()).groupBy(KEY).agg(F.max("speed_kmh").alias("max_speed"))
    return out(a.unionByName(b, allowMissingColumns=True))


# ------------------------------------------------------------------ composites


@query("c1_validate")
def _(s, d):
    found = validation.validate(breaths(s, d), src.participants(s, d))
    return out(found, KEY, "is_valid", joined("errors"), joined("warnings"), joined("info"), "duration_min", "n_aberrant", "pct_aberrant")


@query("c2_average")
def _(s, d):
    once = averaging.average(src.breaths(s, d), "time", 20)
    twice = averaging.average(once.drop("n_breaths"), "time", 60)
    return out(twice, KEY, "time_s", "vo2_ml", "n_breaths", "is_averaged", "averaging_window", "averaging_method", "reaveraged")


THRESHOLDS = [KEY, "vt1_vo2", "vt1_hr", "vt1_power", "vt1_method", "vt2_vo2", "vt2_hr", "vt2_power", "vt2_method", "confidence"]


@query("c3_detect_thresholds")
def _(s, d):
    methods = ("v_slope", "ve_vo2", "ve_vco2", "peto2", "petco2")
    return out(thresholds.detect_thresholds(breaths(s, d), methods), *THRESHOLDS)


@query("c3_default_thresholds")
def _(s, d):
    return out(thresholds.detect_thresholds(breaths(s, d)), *THRESHOLDS)


@query("c4_extract_stages")
def _(s, d):
    return stages.extract_stages(breaths(s, d)).select(*ROW, "stage", "stage_name")


@query("c4_extract_stages_ramp")
def _(s, d):
    return stages.extract_stages(breaths(s, d), "ramp").select(*ROW, "stage", "stage_name")


@query("c5_protocol_config")
def _(s, d):
    return out(stages.detect_protocol_config(breaths(s, d)))


@query("c6_maximal_criteria")
def _(s, d):
    return out(quality.assess_maximal_criteria(breaths(s, d), src.participants(s, d), src.reports(s, d)))


@query("c7_protocol_quality")
def _(s, d):
    return out(quality.assess_protocol_quality(breaths(s, d), src.tests(s, d)))


DATA = [
    KEY, "n_breaths", "n_aberrant", "pct_aberrant", "pct_missing_hr", "pct_missing_power", "baseline_cv",
    "baseline_stable", "drift_detected", "signal_score", "signal_rating", "data_score", "data_rating",
]


@query("c8_data_quality")
def _(s, d):
    return out(quality.assess_data_quality(breaths(s, d)), *DATA, joined("recommendations"))


@query("odd_thresholds")
def _(s, d):
    """C3 over tests some of which have no threshold."""
    methods = ("ve_vo2", "ve_vco2", "peto2", "petco2")  # a V-slope finds a split wherever there are rows enough
    return out(thresholds.detect_thresholds(prepare(src.odd_breaths(s, d)), methods), *THRESHOLDS)


@query("odd_calibration_drift")
def _(s, d):
    """A14 over tests some of which drift."""
    return out(quality.calibration_drift(src.odd_breaths(s, d)), digits=6)


@query("odd_aberrant_breaths")
def _(s, d):
    """W3 at its usual threshold over tests some of which have spikes."""
    return out(rolling.aberrant_breaths(prepare(src.odd_breaths(s, d))), *ROW, "time_s", "vo2_ml")


@query("odd_data_quality")
def _(s, d):
    """C8 over tests with drift and aberrant breaths."""
    return out(quality.assess_data_quality(prepare(src.odd_breaths(s, d))), *DATA, joined("recommendations"))


def _score_inputs(s: SparkSession, d: str) -> DataFrame:
    """Percentages spread over all score bands, from the participants."""
    key = F.col(KEY)
    return src.tests(s, d).select(
        KEY, (key % 12).cast("double").alias("ab"), F.when(key % 5 != 0, (key % 25).cast("double")).alias("hr"),
        F.when(key % 4 != 0, (key % 23).cast("double")).alias("power"), (key % 26).cast("double").alias("cv"), (key % 3 == 0).alias("drift"),
    )


@query("c9_signal_score")
def _(s, d):
    return _score_inputs(s, d).select(KEY, quality.signal_score(F.col("ab"), F.col("hr"), F.col("cv")).alias("score"))


@query("c10_overall_data_score")
def _(s, d):
    cols = [F.col(c) for c in ("ab", "hr", "power", "cv", "drift")]
    return _score_inputs(s, d).select(KEY, quality.overall_data_score(*cols).alias("score"))


@query("c11_recommendations")
def _(s, d):
    cols = [F.col(c) for c in ("ab", "hr", "power", "cv", "drift")]
    return _score_inputs(s, d).select(KEY, F.array_join(quality.recommendations(*cols), ",").alias("recommendations"))


@query("c12_assess_quality")
def _(s, d):
    graded = quality.assess_quality(breaths(s, d), src.participants(s, d), src.tests(s, d), src.reports(s, d))
    return out(graded, KEY, "exercise_score", "protocol_score", "data_score", "overall_score", "grade", "interpretable")


@query("c13_exercise_score")
def _(s, d):
    criteria = quality.assess_maximal_criteria(breaths(s, d), src.participants(s, d), src.reports(s, d))
    return out(quality.exercise_score(criteria), KEY, "determination", "exercise_score")


@query("c14_quality_summary")
def _(s, d):
    graded = quality.assess_quality(breaths(s, d), src.participants(s, d), src.tests(s, d), src.reports(s, d))
    return graded.select(KEY, "summary")


@query("c15_economy_metrics")
def _(s, d):
    df = breaths(s, d)
    summary = stages.summarize_stages(stages.extract_stages(df))
    config = stages.detect_protocol_config(df)
    return out(economy.economy_metrics(summary, src.participants(s, d), src.tests(s, d), 2, config=config))


@query("c16_compare_with_norms")
def _(s, d):
    p = src.participants(s, d)
    return out(report.compare_with_norms(peaks.find_peaks(breaths(s, d), p), p))


@query("c17_summary_table")
def _(s, d):
    p = src.participants(s, d)
    return out(report.summary_table(peaks.find_peaks(breaths(s, d), p), p))


@query("c18_interpretation_gauges")
def _(s, d):
    p = src.participants(s, d)
    found = peaks.find_peaks(breaths(s, d), p)
    gauges = report.interpretation_gauges(found, p)
    return out(gauges.withColumn("sentence", report.gauge_sentence()).drop("rer_peak"))


@query("c19_interpretation_codes")
def _(s, d):
    p = src.participants(s, d)
    return report.interpretation_texts(peaks.find_peaks(breaths(s, d), p), p, "fr")


@query("c20_report_record")
def _(s, d):
    df, p, t = breaths(s, d), src.participants(s, d), src.tests(s, d)
    summary = keep(stages.summarize_stages(stages.extract_stages(df)), "stages")
    config = keep(stages.detect_protocol_config(df), "config")
    found = keep(peaks.find_peaks(df, p), "peaks")
    return out(report.report_record(
        p, t, df.groupBy(KEY).agg(F.max("time_s").alias("t_last")), found,
        keep(thresholds.detect_thresholds(df), "thresholds"), summary.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_stages")),
        config=config, economy=economy.economy_metrics(summary, p, t, 2, config=config),
        pretest=src.pretest(s, d), averaging=keep(grid.detect_data_type(df), "types"),
        gauges=report.interpretation_gauges(found, p),
    ))


@query("c21_stage_table")
def _(s, d):
    return out(report.stage_table(stages.summarize_stages(stages.extract_stages(breaths(s, d)), "mean")))


@query("c22_analysis")
def _(s, d):
    done = analysis.analyse(src.breaths(s, d), src.participants(s, d), src.tests(s, d))
    return out(done.records, KEY, "peaks.vo2_peak", "peaks.vo2_kg_peak", "peaks.rer_peak", "thresholds.vt1_vo2",
               "thresholds.vt2_vo2", "thresholds.confidence", "n_stages", "validation.is_valid")


@query("c22_batch_counters")
def _(s, d):
    """What a written batch holds, counted while it is written."""
    done = analysis.analyse(src.breaths(s, d), src.participants(s, d), src.tests(s, d))
    found = batch.write_batch(done, scratch_folder(s))
    return s.createDataFrame(list(found.items()), "counter string, n bigint")


@query("d1_panel_series")
def _(s, d):
    return out(series.panel_series(breaths(s, d)))


@query("d1_peak_markers")
def _(s, d):
    return out(series.peak_markers(breaths(s, d)))


@query("d2_v_slope_series")
def _(s, d):
    df = breaths(s, d)
    found = keep(thresholds.detect_thresholds(df), "thresholds")  # else its sorts and those of the series share a task
    return out(series.v_slope_series(df, found))


@query("d3_ventilatory_series")
def _(s, d):
    return out(series.ventilatory_series(src.breaths(s, d)))


@query("d4_gas_exchange_series")
def _(s, d):
    return out(series.gas_exchange_series(src.breaths(s, d), src.participants(s, d), ("vo2", "vco2", "ve"), True))


@query("d4_smooth_curve")
def _(s, d):
    points = series.gas_exchange_series(breaths(s, d), src.participants(s, d)).withColumnsRenamed({"time_min": "x", "value": "y"})
    return out(smooth.smooth_curve(points))


@query("d5_heart_rate_series")
def _(s, d):
    return out(series.heart_rate_series(src.breaths(s, d), src.participants(s, d)))


@query("d6_power_series")
def _(s, d):
    return out(series.power_series(src.breaths(s, d)))


# ------------------------------------------------------------------ long tests


@query("long_find_peaks")
def _(s, d):
    return out(peaks.find_peaks(prepare(src.long_breaths(s, d))), KEY, "vo2_peak", "ve_peak", "rer_peak", "hr_peak", "power_peak", "speed_peak")


@query("long_thresholds")
def _(s, d):
    return out(thresholds.detect_thresholds(prepare(src.long_breaths(s, d))), *THRESHOLDS)


@query("long_average_by_time")
def _(s, d):
    return out(averaging.average_by_time(src.long_breaths(s, d), 30), KEY, "time_s", *SIGNALS, "phase", "n_breaths")
