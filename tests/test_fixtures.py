"""Worked examples with expected values, in the plain and in the split layout."""

from __future__ import annotations

import pytest
from helpers import breaths, column, near, people
from pyspark.sql import functions as F

from tidalspan.functions import scalars as fx
from tidalspan.operators import averaging, norms, peaks, quality, rolling, stages, thresholds, validation
from tidalspan.operators.layout import index_rows, prepare
from tidalspan.sources.grid import detect_data_type


@pytest.fixture(params=["plain", "split"], autouse=True)
def layout(request, spark):
    if request.param == "split":
        spark.conf.set("spark.tidalspan.chunkRows", "5")
    yield request.param
    spark.conf.unset("spark.tidalspan.chunkRows")


RAMP = [(0, 300), (10, 320), (20, 340), (30, 400), (40, 500), (50, 700)]


@pytest.fixture
def ramp(spark):
    return breaths(spark, [{"time_s": t, "vo2_ml": v} for t, v in RAMP])


def test_layout_is_split_only_when_asked(ramp, layout):
    assert ("split" in prepare(ramp).columns) == (layout == "split")


def test_time_bins(ramp):
    rows = averaging.average_by_time(ramp, 30).orderBy("time_s").collect()
    assert [(r.time_s, round(r.vo2_ml, 6), r.n_breaths) for r in rows] == [(10, 320, 3), (40, 533.333333, 3)]


def test_breath_groups(ramp):
    rows = averaging.average_by_breath(ramp, 4).orderBy("time_s").collect()
    assert [(r.time_s, r.vo2_ml, r.n_breaths) for r in rows] == [(15, 340, 4), (45, 600, 2)]


@pytest.mark.parametrize("k, align, expected", [
    (3, "center", [None, 320, 353.333333, 413.333333, 533.333333, None]),
    (4, "center", [None, 340, 390, 485, None, None]),
    (4, "right", [None, None, None, 340, 390, 485]),
])
def test_rolling_widths(ramp, k, align, expected):
    df = rolling.rolling(prepare(ramp).withColumn("k", F.lit(k).cast("bigint")), ["vo2_ml"], "k", align)
    assert near(column(df, "vo2_ml_roll")) == expected


def test_rolling_average_rounds_half_to_even(ramp):
    # 25 / 10 = 2.5 rows rounds to 2, so one edge row is lost.
    assert averaging.average_rolling(ramp, 25).count() == 5
    assert averaging.average_rolling(ramp, 30).count() == 4


def test_peak(spark, ramp):
    r = peaks.find_peaks(ramp, people(spark, (1, 30, "M", 175, 70))).first()
    assert (round(r.vo2_peak, 6), round(r.vo2_kg_peak, 6)) == (533.333333, 7.619048)
    assert r.hr_peak is None
    assert peaks.time_to_peak(ramp).first().time_to_peak_s == 40


def test_stages_by_phase_and_time(spark):
    rows = [{"time_s": t, "phase": "REST" if t < 120 else "EXERCISE" if t <= 600 else "RECOVERY"} for t in range(0, 661, 60)]
    df = breaths(spark, rows)
    by_phase = stages.stages_from_phase(df)
    assert column(by_phase, "stage") == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4]
    assert column(by_phase, "stage_name")[-1] == "Recovery"
    assert column(stages.stages_by_time(df), "stage") == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4]
    assert column(stages.extract_stages(df), "stage") == column(by_phase, "stage")


def test_stages_by_power(spark):
    df = breaths(spark, [{"time_s": i * 10, "power_w": w} for i, w in enumerate([0, 0, 50, 50, 75, 75, 100, 100])])
    assert stages.power_increment(df.withColumn("rn", F.lit(1))).first().power_increment == 25
    assert column(stages.stages_from_power(df), "stage") == [0, 0, 1, 1, 2, 2, 3, 3]


def test_sustained_rise(spark):
    values = [None, 30, 28, 26, 25, 26, 26.3, 26.4, 26.5, 27, 28, 29, None]
    df = prepare(breaths(spark, [{"time_s": i, "peto2_mmhg": v} for i, v in enumerate(values)]))
    df = df.withColumn("vo2_s", F.col("vo2_ml"))
    assert thresholds.sustained_changes(df, {"peto2_mmhg": "rise"}).first().peto2_mmhg_row == 7
    falling = prepare(breaths(spark, [{"time_s": i, "peto2_mmhg": 50 - i} for i in range(20)])).withColumn("vo2_s", F.col("vo2_ml"))
    assert thresholds.sustained_changes(falling, {"peto2_mmhg": "rise"}).first().peto2_mmhg_row is None


def test_outliers_need_a_window_of_eleven(spark):
    rows = [{"time_s": i, "vo2_ml": 1000 if i == 21 else 300} for i in range(44)]
    assert [r.rn for r in rolling.aberrant_breaths(breaths(spark, rows)).collect()] == [22]
    assert rolling.aberrant_breaths(breaths(spark, rows[:43])).count() == 0


@pytest.mark.parametrize("slope, drift", [(0.002, True), (0.0005, False)])
def test_drift(spark, slope, drift):
    rows = [{"time_s": i * 10, "phase": "REST", "rer": 0.8 + slope * i * 10 + (0.01 if i % 2 == 0 else -0.01)} for i in range(20)]
    r = quality.calibration_drift(breaths(spark, rows)).first()
    assert r.drift_detected == drift
    assert round(r.rest_slope, 6) == {0.002: 0.001985, 0.0005: 0.000485}[slope]


@pytest.mark.parametrize("cap, delta, flat", [(2000, 0, True), (10**9, 600, False)])
def test_end_plateau(spark, cap, delta, flat):
    rows = [{"time_s": i * 10, "vo2_ml": min(50 * (i + 1), cap), "power_w": 5 * (i + 1)} for i in range(60)]
    r = quality.end_plateau(breaths(spark, rows)).first()
    assert (r.plateau_detected, r.plateau_delta) == (flat, delta)


def test_protocol_config(spark):
    rows = [{"time_s": i * 10, "power_w": 50 + 25 * (i // 18)} for i in range(54)]
    r = stages.detect_protocol_config(breaths(spark, rows)).first()
    assert (r.modality, r.starting_intensity, r.increment_size, r.stage_duration_s) == ("cycling", 50, 25, 180)


def test_raw_or_averaged(spark):
    make = lambda n, gap: detect_data_type(breaths(spark, [{"time_s": i * gap} for i in range(n)])).first()
    assert (make(12, 10).is_averaged, make(12, 10).averaging_window) == (True, 10)
    assert make(12, 2).is_averaged is False
    assert make(9, 10).is_averaged is False


def test_second_threshold_not_above_first_is_dropped(spark):
    df = spark.createDataFrame([(1, 2000.0, 1800.0, 1500.0)], "test_id bigint, cand_v_slope double, cand_ve_vo2 double, cand_ve_vco2 double")
    r = thresholds.combine_candidates(df, thresholds.DEFAULT_METHODS).first()
    assert (r.vt1_vo2, r.vt2_vo2, r.confidence, r.vt1_method, r.vt2_method) == (1900, None, "moderate", "v_slope, ve_vo2", None)
    with pytest.raises(ValueError):
        thresholds.combine_candidates(df, ["nonsense"])


def test_thresholds_on_two_slopes(spark):
    # VCO2 rises by 0.9 per mL up to VO2 1500 and by 1.3 beyond it.
    rows = []
    for i in range(200):
        vo2 = 300 + 12 * i
        rows.append({"time_s": 3 * i, "vo2_ml": vo2, "vco2_ml": 0.9 * vo2 + max(0, vo2 - 1500) * 0.4, "ve_l": 30 * vo2 / 1000, "hr_bpm": 70 + i / 2})
    r = thresholds.detect_thresholds(breaths(spark, rows), ["v_slope"]).first()
    assert abs(r.vt1_vo2 - 1500) < 60 and r.confidence == "low" and r.vt1_hr is not None


def test_validate_finds_errors(spark):
    p = people(spark, (1, 30, "M", 175, 70))
    short = validation.validate(breaths(spark, [{"time_s": i} for i in range(5)]), p).first()
    assert not short.is_valid and "too_few_breaths" in short.errors
    negative = validation.validate(breaths(spark, [{"time_s": i * 10, "vo2_ml": -100 if i == 25 else 500} for i in range(50)]), p).first()
    assert negative.errors == ["negative_vo2"]


def test_order_audit_uses_recorded_order(spark):
    df = breaths(spark, [{"time_s": t} for t in (0, 10, 5, 20, 15, 30, 40, 50)])
    df = index_rows(df.withColumn("line", F.monotonically_increasing_id()), ["line"])
    assert validation.order_audit(df).first().steps_back == 2


def test_asof_stage(spark):
    df = prepare(breaths(spark, [{"time_s": t} for t in range(0, 120, 10)]))
    starts = spark.createDataFrame([(1, 20.0, 1), (1, 55.0, 2), (1, 100.0, 3)], "test_id bigint, time_s double, stage int")
    assert column(stages.asof_stage(df, starts), "stage") == [1] * 6 + [2] * 4 + [3] * 2


def test_scores(spark):
    df = spark.createDataFrame([(6.0, 12.0, 0.0, 16.0, False)], "ab double, hr double, pw double, cv double, d boolean")
    cols = [F.col(c) for c in ("ab", "hr", "pw", "cv", "d")]
    r = df.select(
        quality.signal_score(cols[0], cols[1], cols[3]).alias("s"), quality.overall_data_score(*cols).alias("o"),
        quality.recommendations(*cols).alias("r"),
    ).first()
    assert (r.s, r.o, r.r) == (45, 55, ["filter_aberrant_breaths", "check_hr_monitor", "stabilise_baseline"])


@pytest.mark.parametrize("vo2, power, rer, expected", [
    (3000, 250, 1.0, 23.6), (3000, 300, 1.0, 28.4), (3000, 250, 0.85, 24.5), (2500, 200, 0.9, 23.3),
    (2800, 280, 0.95, 28.7), (3000, 250, 0.5, 25.5), (3000, 250, 1.5, 23.1), (3000, 0, 1.0, None), (0, 250, 1.0, None),
])
def test_gross_efficiency(spark, vo2, power, rer, expected):
    value = fx.gross_efficiency(F.lit(float(vo2)), F.lit(float(power)), F.lit(rer))
    assert spark.range(1).select(value.alias("v")).first().v == expected


def test_formulas(spark):
    one = spark.range(1)
    economy = [one.select(fx.running_economy(F.lit(float(v)), F.lit(float(s))).alias("v")).first().v for v, s in ((40, 12), (40, 14), (35, 18), (40, 0))]
    assert economy == [200.0, 171.4, 116.7, None]
    texts = [one.select(fx.duration_text(F.lit(float(t))).alias("v")).first().v for t in (60, 90, 125, 600, 3661)]
    assert texts == ["1:00", "1:30", "2:05", "10:00", "61:01"]


def test_predicted_values(spark):
    df = norms.with_predicted(people(spark, (1, 30, "M", 175, 70), (2, 30, "F", 165, 60), (3, 60, "M", 175, 70)))
    rows = df.orderBy("test_id").collect()
    assert [near([r.pred_hr, r.pred_vo2_kg, r.pred_vo2, r.pred_ve, r.pred_power, r.pred_o2_pulse]) for r in rows] == [
        near([187, 43.5, 3045, 76.125, 2240, 3045 / 187]),
        near([187, 36.9, 2214, 55.35, 1410, 2214 / 187]),
        near([166, 27.0, 1890, 47.25, 2180, 1890 / 166]),
    ]


def test_norms(spark):
    df = people(spark, (1, 45, "M", 175, 70), (2, 45, "F", 165, 60), (3, 45, "O", 170, 65))
    general = {r.test_id: r.norm_typical for r in norms.normative_lookup(df).collect()}
    assert general == {1: 38.0, 2: 30.0, 3: None}
    elite = norms.normative_lookup(df.withColumns({"sport": F.lit("Cycling"), "level": F.lit("elite")})).orderBy("test_id").first()
    assert (elite.norm_low, elite.norm_typical, elite.norm_high, elite.norm_efficiency) == (70, 77, 85, 23.5)
    assert len(norms.normative_categories(spark).collect()) == 20
