"""Odd tests must not break a batch: one row, no time passing, zeros, nothing optional."""

from __future__ import annotations

import pytest
from helpers import breaths, people
from pyspark.sql import functions as F

from tidalspan.operators import economy, quality, rolling, stages, thresholds, validation
from tidalspan.operators.layout import prepare
from tidalspan.operators.peaks import find_peaks, stage_plateau, time_to_peak
from tidalspan.plans import report, series
from tidalspan.plans.analysis import analyse
from tidalspan.sources.grid import detect_data_type


@pytest.fixture
def odd(spark):
    one = breaths(spark, [{"time_s": 0}], 1)
    still = breaths(spark, [{"time_s": 5} for _ in range(30)], 2)
    zero = breaths(spark, [{"time_s": i, "vo2_ml": 0, "vco2_ml": 0, "ve_l": 0, "rer": 0, "hr_bpm": 0, "power_w": 0} for i in range(70)], 3)
    rest = breaths(spark, [{"time_s": i, "phase": "REST"} for i in range(2)], 4)
    steady = breaths(spark, [{"time_s": i * 2, "power_w": 100, "phase": "EXERCISE", "peto2_mmhg": 100} for i in range(80)], 5)
    df = one.unionByName(still).unionByName(zero).unionByName(rest).unionByName(steady)
    return df.withColumn("line", F.monotonically_increasing_id())


def test_odd_tests_pass_through(spark, odd):
    p = people(spark, *[(i, 30, "M", 175, 70) for i in range(1, 6)])
    t = spark.createDataFrame([(i, "Bike") for i in range(1, 6)], "test_id bigint, protocol string")
    b = prepare(odd, ["time_s", "line"]).drop("line")
    staged = stages.extract_stages(b)
    summary = stages.summarize_stages(staged)
    peaks = find_peaks(b, p)
    frames = [
        peaks, time_to_peak(b), stage_plateau(staged), staged, summary, stages.extract_stages(b, "ramp"), stages.display_stages(b),
        stages.detect_protocol_config(b), rolling.average_rolling(b), rolling.outlier_scores(b), thresholds.detect_thresholds(b),
        quality.assess_quality(b, p, t), validation.validate(b, p), detect_data_type(b), series.panel_series(b), series.power_series(b),
        series.fit_bands(stages.display_stages(b)), series.heart_rate_series(b, p), economy.economy_metrics(summary, p, t, 1),
        report.summary_table(peaks, p), report.compare_with_norms(peaks, p), report.interpretation_gauges(peaks, p),
    ]
    for f in frames:
        f.collect()
    quality_rows = {r.test_id: r for r in frames[11].collect()}
    assert len(quality_rows) == 5 and quality_rows[2].plateau_detected is False
    assert {r.test_id for r in peaks.collect()} == {2, 3, 5}
    confidence = {r.test_id: r.confidence for r in frames[10].collect()}
    assert confidence[1] == "unable" and confidence[4] == "unable"


def test_analysis_keeps_every_test(spark, odd):
    p = people(spark, *[(i, 30, "M", 175, 70) for i in range(1, 6)])
    t = spark.createDataFrame([(i, "Bike") for i in range(1, 6)], "test_id bigint, protocol string")
    rows = {r.test_id: r for r in analyse(prepare(odd, ["time_s", "line"]).drop("line"), p, t).records.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].peaks is None and rows[5].n_stages == 1
