"""Functions of SQL text, batch counters and smooth curves."""

from __future__ import annotations

import numpy as np
import pytest
from check_oracle import compare, connect
from helpers import breaths, people
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidalspan.functions import scalars, sql_functions
from tidalspan.operators.layout import prepare
from tidalspan.plans import analysis, batch
from tidalspan.plans.smooth import smooth_curve
from tidalspan.sources import stand_ins

FOLDER = "/root/testdata/sf0.001"


def test_sql_functions_equal_columns(spark):
    rows = [(a, b, c) for a in (None, -1.0, 0.0, 19.9, 20.0, 59.99, 74.6, 90.0, 3599.5) for b in (None, 0.0, 7.3) for c in (None, 0.6, 0.95, 1.4)]
    spark.createDataFrame(rows, "a double, b double, c double").createOrReplaceTempView("odd_values")
    assert set(sql_functions.register(spark)) == {"running_economy", "gross_efficiency", "age_group", "score_rating", "duration_text", "heart_rate_zones"}
    text = spark.sql("SELECT running_economy(a, b), gross_efficiency(a, b, c), age_group(a), score_rating(a), duration_text(a) FROM odd_values")
    a, b, c = (F.col(x) for x in "abc")
    column = spark.table("odd_values").select(scalars.running_economy(a, b), scalars.gross_efficiency(a, b, c), scalars.age_group(a), scalars.rating(a), scalars.duration_text(a))
    assert [tuple(r) for r in text.collect()] == [tuple(r) for r in column.collect()]
    assert "Python" not in text._jdf.queryExecution().executedPlan().toString()
    zones = spark.sql("SELECT t.x, z.* FROM (VALUES (1, 30D, 185D), (2, 50D, NULL), (3, 20D, 210D)) AS t(x, age, peak), LATERAL heart_rate_zones(t.age, t.peak) z ORDER BY x, zone_pct").collect()
    assert [(r.x, r.hr_reference, r.zone_pct) for r in zones] == [(x, ref, p) for x, ref in ((1, 190), (3, 210)) for p in (50, 60, 70, 80, 90, 100)]
    assert zones[0].zone_bpm == 95


def test_counters_equal_what_is_written(spark, tmp_path):
    rows = breaths(spark, [{"time_s": i * 5, "vo2_ml": 300 + 4 * i, "power_w": 25 * (i // 20), "phase": "EXERCISE"} for i in range(80)], 1)
    rows = rows.unionByName(breaths(spark, [{"time_s": 0}], 2))
    who = people(spark, *[(i, 30, "M", 175, 70) for i in (1, 2, 3)])
    tests = spark.createDataFrame([(i, "Bike") for i in (1, 2, 3)], "test_id bigint, protocol string")
    done = analysis.analyse(rows, who, tests)
    rejects = spark.createDataFrame([(9, "no complete rows")], "test_id bigint, reason string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("batch", "")
    found = batch.write_batch(done, str(tmp_path / "out"), rejects)
    with_counters = len(jobs.getJobIdsForGroup("batch"))
    spark.sparkContext.setJobGroup("plain", "")
    for name, frame in (("records", done.records), ("stages", done.stages), ("rejects", rejects)):
        frame.write.parquet(str(tmp_path / "plain" / name))
    assert with_counters <= len(jobs.getJobIdsForGroup("plain"))  # not one job more
    spark.sparkContext.setJobGroup("tests", "")
    records = spark.read.parquet(str(tmp_path / "out" / "records"))
    assert found["tests"] == records.count() == 3 and found["rejected"] == 1
    assert found["invalid"] == records.where("not validation.is_valid").count()
    assert found["not_validated"] == records.where("validation is null").count() and found["without_peak"] == records.where("peaks.vo2_peak is null").count()
    assert found["without_threshold"] == records.where("thresholds.vt1_vo2 is null").count() and found["stages"] == spark.read.parquet(str(tmp_path / "out" / "stages")).count()


def loess(x, y, at, span=0.75):
    q = int(np.floor(len(x) * span + 1e-5))
    d = np.abs(x - at)
    reach = np.sort(d)[q - 1]
    u = np.where(reach > 0, (x - at) / (reach or 1), np.where(d == 0, 0, 2))
    w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
    keep = w > 0
    degree = min(2, len(set(x[keep])) - 1)
    m = np.vander(u[keep], degree + 1, increasing=True)
    root = np.sqrt(w[keep])
    return np.linalg.lstsq(m * root[:, None], y[keep] * root, rcond=None)[0][0]


@pytest.mark.parametrize("chunks", [None, "9"])
def test_curve_equals_weighted_least_squares(spark, chunks):
    rng = np.random.default_rng(2)
    data = {(1, "a"): (np.sort(rng.uniform(0, 10, 60)), rng.normal(size=60)), (1, "b"): (np.arange(12.0), np.arange(12.0) ** 2), (2, "a"): (np.repeat([1.0, 2.0], 8), rng.normal(size=16)),
            (3, "a"): (np.full(6, 4.0), np.arange(6.0)), (4, "a"): (np.array([1.0, 2.0]), np.array([1.0, 2.0]))}
    rows = [(t, v, float(x), float(y)) for (t, v), (xs, ys) in data.items() for x, y in zip(xs, ys)] + [(1, "a", None, 1.0), (1, "a", 3.0, None)]
    if chunks:
        spark.conf.set("spark.tidalspan.chunkRows", chunks)
    try:
        got = smooth_curve(spark.createDataFrame(rows, "test_id bigint, variable string, x double, y double"), grid=20).collect()
    finally:
        spark.conf.unset("spark.tidalspan.chunkRows")
    assert {(r.test_id, r.variable) for r in got} == set(data) - {(4, "a")} and len(got) == 80
    for r in got:
        x, y = data[(r.test_id, r.variable)]
        assert abs(r.x - (x.min() + (x.max() - x.min()) * r.place / 19)) < 1e-12
        if r.test_id != 2 or r.place in (0, 19):  # between two values of x the parabola is not unique
            assert abs(r.y - loess(x, y, r.x)) < 1e-6, r


def test_curve_wants_sense(spark):
    with pytest.raises(ValueError):
        smooth_curve(spark.createDataFrame([], "test_id bigint, variable string, x double, y double"), span=0)


def test_rows_of_a_task_do_not_grow_with_the_table(spark):
    spark.conf.set("spark.tidalspan.taskRows", "10")
    try:
        rows = prepare(stand_ins.breaths(spark, FOLDER))
        parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"), F.count_distinct("test_id").alias("tests"))
        got = parts.agg(F.count("*"), F.sum("tests")).first()
        assert got[0] > 8 and got[1] == rows.select("test_id").distinct().count()
        for name in ("a7_find_peaks", "c3_detect_thresholds", "d4_smooth_curve"):
            assert compare(spark, connect(FOLDER), FOLDER, name) is None
    finally:
        spark.conf.unset("spark.tidalspan.taskRows")


def test_parts_of_an_analysis_do_not_share_a_task(spark):
    done = analysis.analyse(stand_ins.breaths(spark, FOLDER), stand_ins.participants(spark, FOLDER), stand_ins.tests(spark, FOLDER))
    for df in (done.records, done.stages):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    for name in ("d2_v_slope_series", "c20_report_record"):
        assert "_seg" not in queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
