"""Grid files in, tables out; export back to files."""

from __future__ import annotations

from datetime import date

import pytest
from helpers import breaths
from pyspark.sql import functions as F

from tidalspan.operators.layout import index_rows, prepare
from tidalspan.operators.peaks import find_peaks
from tidalspan.sources import export, grid

HEAD = ["t", "VO2", "VCO2", "VE", "RQ", "HR", "Phase"]


def write_grid(path, names=HEAD, rows=(), who=("A1", "Doe", "Jane", "Female", "41", "168", "", "1980-02-03")):
    lines = [[""] * 9 + list(names), [""] * 9 + ["s"] * len(names), [""] * (9 + len(names))]
    lines += [[""] * 9 + [str(v) for v in r] for r in rows]
    while len(lines) < 8:
        lines.append([""] * (9 + len(names)))
    for i, v in enumerate(who):
        lines[i][1] = v
    lines[0][4], lines[6][4], lines[7][4] = "2024-05-06", "Bike", "Ramp 20"
    lines[0][7], lines[1][7], lines[2][7] = "760", "-", "45"
    path.write_text("\n".join(",".join(line) for line in lines) + "\n")


@pytest.fixture(params=["plain", "split"])
def folder(request, spark, tmp_path):
    if request.param == "split":
        spark.conf.set("spark.tidalspan.chunkRows", "6")
    rows = [[i * 10 / 86400, 500 + i, 400 + i, 15, 0.8, 100 if i % 2 else "", "REST"] for i in range(12)]
    rows[5][1] = ""  # incomplete row
    write_grid(tmp_path / "a.csv", rows=rows)
    write_grid(tmp_path / "b.csv", names=["t", "VO2", "VE"], rows=[[1, 2, 3]], who=("",) * 8)
    yield str(tmp_path)
    spark.conf.unset("spark.tidalspan.chunkRows")


def test_ingest(spark, folder):
    made = grid.ingest(spark, folder, date(2020, 1, 1))
    people = {r.test_id.rsplit("/", 1)[1]: r for r in made["participants"].collect()}
    a, b = people["a.csv"], people["b.csv"]
    assert (a.participant_id, a.name, a.sex, a.age, a.height_cm, a.weight_kg, a.date_of_birth) == (
        "A1", "Jane Doe", "F", 41, 168, 70, date(1980, 2, 3))
    assert (b.participant_id, b.name, b.sex, b.age) == ("Unknown", "Unknown", "O", 30)
    test = made["tests"].where(F.col("test_id").endswith("a.csv")).first()
    assert (test.test_date, test.protocol, test.pressure_mmhg, test.temperature_c, test.humidity_pct) == (
        date(2024, 5, 6), "Ramp 20", 760, None, 45)
    rows = made["breaths"].orderBy("time_s").collect()
    assert len(rows) == 11 and round(rows[1].time_s) == 10 and rows[0].hr_bpm is None and rows[1].hr_bpm == 100
    assert rows[0].phase == "REST" and rows[0].power_w is None
    rejects = made["rejects"].collect()
    assert [(r.test_id[-5:], r.reason) for r in rejects] == [("b.csv", "missing columns: vco2_ml, rer")]


def test_unsupported_format(spark, folder):
    formats = grid.detect_format(grid.read_grids(spark, folder), given="Cortex")
    assert not formats.first().supported


def test_export(spark, tmp_path):
    df = index_rows(breaths(spark, [{"time_s": i} for i in range(20)]), ["time_s"])
    for fmt in ("csv", "parquet"):
        export.export_breaths(df, str(tmp_path / fmt), fmt, folders=4)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 20
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 20
    with pytest.raises(ValueError):
        export.export_breaths(df, str(tmp_path / "x"), "pdf")


def test_stored_breaths_need_no_exchange(spark, tmp_path):
    df = prepare(breaths(spark, [{"time_s": i * 5, "vo2_ml": 300 + 3 * i} for i in range(40)]))
    expected = find_peaks(df).first()
    table = export.store_breaths(df, "stored_breaths", str(tmp_path / "store"), buckets=4)
    try:
        peaks = find_peaks(table)
        assert peaks.first() == expected
        assert "Exchange" not in peaks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE stored_breaths")


@pytest.mark.parametrize("chunk", [None, "6"])
def test_odd_sheets(spark, tmp_path, chunk):
    """An empty line keeps its place, columns may stand far to the right, and each file has its own format."""
    if chunk:
        spark.conf.set("spark.tidalspan.chunkRows", chunk)
    try:
        rows = [[i, 500 + i, 400 + i, 15, *[""] * 70, 0.8, f'"a, ""b"" {i}"'] for i in range(12)]
        write_grid(tmp_path / "wide.csv", names=["t", "VO2", "VCO2", "VE", *[""] * 70, "RQ", "Marker"], rows=rows)
        text = (tmp_path / "wide.csv").read_text().split("\n")
        text[2] = ""  # the line of the first name and the humidity
        text.insert(9, "")
        (tmp_path / "wide.csv").write_text("\n".join(text))
        write_grid(tmp_path / "other.TXT", rows=[[i, 500, 400, 15, 0.8, 100, "REST"] for i in range(12)])
        made = grid.ingest(spark, str(tmp_path), date(2020, 1, 1))
        who = made["participants"].collect()
        assert [(r.name, r.sex, r.age, r.height_cm) for r in who] == [("Doe", "F", 41, 168)]
        test = made["tests"].first()
        assert (test.pressure_mmhg, test.humidity_pct, test.protocol) == (760, None, "Ramp 20")
        got = made["breaths"].orderBy("time_s").collect()
        assert [round(r.vo2_ml) for r in got] == [500 + i for i in range(12)] and {r.rer for r in got} == {0.8}
        assert [r.source_row for r in got] == [4, 5, 6, 7, 8, 9, *range(11, 17)] and got[3].marker == 'a, "b" 3'
        assert [(r.test_id[-9:], r.reason) for r in made["rejects"].collect()] == [("other.TXT", "unsupported format: unknown")]
    finally:
        spark.conf.unset("spark.tidalspan.chunkRows")


def test_equal_gaps_of_a_split_test_are_spread(spark):
    df = breaths(spark, [{"time_s": float(i)} for i in range(400)]).repartition(4)
    spark.conf.set("spark.tidalspan.chunkRows", "50")
    try:
        found = grid.detect_data_type(df).collect()
    finally:
        spark.conf.unset("spark.tidalspan.chunkRows")
    assert [(r.median_gap, r.is_averaged) for r in found] == [(1.0, False)]


def test_equal_times_have_one_order(spark):
    rows = [{"time_s": float(i // 3), "vo2_ml": 500.0 + (i * 37) % 11, "phase": f"p{i % 4}"} for i in range(60)]
    one = [prepare(breaths(spark, rows).repartition(n)).orderBy("rn").select("vo2_ml", "phase").collect() for n in (1, 8)]
    assert one[0] == one[1]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"test_id={i}").mkdir()
        (tmp_path / f"test_id={i}" / "a.csv").write_text("1,2\n3\n")
    sc, conf = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual = spark.conf.get(conf)
    sc.setJobGroup("many folders", "")
    try:
        assert grid.read_grids(spark, str(tmp_path)).count() == 140
        tracker = sc.statusTracker()
        found = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup("many folders") for i in tracker.getJobInfo(job).stageIds]
        assert found and max(i.numTasks for i in found if i) <= 4 * sc.defaultParallelism
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(conf) == usual


def test_names_of_columns_are_looked_up_once_per_sheet(spark, tmp_path):
    write_grid(tmp_path / "a.csv", rows=[[i, 500, 400, 15, 0.8, 100, "REST"] for i in range(12)])
    grids = grid.read_grids(spark, str(tmp_path))
    plan = grid.parse_breaths(grids)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    looked_up = [x for x in plan if "array_position" in x]
    assert looked_up and all("CASE WHEN (row" in x and "CASE WHEN (array_position" not in x for x in looked_up)
