"""Rolling means of any width, incremental ingest, and the store: replacement, lookup, joins."""

from __future__ import annotations

import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tidalspan.operators.layout import index_rows
from tidalspan.operators.rolling import rolling, rolling_means
from tidalspan.sources import ledger, store

VALUES = "test_id bigint, time_s double, x double, k bigint"


def series(spark, sizes, k, seed=1):
    rng = random.Random(seed)
    rows = [(t, float(i), None if rng.random() < 0.1 else rng.uniform(-1e3, 1e3) / 3, k) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, VALUES)


@pytest.mark.parametrize("chunks", [None, "7"])
@pytest.mark.parametrize("align", ["center", "right"])
@pytest.mark.parametrize("k", [1, 5, 8, 1000])
def test_means_equal_those_of_frames(spark, chunks, align, k):
    if chunks:
        spark.conf.set("spark.tidalspan.chunkRows", chunks)
    try:
        df = index_rows(series(spark, {1: 60, 2: 3, 3: 41}, k), ["time_s"])
        values = lambda f: {(r.test_id, r.rn): r.x_roll for r in f(df, ["x"], "k", align).collect()}
        slow, fast = values(rolling), values(rolling_means)
        assert slow.keys() == fast.keys() and len(fast) == 104
        for key, v in slow.items():
            assert (v is None) == (fast[key] is None) and (v is None or abs(v - fast[key]) < 1e-9)
    finally:
        spark.conf.unset("spark.tidalspan.chunkRows")


def test_means_of_odd_values(spark):
    rows = [(1, float(i), v, 2) for i, v in enumerate([1.0, float("nan"), 2.0, 3.0, float("inf"), 4.0, 1e20, 5.0, None, 6.0, 8.0])]
    df = index_rows(spark.createDataFrame(rows, VALUES), ["time_s"])
    got = [r.x_roll for r in rolling_means(df, ["x"], "k", "right").orderBy("rn").collect()]
    assert [None if v is None else str(v) for v in got] == [None, "nan", "nan", "2.5", "nan", "nan", "nan", "nan", None, None, "7.0"]


def test_wide_windows_cost_no_more(spark):
    df = spark.range(60_000).select(F.lit(1).cast("bigint").alias("test_id"), F.col("id").cast("double").alias("time_s"), F.rand(1).alias("x"))
    df = index_rows(df, ["time_s"])

    def seconds(k):
        start = time.perf_counter()
        rolling_means(df.withColumn("k", F.lit(k).cast("bigint")), ["x"], "k").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(10)
    assert seconds(10_000) < 3 * min(seconds(10), seconds(10))  # a sliding frame would take a hundred times as long


def sheet(path, vo2, names=("t", "VO2", "VCO2", "VE", "RQ")):
    lines = [[""] * 9 + list(names), [""] * 9 + ["s"] * 5, [""] * 14] + [[""] * 9 + [str(v) for v in (i * 10, vo2 + i, 400, 15, 0.8)] for i in range(8)]
    lines[0][1] = path.stem
    path.write_text("\n".join(",".join(x) for x in lines) + "\n")


@pytest.fixture
def exports(tmp_path):
    (tmp_path / "in").mkdir()
    for name in "abc":
        sheet(tmp_path / "in" / f"{name}.csv", 500)
    return tmp_path


def test_only_new_and_changed_files_are_read(spark, exports, monkeypatch):
    given, kept = [], str(exports / "store")
    real = ledger.ingest
    monkeypatch.setattr(ledger, "ingest", lambda s, paths, day: given.append(sorted(os.path.basename(p) for p in paths)) or real(s, paths, day))
    take = lambda: ledger.ingest_new(spark, str(exports / "in"), kept)
    assert take() == 3 and take() == 0
    sheet(exports / "in" / "b.csv", 900)  # corrected
    os.utime(exports / "in" / "b.csv", (2e9, 2e9))
    sheet(exports / "in" / "d [1].csv", 700)
    assert take() == 2 and take() == 0
    assert given == [["a.csv", "b.csv", "c.csv"], ["b.csv", r"d \[1\].csv"]]
    rows = ledger.current(spark, kept, "breaths").collect()
    found = {}
    for r in rows:
        found.setdefault(os.path.basename(r.test_id), []).append((r.batch, r.vo2_ml))
    assert len(found) == 4
    assert {len(v) for v in found.values()} == {8} and {b for b, _ in found["b.csv"]} == {2} and min(v for _, v in found["b.csv"]) == 900
    whole = real(spark, str(exports / "in"), None)["breaths"]
    both = ["test_id", "source_row", "time_s", "vo2_ml", "rer"]
    assert sorted(map(tuple, whole.select(both).collect())) == sorted((r.test_id, r.source_row, r.time_s, r.vo2_ml, r.rer) for r in rows)


def test_broken_batch_is_invisible_and_repeated(spark, exports, monkeypatch):
    kept = str(exports / "store")
    ledger.ingest_new(spark, str(exports / "in"), kept)
    sheet(exports / "in" / "e.csv", 100)
    with monkeypatch.context() as m:
        m.setattr(ledger, "LEDGER", "broken")
        m.setattr(ledger, "read_ledger", lambda s, p, real=ledger.read_ledger: s.read.parquet(f"{p}/ledger"))
        with pytest.raises(Exception):
            ledger.ingest_new(spark, str(exports / "in"), kept)
    assert ledger.current(spark, kept, "breaths").select("test_id").distinct().count() == 3
    assert ledger.ingest_new(spark, str(exports / "in"), kept) == 1
    assert ledger.current(spark, kept, "breaths").select("test_id").distinct().count() == 4
    assert ledger.current(spark, kept, "breaths").count() == 32


def test_store_without_a_batch(spark, tmp_path):
    assert ledger.read_ledger(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        ledger.current(spark, str(tmp_path), "plots")


def some_tests(spark, ids, rows, value):
    return spark.createDataFrame([(t, r, float(r), value + t) for t in ids for r in range(1, rows + 1)], "test_id bigint, rn bigint, time_s double, vo2_ml double")


@pytest.fixture
def stored(spark, tmp_path):
    made = []

    def make(rows, **sizes):
        name = "t" + uuid.uuid4().hex
        made.append(name)
        store.create(rows, name, str(tmp_path / name), **{"folders": 8, "buckets": 2, **sizes})
        return name
    yield make
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_replaced_tests_equal_a_rebuild(spark, stored, tmp_path):
    name = stored(some_tests(spark, range(100), 20, 0.0))
    folders = lambda: {p: os.stat(p).st_mtime_ns for p in (tmp_path / name).glob("folder=*/*.parquet")}
    before = folders()
    again = some_tests(spark, [3, 7, 200], 5, 1000.0)
    store.replace_tests(again, name)
    wanted = some_tests(spark, [i for i in range(100) if i not in (3, 7)], 20, 0.0).union(again)
    columns = ["test_id", "rn", "time_s", "vo2_ml"]
    assert sorted(map(tuple, spark.table(name).select(columns).collect())) == sorted(map(tuple, wanted.collect()))
    touched = {r[0] for r in again.select(store.folder_of(F.col("test_id"), 8)).distinct().collect()}
    same = {p for p, t in before.items() if folders().get(p) == t}
    assert same == {p for p in before if int(p.parent.name.split("=")[1]) not in touched} and 0 < len(same) < len(before)
    store.replace_tests(again.where("false"), name)
    assert spark.table(name).count() == 98 * 20 + 15
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def scanned(df):
    """Rows that the scans of a plan put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.executedPlan() if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else leaf
        metric = leaf.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_lookup_reads_a_small_share(spark, stored):
    name = stored(some_tests(spark, range(0, 4000, 2), 50, 0.0), row_group_bytes=1 << 16)
    found = store.read_tests(spark, name, [10, 2222, 3, 10**9])
    assert sorted({r.test_id for r in found.collect()}) == [10, 2222] and found.count() == 100
    assert 100 <= scanned(store.read_tests(spark, name, [10, 2222, 3, 10**9])) < 100_000 / 10
    assert store.read_tests(spark, name, []).count() == 0


def test_join_of_stores_has_no_exchange(spark, stored):
    old, new = stored(some_tests(spark, range(50), 10, 0.0)), stored(some_tests(spark, range(25, 75), 10, 1.0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = store.compare(spark.table(old), spark.table(new), ["vo2_ml"])
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
        got = both.collect()
        assert len(got) == 250 and {r.vo2_ml_new - r.vo2_ml_old for r in got} == {1.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
