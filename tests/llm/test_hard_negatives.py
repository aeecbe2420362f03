"""Operator 13 against brute force, on rows with ties, repeats, nulls and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalspan.llm.hard_negatives import block_of, exact, mine_hard_negatives, threshold_search

SCHEMA = "vec_id long, embedding array<double>, label int, row long, positives string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=5):
    good = [(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = sorted(set(good))
    out = []
    for a in good:
        if a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
        by_score = sorted(good, key=lambda r: (-score(r), r[0]))
        for p in [r for r in by_score if r[1] == a[1] and r[0] != a[0]][:5]:
            window = [n for n in by_score if n[1] != a[1] and 50 * score(p) <= 100 * score(n) <= 95 * score(p)]
            out += [(a[0], p[0], k, n[0], score(p), score(n)) for k, n in enumerate(window[:3], 1)]
    return sorted(out)


def mined(spark, rows, every=5, **sizes):
    frame = spark.createDataFrame([(i, v, l, 1, "x") for i, v, l in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in mine_hard_negatives(frame, F.col("vec_id") % every == 0, **sizes).collect())


@pytest.mark.parametrize("coarse", [256, 2])
def test_brute_force(spark, coarse):
    rng = np.random.default_rng(coarse)
    rows = [(i, (np.round(rng.normal(0.3, 1, 6) * coarse) / coarse).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    wanted = brute(rows)
    assert len(wanted) > 100
    assert mined(spark, rows, block_rows=13, batch_rows=5) == wanted
    assert mined(spark, rows) == wanted


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0.5, 1, 4).tolist(), int(rng.integers(0, 2))) for i in range(40)]
    rows += [(0, rows[0][1], rows[0][2]), (7, rows[7][1], rows[7][2])]  # repeated
    rows += [(60, [0.0] * 4, 1), (65, [1.0], 0), (70, [], 1), (71, None, 1), (72, [1.0, None, 0.0, 0.0], 1), (73, [1.0, float("nan"), 0.0, 0.0], 0),
             (75, [1.0, float("inf"), 0.0, 0.0], 0), (80, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    assert mined(spark, rows, block_rows=9, batch_rows=2) == brute(rows)


def test_equal_vectors(spark):
    rows = [(i, [1.0, -0.5, 0.25], i % 3) for i in range(30)] + [(i, [0.9, -0.5, 0.2], i % 3) for i in range(30, 60)]
    assert mined(spark, rows, block_rows=8, batch_rows=2) == brute(rows)


def test_very_large_components(spark):
    rows = [(i, [float(1 << (i % 15)), 1000.0 * i], i % 2) for i in range(20)]
    assert mined(spark, rows, block_rows=8) == brute(rows)
    assert mined(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [7e29], 0)]) == []


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1)]) == []


def test_stops_early_but_not_too_early():
    rng = np.random.default_rng(4)
    values = rng.integers(-300, 300, (500, 2))
    block = block_of(np.arange(500), np.arange(500), np.zeros(500), values)
    for anchor in exact(rng.integers(-300, 300, (50, 2))):
        (found,), scores = threshold_search(block, anchor, np.ones(500, bool), [(-(1 << 62), 1 << 62)], 3)
        true = values @ anchor.astype(np.int64)
        assert found.tolist() == np.lexsort((np.arange(500), -true))[:3].tolist()
        assert (scores == 0).mean() > 0.2  # most rows are never scored
