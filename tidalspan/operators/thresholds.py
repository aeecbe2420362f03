"""Ventilatory thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KEY
from .layout import attach, framed, prepare, rank_rows, spread
from .rolling import rolling

SUSTAIN = 5  # consecutive rows that must stay beyond the limit
CHANGE = 0.05  # relative rise or drop
CANDIDATES = 30  # split points tried by the V-slope method

VT1_METHODS = ["v_slope", "ve_vo2", "peto2"]
VT2_METHODS = ["ve_vco2", "petco2"]
DEFAULT_METHODS = ["v_slope", "ve_vo2", "ve_vco2"]

_SERIES = {"ve_vo2": "rise", "peto2": "rise", "ve_vco2": "rise", "petco2": "drop"}


def smooth_for_thresholds(breaths: DataFrame, window_s: float = 30.0) -> DataFrame:
    """Smoothed VO2, VCO2, VE, PETO2, PETCO2 (suffix ``_s``) and the derived series.

    k = min(max(5, round(window / interval)), n div 2); series stay raw for k < 5.
    Tests with fewer than 20 rows are left out.
    """
    df = prepare(breaths)
    df = df.where(F.col("n") >= 20)
    gap = F.when(F.col("interval") > 0, F.col("interval")).otherwise(F.lit(1.0))
    wanted = F.greatest(F.lit(5.0), F.rint(F.lit(float(window_s)) / gap))
    df = df.withColumn("_k", F.least(wanted, F.floor(F.col("n") / 2)).cast("bigint"))
    source = {"vo2_s": "vo2_ml", "vco2_s": "vco2_ml", "ve_s": "ve_l", "peto2_s": "peto2_mmhg", "petco2_s": "petco2_mmhg"}
    for c in source.values():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    df = rolling(df, list(source.values()), "_k")
    smooth = {s: F.when(F.col("_k") >= 5, F.col(c + "_roll")).otherwise(F.col(c)) for s, c in source.items()}
    df = df.withColumns(smooth).drop("_k", *[c + "_roll" for c in source.values()])
    return df.withColumns({
        "ve_vo2_s": F.col("ve_s") * 1000 / F.nullif(F.col("vo2_s"), F.lit(0.0)),
        "ve_vco2_s": F.col("ve_s") * 1000 / F.nullif(F.col("vco2_s"), F.lit(0.0)),
    })


def _turning_points(series: dict[str, str]) -> dict[str, Column]:
    """Per-test aggregates: first minimum (rise) or maximum (drop) of each series."""
    found = {}
    for c, kind in series.items():
        sign = 1 if kind == "rise" else -1
        found[f"_turn_{c}"] = F.min(F.when(F.col(c).isNotNull(), F.struct((F.col(c) * sign).alias("v"), F.col("rn"))))
    return found


def _mark_changes(df: DataFrame, series: dict[str, str]) -> DataFrame:
    """Add ``_hit_<column>``: (row, smoothed VO2) where a sustained change starts, else null."""

    def following(part: list[str]) -> dict[str, Column]:
        ahead = W.partitionBy(*part).orderBy("rn").rowsBetween(0, SUSTAIN - 1)
        out = {}
        for c, kind in series.items():
            worst = F.min(c) if kind == "rise" else F.max(c)
            out[f"_worst_{c}"] = worst.over(ahead)
            out[f"_seen_{c}"] = F.count(c).over(ahead)
        return out

    df = framed(df, following, SUSTAIN)
    hits = {}
    for c, kind in series.items():
        turn = F.col(f"_turn_{c}")
        if kind == "rise":
            reached = F.col(f"_worst_{c}") >= turn["v"] * (1 + CHANGE)
        else:
            reached = F.col(f"_worst_{c}") <= -turn["v"] * (1 - CHANGE)
        enough = (F.col("n") >= SUSTAIN + 5) & (F.col(f"_seen_{c}") == SUSTAIN)
        hits[f"_hit_{c}"] = F.when(
            enough & (F.col("rn") > turn["rn"]) & reached, F.struct(F.col("rn").alias("row"), F.col("vo2_s").alias("vo2"))
        )
    return df.withColumns(hits)


def sustained_changes(smooth: DataFrame, series: dict[str, str]) -> DataFrame:
    """First row after the turning point where the change is sustained.

    ``series`` maps a column to ``rise`` (after the first minimum, 5 consecutive values
    >= 1.05 times it) or ``drop`` (after the first maximum, 5 values <= 0.95 times it).
    One row per test with ``<column>_row`` and ``<column>_vo2`` (smoothed VO2 there).
    """
    marked = _mark_changes(attach(smooth, _turning_points(series)), series)
    first = marked.groupBy(KEY).agg(*[F.min(f"_hit_{c}").alias(f"_hit_{c}") for c in series])
    return first.select(KEY, *[
        F.col(f"_hit_{c}.{part}").alias(f"{c}_{part}") for c in series for part in ("row", "vo2")
    ])


def _paired() -> Column:
    return F.col("vo2_s").isNotNull() & F.col("vco2_s").isNotNull()


def _pair_values() -> dict[str, Column]:
    """Per-test aggregates over the rows with both gases: count and means."""
    both = _paired()
    return {
        "_m": F.count_if(both),
        "_mx": F.avg(F.when(both, F.col("vo2_s"))),
        "_my": F.avg(F.when(both, F.col("vco2_s"))),
    }


def _mark_segments(df: DataFrame) -> DataFrame:
    """Add ``_seg``: number of candidate splits below the row's VO2 rank, -1 for unusable rows.

    Candidate z is round(low + z * (high - low) / 29) with low, high the 20 % and 80 %
    ranks.  A fraction of 29ths is never one half, so "candidate < rank" is
    "low + z * (high - low) / 29 < rank - 1/2" and the count has a closed form.
    """
    df = df.withColumn("_absent", ~_paired())
    df = rank_rows(df, ["_absent", "vo2_s", "rn"], "_r")
    low, high = F.floor(F.col("_m") * 0.2), F.floor(F.col("_m") * 0.8)
    below = F.ceil(F.try_divide((F.col("_r") - 0.5 - low) * (CANDIDATES - 1), high - low))
    segment = F.least(F.greatest(below, F.lit(0)), F.lit(CANDIDATES)).cast("int")
    return df.withColumn("_seg", F.when(_paired() & (F.col("_m") >= 20), segment).otherwise(-1))


# Sufficient statistics of a line fit, relative to the test means for stable sums.
_SUMS = {
    "c": "count(1)", "sx": "sum(vo2_s - _mx)", "sy": "sum(vco2_s - _my)",
    "sxx": "sum((vo2_s - _mx) * (vo2_s - _mx))", "sxy": "sum((vo2_s - _mx) * (vco2_s - _my))",
    "syy": "sum((vco2_s - _my) * (vco2_s - _my))",
}


def _sse(side: str) -> Column:
    """Residual sum of squares of the line fit left (``l``) or right (``r``) of a split."""
    n, sx, sy, sxx, sxy, syy = (F.col(f"{side}_{k}") for k in _SUMS)
    xx, xy, yy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    return F.greatest(F.when(xx > 0, yy - xy * xy / xx).otherwise(yy), F.lit(0.0))


def _with_errors(segments: DataFrame) -> DataFrame:
    """Add ``split``: (total error, left rows, VO2) of the split after each segment, else null."""
    upto = W.partitionBy(KEY).orderBy("_seg").rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy(KEY).orderBy(F.desc("_seg")).rowsBetween(W.unboundedPreceding, -1)
    inside = lambda k: F.when(F.col("_seg") >= 0, F.col(k))
    sums = segments.select(
        "*",
        *[F.sum(inside(k)).over(upto).alias("l_" + k) for k in _SUMS],
        *[F.sum(inside(k)).over(rest).alias("r_" + k) for k in _SUMS],
    )
    usable = F.col("_seg").between(0, CANDIDATES - 1) & (F.col("l_c") >= 5) & (F.col("l_c") <= F.col("_m") - 5)
    error = (_sse("l") + _sse("r")).alias("sse")
    return sums.withColumn("split", F.when(usable, F.struct(error, F.col("l_c").alias("row"), F.col("_vo2").alias("vo2"))))


def _segment_sums() -> list[Column]:
    return [*[F.expr(e).alias(k) for k, e in _SUMS.items()], F.max("vo2_s").alias("_vo2")]


def v_slope(smooth: DataFrame) -> DataFrame:
    """Smoothed VO2 at the split of (VO2, VCO2) into two lines with least error.

    Rows are ranked by VO2; the 30 candidate splits cut them into at most 31 segments.
    One sum per segment is enough: the error left and right of every candidate follows
    from running totals over the segments, so no row-level running fit is needed.
    """
    df = _mark_segments(attach(smooth, _pair_values()))
    segments = df.where(F.col("_seg") >= 0).groupBy(KEY, "_m", "_seg").agg(*_segment_sums())
    best = _with_errors(segments).groupBy(KEY).agg(F.min("split").alias("_best")).where(F.col("_best").isNotNull())
    return best.select(
        KEY, F.col("_best.row").alias("split_row"), F.col("_best.vo2").alias("v_slope_vo2"), F.col("_best.sse").alias("sse")
    )


def threshold_candidates(smooth: DataFrame, methods: Sequence[str]) -> DataFrame:
    """VO2 candidate of each method (``cand_<method>``), all from one pass over the rows."""
    series = {f"{m}_s": kind for m, kind in _SERIES.items() if m in methods}
    split = "v_slope" in methods
    df = attach(smooth, {**_turning_points(series), **(_pair_values() if split else {})})
    if series:
        df = _mark_changes(df, series)
    hits = [F.min(f"_hit_{c}").alias(f"_hit_{c}") for c in series]
    if split:
        parts = _mark_segments(df).groupBy(KEY, "_m", "_seg").agg(*_segment_sums(), *hits)
        df = _with_errors(parts)
        hits = [*hits, F.min("split").alias("_hit_v_slope_s")]
    found = df.groupBy(KEY).agg(*hits) if hits else df.select(KEY).distinct()
    return found.select(KEY, *[
        F.col(f"_hit_{m}_s.vo2").alias(f"cand_{m}") for m in (*VT1_METHODS, *VT2_METHODS) if m in methods
    ])


def nearest_values(breaths: DataFrame, targets: DataFrame, target: str, values: Sequence[str]) -> DataFrame:
    """Values of the breath whose VO2 is nearest to the target, first on ties."""
    df = spread(breaths, targets.select(KEY, target), "inner")
    distance = F.abs(F.col("vo2_ml") - F.col(target))
    key = F.when(distance.isNotNull(), F.struct(distance, F.col("rn")))
    return df.groupBy(KEY).agg(*[F.min_by(v, key).alias(v) for v in values])


def _median_of(values: list[Column]) -> Column:
    known = F.array_sort(F.array_compact(F.array(*values)))
    m = F.size(known)
    low, high = F.floor((m - 1) / 2).cast("int"), F.floor(m / 2).cast("int")
    return F.when(m > 0, (F.get(known, low) + F.get(known, high)) / 2)


def _check(methods: Sequence[str]) -> None:
    unknown = [m for m in methods if m not in {*VT1_METHODS, *VT2_METHODS}]
    if unknown:
        raise ValueError(f"unknown threshold methods: {unknown}")


def combine_candidates(candidates: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Medians, the VT2 > VT1 rule, method names and confidence from ``cand_*`` columns.

    Only candidates that were found count.  A VT2 not above VT1 is dropped together
    with its candidates.
    """
    _check(methods)
    first = [m for m in VT1_METHODS if m in methods]
    second = [m for m in VT2_METHODS if m in methods]

    def column(m: str) -> Column:
        return F.col(f"cand_{m}")

    def median(names: list[str]) -> Column:
        return _median_of([column(m) for m in names]) if names else F.lit(None).cast("double")

    def named(names: list[str]) -> Column:
        parts = [F.when(column(m).isNotNull(), m) for m in names]
        return F.nullif(F.concat_ws(", ", *parts), F.lit("")) if parts else F.lit(None).cast("string")

    def found(names: list[str]) -> Column:
        total = F.lit(0)
        for m in names:
            total = total + column(m).isNotNull().cast("int")
        return total

    df = candidates.withColumns({"vt1_vo2": median(first), "_vt2": median(second)})
    dropped = F.coalesce(F.col("_vt2") <= F.col("vt1_vo2"), F.lit(False))
    count = found(first) + F.when(dropped, 0).otherwise(found(second))
    confidence = F.when(count >= 3, "high").when(count == 2, "moderate").when(count == 1, "low").otherwise("unable")
    return df.withColumns({
        "vt1_method": named(first),
        "vt2_vo2": F.when(~dropped, F.col("_vt2")),
        "vt2_method": F.when(~dropped, named(second)),
        "confidence": confidence,
    }).drop("_vt2")


def detect_thresholds(
    breaths: DataFrame, methods: Sequence[str] = tuple(DEFAULT_METHODS), window_s: float = 30.0
) -> DataFrame:
    """VT1 and VT2 with heart rate and power at them, one row per test.

    Tests with fewer than 20 rows get ``confidence = unable`` and nulls.
    """
    df = prepare(breaths)
    _check(methods)
    candidates = threshold_candidates(smooth_for_thresholds(df, window_s), methods)
    verdict = ["vt1_vo2", "vt1_method", "vt2_vo2", "vt2_method", "confidence"]
    found = combine_candidates(candidates, methods).select(KEY, *verdict)
    rows = spread(df.select(KEY, "rn", "vo2_ml", "hr_bpm", "power_w"), found)
    lookups = []
    for t in ("vt1", "vt2"):
        distance = F.abs(F.col("vo2_ml") - F.col(f"{t}_vo2"))
        key = F.when(distance.isNotNull(), F.struct(distance, F.col("rn")))
        lookups += [F.min_by("hr_bpm", key).alias(f"{t}_hr"), F.min_by("power_w", key).alias(f"{t}_power")]
    # The verdict is constant within a test, so grouping by it keeps one row per test.
    values = rows.groupBy(KEY, *verdict).agg(*lookups)
    values = values.withColumn("confidence", F.coalesce("confidence", F.lit("unable")))
    return values.select(
        KEY, "vt1_vo2", "vt1_hr", "vt1_power", "vt1_method", "vt2_vo2", "vt2_hr", "vt2_power", "vt2_method", "confidence"
    )
