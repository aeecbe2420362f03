"""Stage extraction, stage summaries and protocol detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..schema import KEY, signals
from .layout import (
    attach, carried, carry_forward, framed, is_split, medians, prepare, rank_rows, running_sum, spread, with_chunks,
)
from .rolling import rolling

EXERCISE_PHASES = "exercise|warmup|work|exer"
REST_PHASES = "rest|recovery|cool"


def power_increment(breaths: DataFrame, power: str = "power_w") -> DataFrame:
    """Typical step between distinct positive power values, one row per test.

    Half-even median of the steps above 5 W, to the nearest 5 W, at least 10 W; 25 W
    with fewer than two levels or no such step.  Tests without power yield no row.
    """
    levels = breaths.where(F.col(power).isNotNull()).select(KEY, power, *carried(breaths)).distinct()
    if is_split(levels):
        levels = with_chunks(rank_rows(levels, [power], "_i"), "_i")
        lag = lambda part: {"_prev": F.lag(power).over(W.partitionBy(*part).orderBy("_i"))}
        levels = framed(levels, lag, 1, "_i")
    else:
        levels = levels.withColumn("_prev", F.lag(power).over(W.partitionBy(KEY).orderBy(power)))
    step = F.col(power) - F.col("_prev")
    levels = levels.withColumn("_step", F.when((F.col("_prev") > 0) & (step > 5), step))
    increment = F.greatest(F.rint(F.col("_typical") / 5) * 5, F.lit(10.0))
    return medians(levels, "_step", "_typical").select(
        KEY, F.when(F.col("_typical").isNotNull(), increment).otherwise(F.lit(25.0)).alias("power_increment")
    )


def power_levels(breaths: DataFrame, power: str = "power_w", into: str = "power_rounded") -> DataFrame:
    """Add power rounded to the test's increment (null without power)."""
    df = spread(breaths, power_increment(breaths, power))
    step = F.col("power_increment")
    return df.withColumn(into, F.rint(F.col(power) / step) * step)


def _stage_of_level(df: DataFrame) -> DataFrame:
    """Stage = rank of the positive power level within the test, otherwise 0."""
    level = F.when(F.col("power_rounded") > 0, F.col("power_rounded"))
    df = df.withColumn("_level", level)
    if is_split(df):
        levels = df.where(F.col("_level").isNotNull()).select(KEY, "_level", *carried(df)).distinct()
        ranks = rank_rows(levels, ["_level"], "_rank").select(KEY, "_level", "_rank")
        df = df.join(ranks, [KEY, "_level"], "left").select(*df.columns, "_rank")
    else:
        rank = F.dense_rank().over(W.partitionBy(KEY).orderBy(F.asc_nulls_last("_level")))
        df = df.withColumn("_rank", rank)
    stage = F.when(F.col("_level").isNotNull(), F.col("_rank")).otherwise(0).cast("int")
    return df.withColumn("_stage_power", stage).drop("_level", "_rank")


def ramp_power(df: DataFrame, stage_duration: float) -> DataFrame:
    """Power smoothed over min(30, max(10, duration / 6)) s; raw value at the edges.

    Smoothing runs over the rows that have power.
    """
    seconds = min(30.0, max(10.0, stage_duration / 6))
    powered = df.where(F.col("power_w").isNotNull())
    powered = with_chunks(rank_rows(powered, ["rn"], "_pn"), "_pn")
    powered = attach(powered, {
        "_m": F.count(F.lit(1)), "_t0": F.min("time_s"), "_t1": F.max("time_s"),
    })
    gap = ratio(F.col("_t1") - F.col("_t0"), F.col("_m") - 1)
    gap = F.when(gap > 0, gap).otherwise(F.lit(1.0))
    width = F.least(F.greatest(F.lit(5.0), F.rint(F.lit(seconds) / gap)), F.col("_m"))
    powered = powered.withColumn("_k", width.cast("bigint"))
    powered = rolling(powered, ["power_w"], "_k", index="_pn")
    used = F.when(F.col("_k") >= 5, F.coalesce("power_w_roll", "power_w")).otherwise(F.col("power_w"))
    smooth = powered.select(KEY, "rn", used.alias("power_used"))
    return df.join(smooth, [KEY, "rn"], "left")


def stages_from_power(breaths: DataFrame, protocol: str = "step", stage_duration: float = 180.0) -> DataFrame:
    """W11 (step, auto) and W12 (ramp): one stage per positive power level.

    Rows without power or at level 0 are stage 0, "Rest".
    """
    df = prepare(breaths)
    if protocol == "ramp":
        df = power_levels(ramp_power(df, stage_duration), "power_used").drop("power_used")
    else:
        df = power_levels(df)
    df = _stage_of_level(df).withColumnRenamed("_stage_power", "stage")
    return df.withColumn("stage_name", _stage_name(F.col("stage")))


def _stage_name(stage: Column) -> Column:
    return F.when(stage == 0, "Rest").otherwise(F.concat(F.lit("Stage "), stage.cast("string")))


def _time_stage(stage_duration: float) -> Column:
    number = F.ceil((F.col("time_s") - F.col("t_first")) / F.lit(float(stage_duration)))
    return F.greatest(number, F.lit(1)).cast("int")


def stages_by_time(breaths: DataFrame, stage_duration: float = 180.0) -> DataFrame:
    """Consecutive stages of fixed duration from the first breath."""
    df = prepare(breaths).withColumn("stage", _time_stage(stage_duration))
    return df.withColumn("stage_name", _stage_name(F.col("stage")))


def exercise_rows(breaths: DataFrame) -> DataFrame:
    """rows of the exercise part by phase name.

    Rows whose phase names exercise; in tests without any, rows whose phase is not
    rest, recovery or cool-down.
    """
    return _mark_exercise(breaths).where(F.col("_exercise")).drop("_exercise")


def _mark_exercise(df: DataFrame) -> DataFrame:
    phase = F.lower("phase")
    named, other = phase.rlike(EXERCISE_PHASES), ~phase.rlike(REST_PHASES)
    df = attach(df, {"_any": F.bool_or(named)})
    chosen = F.when(F.col("_any"), named).otherwise(other)
    return df.withColumn("_exercise", F.coalesce(chosen, F.lit(False))).drop("_any")


def _phase_stage(df: DataFrame, stage_duration: float) -> DataFrame:
    """W13 columns: _stage_phase, _phase_stages (number of stages, null without exercise rows)."""
    during = F.when(F.col("_exercise"), F.col("time_s"))
    df = attach(_mark_exercise(df), {"_start": F.min(during), "_end": F.max(during)})
    length = F.lit(float(stage_duration))
    df = df.withColumn("_phase_stages", F.ceil((F.col("_end") - F.col("_start")) / length))
    t = F.col("time_s")
    stage = (
        F.when(t < F.col("_start"), 0)
        .when(t > F.col("_end"), F.col("_phase_stages") + 1)
        .otherwise(F.ceil((t - F.col("_start")) / length))
    )
    return df.withColumn("_stage_phase", stage.cast("int")).drop("_exercise", "_start", "_end")


def stages_from_phase(breaths: DataFrame, stage_duration: float = 180.0) -> DataFrame:
    """Fixed-duration stages between the first and last exercise row.

    Stage 0 before; "Recovery" (last stage + 1) after; tests without exercise rows fall
    back to time.  The first exercise row itself is stage 0.
    """
    df = _phase_stage(prepare(breaths), stage_duration)
    known = F.col("_phase_stages").isNotNull()
    df = df.withColumn("stage", F.when(known, F.col("_stage_phase")).otherwise(_time_stage(stage_duration)))
    name = F.when(known & (F.col("stage") > F.col("_phase_stages")), "Recovery").otherwise(_stage_name(F.col("stage")))
    return df.withColumn("stage_name", name).drop("_stage_phase", "_phase_stages")


def extract_stages(breaths: DataFrame, protocol: str = "step", stage_duration: float = 180.0) -> DataFrame:
    """C4: stages by phase where a test has phases, else by power, else by time.

    In a ramp protocol a test with phases is cut by power (or time without power).  A
    column counts as present in a test when any of its values is non-null.
    """
    if protocol not in ("step", "ramp", "auto"):
        raise ValueError(f"unknown protocol: {protocol}")
    df = prepare(breaths)
    df = _phase_stage(df, stage_duration)
    if protocol == "ramp":
        df = power_levels(ramp_power(df, stage_duration), "power_used").drop("power_used")
    else:
        df = power_levels(df)
    df = _stage_of_level(df)
    if protocol == "ramp":
        by_phase = F.lit(False)
        by_power = (F.col("n_power") > 0) & ((F.col("n_phase") == 0) | F.col("_phase_stages").isNotNull())
    else:
        by_phase = (F.col("n_phase") > 0) & F.col("_phase_stages").isNotNull()
        by_power = (F.col("n_phase") == 0) & (F.col("n_power") > 0)
    stage = (
        F.when(by_phase, F.col("_stage_phase"))
        .when(by_power, F.col("_stage_power"))
        .otherwise(_time_stage(stage_duration))
    )
    df = df.withColumn("stage", stage)
    recovery = by_phase & (F.col("stage") > F.col("_phase_stages"))
    df = df.withColumn("stage_name", F.when(recovery, "Recovery").otherwise(_stage_name(F.col("stage"))))
    return df.drop("_stage_phase", "_phase_stages", "_stage_power", "power_increment", "power_rounded")


def last_seconds(df: DataFrame, group: str, seconds: float) -> DataFrame:
    """rows of the last ``seconds`` of each (test, group), inclusive."""
    df = attach(df, {"_t_end": F.max("time_s")}, by=[group])
    return df.where(F.col("time_s") >= F.col("_t_end") - F.lit(float(seconds))).drop("_t_end")


def summarize_stages(staged: DataFrame, method: str = "last30s") -> DataFrame:
    """A3 (mean), A4 (last30s, last60s), A5 (peak): one row per test and stage.

    Stage 0 is left out, "Recovery" is kept.  ``speed_kmh`` is added so that running
    economy can be taken from the summary.
    """
    df = staged.where(F.col("stage") > 0)
    if method in ("last30s", "last60s"):
        df = last_seconds(df, "stage", float(method[4:6]))
    elif method not in ("mean", "peak"):
        raise ValueError(f"unknown summary method: {method}")
    return _stage_rows(df, F.max if method == "peak" else F.avg, [])


def summarize_last(staged: DataFrame, seconds: tuple[int, ...] = (30, 60)) -> DataFrame:
    """A4 for several lengths in one pass: the summaries ``last30s``, ``last60s``..., told apart by ``method``."""
    df = attach(staged.where(F.col("stage") > 0), {"_t_end": F.max("time_s")}, by=["stage"])
    inside = [F.when(F.col("time_s") >= F.col("_t_end") - F.lit(float(x)), F.lit(f"last{x}s")) for x in seconds]
    return _stage_rows(df.withColumn("method", F.explode(F.array_compact(F.array(*inside)))), F.avg, ["method"])


def _stage_rows(df: DataFrame, value: Callable[[str], Column], by: list[str]) -> DataFrame:
    columns = ["vo2_ml", "vco2_ml", "ve_l", "rer", "hr_bpm", "power_w", "speed_kmh"]
    return df.groupBy(KEY, "stage", *by).agg(
        F.avg("time_s").alias("time_s"),
        (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        *[value(c).alias(c) for c in columns if c in df.columns],
        F.count(F.lit(1)).alias("n_breaths"),
        F.min("stage_name").alias("stage_name"),
    )


def join_stages(breaths: DataFrame, stages: DataFrame) -> DataFrame:
    """Annotate breaths with a stage table keyed by (test, row)."""
    return breaths.join(stages.select(KEY, "rn", "stage", "stage_name"), [KEY, "rn"], "left")


def stage_names(staged: DataFrame) -> DataFrame:
    """Distinct (test, stage, name) rows."""
    return staged.where(F.col("stage_name").isNotNull()).select(KEY, "stage", "stage_name").distinct()


def name_stages(summary: DataFrame, names: DataFrame) -> DataFrame:
    """Add stage names to a stage summary."""
    return summary.drop("stage_name").join(names, [KEY, "stage"], "left")


def asof_stage(breaths: DataFrame, starts: DataFrame) -> DataFrame:
    """Latest stage whose start time is not after the breath; before all, the first.

    ``starts`` has one row per (test, stage start): ``test_id, time_s, stage``.  Both
    sides are merged in time order and the last seen stage is carried forward.
    """
    first = starts.groupBy(KEY).agg(F.min_by("stage", "time_s").alias("_first"))
    right = starts.select(KEY, "time_s", F.col("stage").cast("int").alias("_stage"), F.lit(0).alias("_side"))
    flags = [c for c in ("split",) if is_split(breaths)]
    if flags:
        marks = breaths.where(F.col("split")).select(KEY, "split").distinct()
        right = right.join(marks, KEY, "left").withColumn("split", F.coalesce("split", F.lit(False)))
    left = breaths.select(KEY, "time_s", "rn", *flags, F.lit(1).alias("_side"))
    merged = left.unionByName(right, True)
    merged = with_chunks(rank_rows(merged, ["time_s", "_side", "rn"], "_i"), "_i")
    merged = carry_forward(merged, "_stage", "_seen", "_i").where(F.col("_side") == 1)
    found = merged.join(first, KEY, "left").select(KEY, "rn", F.coalesce("_seen", "_first").alias("stage"))
    return breaths.join(found, [KEY, "rn"], "left")


def rest_rows(breaths: DataFrame, names: tuple[str, ...] = ("rest",)) -> DataFrame:
    """rows whose phase is one of ``names`` (any case)."""
    return breaths.where(F.lower("phase").isin(*names))


def first_seconds(breaths: DataFrame, seconds: float = 120.0, inclusive: bool = True) -> DataFrame:
    """rows of the first ``seconds`` of each test."""
    df = prepare(breaths)
    limit = F.col("t_first") + F.lit(float(seconds))
    return df.where(F.col("time_s") <= limit if inclusive else F.col("time_s") < limit)


def last_stages(summary: DataFrame, count: int = 2) -> DataFrame:
    """The last ``count`` stages of each test.

    A rank filter of this shape keeps ``count`` rows per test before the shuffle.
    """
    latest = W.partitionBy(KEY).orderBy(F.desc("stage"))
    return summary.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= count)


def display_stages(breaths: DataFrame, window: float = 30.0) -> DataFrame:
    """Stage averages for display over the last ``window`` seconds of each group.

    Groups are the stages if the test has any; else rounded power if there are at most
    20 levels or 5 rows per level; else time bins of ``window`` seconds.
    """
    df = prepare(breaths)
    df = power_levels(df)
    levels = df.where(F.col("power_rounded").isNotNull()).select(KEY, "power_rounded").distinct()
    df = spread(df, levels.groupBy(KEY).agg(F.count(F.lit(1)).alias("_levels")))
    few = (F.col("n_power") > 0) & ((F.col("_levels") <= 20) | (F.col("n") / F.col("_levels") >= 5))
    by_time = F.floor(F.col("time_s") / F.lit(float(window))).cast("double")
    group = F.when(few, F.col("power_rounded")).otherwise(by_time)
    kind = F.when(few, "power").otherwise("time")
    if "stage" in breaths.columns:
        df = attach(df, {"_staged": F.count("stage")})
        group = F.when(F.col("_staged") > 0, F.col("stage").cast("double")).otherwise(group)
        kind = F.when(F.col("_staged") > 0, "stage").otherwise(kind)
    df = df.withColumn("stage_group", group).withColumn("group_kind", kind)
    df = last_seconds(df, "stage_group", window)
    means = ["time_s", *signals(breaths)]
    return (
        df.groupBy(KEY, "group_kind", "stage_group")
        .agg(*[F.avg(c).alias(c) for c in means], F.count(F.lit(1)).alias("n_breaths"))
        .where(F.col("vo2_ml").isNotNull())
    )


def intensity_runs(breaths: DataFrame) -> DataFrame:
    """Runs of constant rounded intensity among the rows with intensity above 0.

    Intensity is speed (to 0.5) if the test has any positive speed, else power (to 5).
    One row per run: level, start, duration, position; ``exercise_rows`` per test.
    """
    df = prepare(breaths)
    df = attach(df, {"_speed": F.max("speed_kmh"), "_power": F.max("power_w")})
    modality = F.when(F.col("_speed") > 0, "treadmill").when(F.col("_power") > 0, "cycling").otherwise("other")
    df = df.withColumn("modality", modality)
    level = F.when(F.col("modality") == "treadmill", F.rint(F.col("speed_kmh") / 0.5) * 0.5).when(
        F.col("modality") == "cycling", F.rint(F.col("power_w") / 5) * 5
    )
    active = df.withColumn("level", level).where(F.col("level") > 0)
    active = with_chunks(rank_rows(active, ["rn"], "_i", "exercise_rows"), "_i")
    lag = lambda part: {"_prev": F.lag("level").over(W.partitionBy(*part).orderBy("_i"))}
    active = framed(active, lag, 1, "_i")
    start = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("level")), 1).otherwise(0)
    active = running_sum(active.withColumn("_start", start), "_start", "run", "_i")
    return active.groupBy(KEY, *carried(active), "modality", "exercise_rows", "run").agg(
        F.min("level").alias("level"),
        F.min("time_s").alias("start_s"),
        (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        F.count(F.lit(1)).alias("rows"),
    )


def plateaus(breaths: DataFrame) -> DataFrame:
    """Runs longer than 30 s."""
    return intensity_runs(breaths).where(F.col("duration_s") > 30)


def detect_protocol_config(breaths: DataFrame) -> DataFrame:
    """Modality, start, increment and stage duration, one row per test.

    Only the modality is given with fewer than 10 exercise rows or 2 plateaus.
    """
    kept = plateaus(breaths).where(F.col("exercise_rows") >= 10)
    if is_split(kept):
        kept = with_chunks(rank_rows(kept, ["run"], "_p"), "_p")
        lag = lambda part: {"_prev": F.lag("level").over(W.partitionBy(*part).orderBy("_p"))}
        kept = framed(kept, lag, 1, "_p")
    else:
        kept = kept.withColumn("_prev", F.lag("level").over(W.partitionBy(KEY).orderBy("run")))
    rise = F.col("level") - F.col("_prev")
    kept = kept.withColumn("_rise", F.when(rise > 0, rise))
    if is_split(kept):
        typical = medians(kept, "_rise", "_rise_mid").join(medians(kept, "duration_s", "_length"), KEY, "full")
        shape = kept.groupBy(KEY).agg(F.count(F.lit(1)).alias("_plateaus"), F.min_by("level", "run").alias("_first"))
        shape = shape.join(typical, KEY, "left")
    else:
        shape = kept.groupBy(KEY).agg(
            F.count(F.lit(1)).alias("_plateaus"), F.min_by("level", "run").alias("_first"),
            F.median("_rise").alias("_rise_mid"), F.median("duration_s").alias("_length"),
        )
    tests = breaths.groupBy(KEY).agg(F.max("speed_kmh").alias("_speed"), F.max("power_w").alias("_power"))
    modality = F.when(F.col("_speed") > 0, "treadmill").when(F.col("_power") > 0, "cycling").otherwise("other")
    unit = F.when(modality == "treadmill", 0.5).otherwise(5.0)
    known = F.col("_plateaus") >= 2
    increment = F.greatest(F.coalesce(F.rint(F.col("_rise_mid") / unit) * unit, unit), unit)
    length = F.greatest(F.rint(F.col("_length") / 30) * 30, F.lit(60.0))
    return tests.join(shape, KEY, "left").select(
        KEY,
        modality.alias("modality"),
        F.when(known, F.col("_first")).alias("starting_intensity"),
        F.when(known, increment).alias("increment_size"),
        F.when(known, length).alias("stage_duration_s"),
    )
