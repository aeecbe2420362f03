"""Row layout: numbering, per-test values and frames that survive an oversized test.

Every operator works on rows keyed by ``test_id`` and ordered by ``rn``.  A normal
test has hundreds to thousands of rows, so one window partition per test is the
right unit.  One test may, however, hold a large share of all rows.  Tests above
``spark.tidalspan.chunkRows`` rows are therefore *split*: the frame then carries

* ``split``  - true for rows of such a test,
* ``chunk``  - ``(rn - 1) div chunkRows`` for them, 0 for everybody else.

The two columns exist only if at least one test is split.  Without them all
helpers below compile to plain windows over ``test_id`` (one exchange for a whole
chain of operators); with them the same helpers work chunk by chunk, exchange
whole-test values through aggregates, and copy the few rows that a frame needs
across chunk borders.  Results are the same in both layouts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KEY
from ..shared import shared_folder

CHUNK_ROWS_CONF = "spark.tidalspan.chunkRows"
DEFAULT_CHUNK_ROWS = 1_000_000
TASK_ROWS_CONF = "spark.tidalspan.taskRows"
DEFAULT_TASK_ROWS = 200_000


def chunk_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_ROWS_CONF, str(DEFAULT_TASK_ROWS)))


def deal_out(df: DataFrame, rows: int) -> DataFrame:
    """Hash ``rows`` rows by test into so many partitions that one holds ``taskRows`` rows or so, whatever the table.

    The session's number of shuffle partitions is fixed, and small ones are merged by their bytes: but a row is narrow
    when it is exchanged and wide when the windows of a chain of operators sort it.  Fewer rows than that for each core
    are left to Spark.
    """
    spark = df.sparkSession
    pieces = -(-rows // task_rows(spark))
    if pieces <= spark.sparkContext.defaultParallelism:
        return df
    # No fewer than Spark's own number, or a join would exchange the rows once more.
    return df.repartition(max(pieces, int(spark.conf.get("spark.sql.shuffle.partitions"))), KEY)


def is_split(df: DataFrame) -> bool:
    """Whether ``df`` carries the split layout."""
    return "split" in df.columns


def carried(df: DataFrame) -> list[str]:
    """Layout columns that are constant within a test, for use as grouping keys."""
    return [c for c in ("n", "split") if c in df.columns]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the reliable folder the session names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def index_rows(df: DataFrame, order: Sequence[str], check: bool = True) -> DataFrame:
    """Add ``rn`` (1-based position in ``order``) and ``n`` (rows of the test).

    ``order`` must be total within a test.  Adds ``split`` and ``chunk`` if some
    test is oversized, which one count per test tells; how many are is not limited.
    The same count says into how many tasks the rows go.
    ``check=False`` skips that query; pass it only for
    rows derived one-to-one or fewer from a frame that is known not to be split.
    """
    if not check:
        return _number_whole(df, order, "rn", "n")
    limit = chunk_rows(df.sparkSession)
    counts = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = counts.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if most <= limit:
        return _number_whole(deal_out(df, rows), order, "rn", "n")
    big = counts.where(F.col("_n") > limit).select(KEY, F.lit(True).alias("split"))
    marked = df.join(big, KEY, "left").withColumn("split", F.coalesce("split", F.lit(False)))
    return with_chunks(rank_rows(marked, order, "rn", "n"), "rn")


def with_chunks(df: DataFrame, index: str) -> DataFrame:
    """Set ``chunk`` from ``index`` (no effect on the plain layout)."""
    if not is_split(df):
        return df
    limit = chunk_rows(df.sparkSession)
    position = F.floor((F.col(index) - 1) / F.lit(limit))
    return df.withColumn("chunk", F.when(F.col("split"), position).otherwise(F.lit(0)).cast("bigint"))


def _number_whole(df: DataFrame, order: Sequence, into: str, total: str | None, weight: str | None = None) -> DataFrame:
    window = W.partitionBy(KEY).orderBy(*order)
    place = F.sum(weight).over(window.rowsBetween(W.unboundedPreceding, 0)) if weight else F.row_number().over(window)
    ranked = place.cast("bigint").alias(into)
    every = F.sum(weight) if weight else F.count(F.lit(1))
    extra = [] if total is None else [every.over(W.partitionBy(KEY)).alias(total)]
    return df.select("*", ranked, *extra)


def rank_rows(df: DataFrame, order: Sequence, into: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Add the 1-based position of each row within its test in ``order``; with ``weight`` its running sum.

    Split tests are range-partitioned on ``(test_id, order)``, so a test spreads
    over as many tasks as its size asks for; positions are the local row numbers
    plus the number of rows in earlier pieces.
    """
    if not is_split(df):
        return _number_whole(df, order, into, total, weight)
    whole = _number_whole(df.where(~F.col("split")), order, into, total, weight)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.where(F.col("split"))
        .repartitionByRange(pieces, KEY, *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    # Piece ids must not change if an executor is lost between the two passes.
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy(KEY, "_piece").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_rows"))
    earlier = W.partitionBy(KEY).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    # Range pieces are contiguous, so there is one row per piece and one more per split test at most.
    offsets = sizes.select(
        KEY,
        "_piece",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy(KEY)).alias("_total"),
    )
    window = W.partitionBy(KEY, "_piece").orderBy(*order)
    local = F.sum(weight).over(window.rowsBetween(W.unboundedPreceding, 0)) if weight else F.row_number().over(window)
    extra = [] if total is None else [F.col("_total").alias(total)]
    numbered = ranged.join(offsets, [KEY, "_piece"]).select(
        *df.columns, (F.col("_before") + local).cast("bigint").alias(into), *extra
    )
    return whole.unionByName(numbered)


def attach(df: DataFrame, values: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Add per-test (or per test and ``by``) aggregates to every row."""
    keys = [KEY, *by]
    if not is_split(df):
        whole = W.partitionBy(*keys)
        return df.select("*", *[c.over(whole).alias(name) for name, c in values.items()])
    local = W.partitionBy(KEY, "chunk", *by)
    near = df.select("*", *[c.over(local).alias(f"_near_{name}") for name, c in values.items()])
    totals = (
        df.where(F.col("split"))
        .groupBy(*keys)
        .agg(*[c.alias(f"_far_{name}") for name, c in values.items()])
    )
    near, totals = near.alias("a"), totals.alias("b")
    same = F.col(f"a.{KEY}") == F.col(f"b.{KEY}")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = near.join(totals, same, "left")
    joined = joined.select("a.*", *[f"b._far_{name}" for name in values])
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("split"), F.col(f"_far_{name}")).otherwise(F.col(f"_near_{name}")).alias(name)
            for name in values
        ],
    )


def spread(df: DataFrame, per_test: DataFrame, how: str = "left") -> DataFrame:
    """Join a one-row-per-test table to the rows.

    In the plain layout both sides are already hashed on ``test_id``.  In the split
    layout the big side of a split test is cut by adaptive skew-join handling.
    """
    return df.join(per_test, KEY, how)


def framed(
    df: DataFrame,
    build: Callable[[list[str]], dict[str, Column]] | Sequence[Callable[[list[str]], dict[str, Column]]],
    reach: Column | int,
    index: str = "rn",
) -> DataFrame:
    """Add window columns whose frames reach at most ``reach`` rows either way.

    ``build`` receives the partition columns and returns the columns to add; it
    must order by ``index`` or a monotone function of it.  Several are applied in turn,
    each on what the one before has added.  In the split layout the
    rows within ``reach`` of a block border are copied to the neighbouring block,
    and only the home rows are kept afterwards.
    """
    steps = [build] if callable(build) else build
    if not is_split(df):
        for step in steps:
            df = df.select("*", *[c.alias(name) for name, c in step([KEY]).items()])
        return df
    reach = reach if isinstance(reach, Column) else F.lit(reach)
    length = F.greatest(F.lit(chunk_rows(df.sparkSession)), F.coalesce(reach, F.lit(1))).cast("bigint")
    offset = F.col("_offset")
    placed = df.withColumn("_length", length).withColumn(
        "_home",
        F.when(F.col("split"), F.floor((F.col(index) - 1) / F.col("_length"))).otherwise(F.lit(0)).cast("bigint"),
    )
    placed = placed.withColumn("_offset", F.col(index) - 1 - F.col("_home") * F.col("_length"))
    copies = F.array_compact(F.array(
        F.col("_home"),
        F.when(F.col("split") & (offset < reach), F.col("_home") - 1),
        F.when(F.col("split") & (offset >= F.col("_length") - reach), F.col("_home") + 1),
    ))
    copied = placed.withColumn("_block", F.explode(copies))
    for step in steps:
        copied = copied.select("*", *[c.alias(name) for name, c in step([KEY, "_block"]).items()])
    return copied.where(F.col("_block") == F.col("_home")).drop("_block", "_home", "_length", "_offset")


def running_sum(df: DataFrame, value: str, into: str, index: str = "rn") -> DataFrame:
    """Add the inclusive running sum of ``value`` in ``index`` order.

    In the split layout chunk sums are added first; ``chunk`` must follow ``index``.
    """
    if not is_split(df):
        upto = W.partitionBy(KEY).orderBy(index).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(into, F.sum(value).over(upto))
    upto = W.partitionBy(KEY, "chunk").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    sums = df.groupBy(KEY, "chunk").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(KEY).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(KEY, "chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_local", F.sum(value).over(upto))
    return (
        local.join(sums, [KEY, "chunk"])
        .withColumn(into, F.col("_before") + F.col("_local"))
        .drop("_before", "_local")
    )


def carry_forward(df: DataFrame, value: str, into: str, index: str = "rn") -> DataFrame:
    """Add the latest non-null ``value`` at or before each row in ``index`` order.

    In the split layout the last value of every earlier chunk is carried over;
    ``chunk`` must follow ``index``.
    """
    if not is_split(df):
        upto = W.partitionBy(KEY).orderBy(index).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(into, F.last(value, True).over(upto))
    upto = W.partitionBy(KEY, "chunk").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col(index))
    ends = df.groupBy(KEY, "chunk").agg(F.max_by(value, known).alias("_end"))
    before = W.partitionBy(KEY).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(KEY, "chunk", F.last("_end", True).over(before).alias("_before"))
    local = df.withColumn("_local", F.last(value, True).over(upto))
    return (
        local.join(ends, [KEY, "chunk"])
        .withColumn(into, F.coalesce("_local", "_before"))
        .drop("_before", "_local")
    )


def medians(df: DataFrame, value: str, into: str) -> DataFrame:
    """Exact per-test median of ``value`` (nulls skipped), one row per test of ``df``."""
    if not is_split(df):
        return df.groupBy(KEY).agg(F.median(value).alias(into))
    # Equal values are counted first, so that a value that most rows share is one row here.
    counts = df.where(F.col(value).isNotNull()).groupBy(KEY, "split", value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = rank_rows(counts, [value], "_r", "_m", "_c")
    holds = lambda place: F.max(F.when((F.col("_r") >= place) & (F.col("_r") - F.col("_c") < place), F.col(value)))
    low, high = F.floor((F.col("_m") + 1) / 2), F.floor(F.col("_m") / 2) + 1
    found = ranked.groupBy(KEY).agg(((holds(low) + holds(high)) / 2).alias(into))
    return df.select(KEY).distinct().join(found, KEY, "left")


def total_order(df: DataFrame) -> list:
    """By time, then by the row of the source, or by the whole row if that is not known."""
    return ["time_s", "source_row" if "source_row" in df.columns else F.xxhash64(*df.columns)]


def prepare(df: DataFrame, order: Sequence | None = None) -> DataFrame:
    """Number the rows (unless done) and add the per-test values most operators use.

    Without ``order`` the rows come by ``total_order``.

    Adds ``t_first``, ``t_last``, ``interval`` (mean gap between breaths, W15) and
    the non-null counts ``n_hr``, ``n_power``, ``n_speed`` and ``n_phase``.  Prepared
    frames are returned as they are.
    """
    if "interval" in df.columns:
        return df
    if "rn" not in df.columns:
        df = index_rows(df, order or total_order(df))
    present = {"n_hr": "hr_bpm", "n_power": "power_w", "n_speed": "speed_kmh", "n_phase": "phase"}
    values = {"t_first": F.min("time_s"), "t_last": F.max("time_s")}
    values |= {name: F.count(c) if c in df.columns else F.count(F.lit(None)) for name, c in present.items()}
    df = attach(df, values)
    return df.withColumn("interval", F.try_divide(F.col("t_last") - F.col("t_first"), F.col("n") - 1))
