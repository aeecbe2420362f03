"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks.  With integer shares a (out of A for all live sources) its block number
q may not start before slot floor(q A / a) and must be placed before slot ceil((q + 1) A / a).  Of the blocks that may
start, the one with the earliest deadline takes the slot.  As the shares fill every slot exactly, each block is placed
within its window, and at every moment each source is less than one block away from its target.

When a source runs out, a new phase begins: the shares of the others are taken anew, out of their sum.  Shares are the
weights themselves, as integers of any length in their exact proportions, so the bound holds for the weights at every
moment of a run of any length.  The driver takes one step for each block (16 rows) and writes the plan down as a table,
which Spark joins with the blocks.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalspan.llm.store import new_folder

BLOCK_ROWS, GROUP_ROWS, PLAN_ROWS = 16, 20_000, 1 << 20
_PLAN = pa.schema([("s", pa.int32()), ("b", pa.int64()), ("phase", pa.int32()), ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())])


def period(shares: dict[int, int], blocks: dict[int, int] | None = None) -> dict[int, array]:
    """One period of the earliest-deadline-first schedule: the slots of each source's blocks.

    With ``blocks`` it ends where a source has placed all of its own, if that comes earlier.
    """
    total = sum(shares.values())
    waiting = [(0, s, 0) for s in shares]
    ready: list[tuple[int, int, int]] = []
    places = {s: array("q") for s in shares}
    heapq.heapify(waiting)
    t = -1
    while (t := t + 1) < total:
        while waiting and waiting[0][0] <= t:
            _, s, q = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(q + 1) * total // shares[s]), s, q))
        _, s, q = heapq.heappop(ready)
        places[s].append(t)
        if blocks and q + 1 == blocks[s]:
            break
        if q + 1 < shares[s]:
            heapq.heappush(waiting, ((q + 1) * total // shares[s], s, q + 1))
    return places


def schedule(blocks: dict[int, int], shares: dict[int, int], slot: int = 0, phase: int = 0) -> dict[int, list[tuple]]:
    """Per source its phases: number, first block, block after the last, share, sum of shares, first slot, places."""
    done, out = dict.fromkeys(blocks, 0), {s: [] for s in blocks}
    live = sorted(s for s in blocks if blocks[s])
    while live:
        own = {s: shares[s] for s in live}
        left = {s: blocks[s] - done[s] for s in live}
        total, places = sum(own.values()), period(own, left)
        # A period that ended early has no place for the last block of the others.
        end = 1 + min((n - 1) // own[s] * total + places[s][(n - 1) % own[s]] for s, n in left.items() if (n - 1) % own[s] < len(places[s]))
        for s in live:
            n = end // total * own[s] + bisect_left(places[s], end % total)
            if n:
                out[s].append((phase, done[s], done[s] + n, own[s], total, slot, places[s][: min(n, own[s])]))
            done[s] += n
        slot, phase = slot + end, phase + 1
        live = [s for s in live if done[s] < blocks[s]]
    return out


def shares_of(weights: list[float], resolution: int | None = None) -> list[int]:
    """Integers in the exact proportions of the weights, or rounded to parts of ``resolution``."""
    if resolution:
        total = sum(weights)
        return [max(1, math.floor(resolution * w / total + 0.5)) for w in weights]
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * unit) for w in exact]
    common = math.gcd(*whole)
    return [w // common for w in whole]


def places_of(plan: dict[int, list[tuple]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of all blocks of a plan."""
    for s, phases in plan.items():
        for phase, first, past, share, total, slot, places in phases:
            for q in range(past - first):
                yield s, first + q, phase, slot + q * total // share, slot - (-(q + 1) * total // share), slot + q // share * total + places[q % share]


def _written(spark: SparkSession, plan: dict[int, list[tuple]]) -> DataFrame:
    """The places of all blocks as a table, which the driver holds ``PLAN_ROWS`` of at a time."""
    path, rest = new_folder(spark, "plan"), places_of(plan)
    rows = list(islice(rest, PLAN_ROWS))
    while True:
        columns = zip(*rows) if rows else [()] * len(_PLAN)
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLAN)], schema=_PLAN)
        written = spark.createDataFrame(table)
        written.write.mode("append").parquet(path)
        if not (rows := list(islice(rest, PLAN_ROWS))):
            return spark.read.schema(written.schema).parquet(path)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
                block_rows: int = BLOCK_ROWS, resolution: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with their place in the mixture.

    Added are source_block (number of the block in its source), row_in_block, phase, release, deadline and slot (of the
    block, gapless from 0; release <= slot < deadline); input columns of those names are replaced.  Reading in the
    order of slot and row_in_block gives the mixture.  Without ``weights`` a source weighs the square root of its rows.
    Sources that ``weights`` leaves out, or gives nothing positive, come after the others in proportion to their size.
    A ``resolution`` rounds the weights to so many parts; what is less than one block from its target then follows those.

    Every row is kept.  Within a source the order is that of the MD5 of the id, then of the id, then of the row's hash;
    a null id has the MD5 of an empty text and comes first among equals.  A null source is a source of its own.  A
    source's last block may be short.  Repeated rows are rows like any other; an empty table stays empty.
    """
    spark = docs.sparkSession
    added = ["source_block", "row_in_block", "phase", "release", "deadline", "slot"]
    names = [c for c in docs.columns if c not in added]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    digits = max(0, math.ceil(math.log(max(1, docs.count() / GROUP_ROWS), 16)))  # so that no window partition is large
    rows = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("src"), F.col(id_col).alias("id"), digest.alias("digest"),
                       F.substring(digest, 1, digits).alias("head"))
    sizes = rows.groupBy("src", "head").agg(F.count("*").alias("n"))
    per_source = sorted(((r.src, r.n) for r in sizes.groupBy("src").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))
    blocks = {i: -(-n // block_rows) for i, (_, n) in enumerate(per_source)}
    weight = [math.sqrt(n) if weights is None else max(0.0, weights.get(s) or 0.0) for s, n in per_source]
    mixed, rest = [i for i in blocks if weight[i] > 0], [i for i in blocks if not weight[i] > 0]
    plan = schedule({i: blocks[i] for i in mixed}, dict(zip(mixed, shares_of([weight[i] for i in mixed], resolution))))
    behind = sum(blocks[i] for i in mixed)
    plan |= schedule({i: blocks[i] for i in rest}, dict(zip(rest, shares_of([blocks[i] for i in rest], resolution))), behind,
                     1 + max((p[-1][0] for p in plan.values()), default=-1))
    kind = rows.schema["src"].dataType.simpleString()
    known = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(per_source)], f"i int, name {kind}")  # one row per source

    earlier = Window.partitionBy("src").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("src").alias("s"), F.col("head").alias("h"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    group = Window.partitionBy("src", "head").orderBy("digest", "id", F.xxhash64("row"))
    numbered = rows.withColumn("nth", F.row_number().over(group)).join(starts, F.col("src").eqNullSafe(F.col("s")) & (F.col("head") == F.col("h")))
    nth = F.col("before") + F.col("nth") - 1
    numbered = numbered.join(F.broadcast(known), F.col("src").eqNullSafe(F.col("name"))).select(
        "row", "i", F.expr(f"bigint(before + nth - 1) div {block_rows}").alias("block"), (nth % block_rows).cast("int").alias("row_in_block"))
    placed = numbered.join(_written(spark, plan), (F.col("i") == F.col("s")) & (F.col("block") == F.col("b")))
    return placed.select(*(F.col("row")[c].alias(c) for c in names), F.col("block").alias("source_block"), "row_in_block", "phase", "release", "deadline", "slot")
