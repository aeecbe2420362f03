"""Connected components by alternating large-star and small-star steps, and what buckets leave to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

BLOCK = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it sees."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Nodes are longs.  Loops and edges with a null end are left out; repeated edges are harmless; an empty table gives
    an empty one.  A step aggregates before it joins, so a node with very many neighbours is no single task; the number
    of rounds grows with the logarithm of the longest path.  Each round is written to the shared folder.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v")
    now = keep(now.distinct(), "edges")
    while not _is_stars(now):
        now = keep(_small_star(_large_star(now)), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node, which hangs on none."""
    ends = edges.groupBy("u").agg(F.count("*").alias("above")).select("u", "above", F.lit(0).alias("below"))
    ends = ends.union(edges.select("v").distinct().select(F.col("v").alias("u"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    return ends.groupBy("u").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or above = 1 and below = 1").isEmpty()


def apart(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose ends are not one link of ``first`` away from the same node."""
    hub = first.groupBy("v").agg(F.min("u").alias("hub"))
    a = hub.select(F.col("v").alias("u"), F.col("hub").alias("hub_u"))
    b = hub.select("v", F.col("hub").alias("hub_v"))
    both = pairs.join(a, "u", "left").join(b, "v", "left")
    return both.where(F.coalesce("hub_u", "u") != F.coalesce("hub_v", "v")).select("u", "v")


def blocks_across(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the rows (bucket, comp, cls) of every bucket with several components, to be compared across them.

    (bucket, x, y, side, comp, cls): rows of side 0 are held against those of side 1, or each other if there is none.
    The largest component of a bucket meets the others but not itself.
    """
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    several = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    several = several.select("bucket", F.col("top.comp").alias("top"), F.ceil(F.col("top.n") / block).cast("int").alias("n_top"),
                             F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("n_rest"))
    rows = rows.join(several, "bucket").withColumn("is_top", F.col("comp") == F.col("top"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("cls"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    top = rows.where("is_top").select("*", upto("n_rest").alias("o")).select("bucket", F.col("o").alias("x"), (-1 - F.col("k")).alias("y"), F.lit(1).alias("side"), "comp", "cls")
    rest = rows.where("not is_top")
    met = rest.select("*", upto("n_top").alias("o")).select("bucket", F.col("k").alias("x"), (-1 - F.col("o")).alias("y"), F.lit(0).alias("side"), "comp", "cls")
    own = rest.select("*", upto("n_rest").alias("o")).select(
        "bucket", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), (F.col("k") > F.col("o")).cast("int").alias("side"), "comp", "cls")
    return top.union(met).union(own)
