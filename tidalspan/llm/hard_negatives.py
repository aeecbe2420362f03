"""Hard negatives by Fagin's threshold algorithm over blocks of rows.

Every block of candidates carries its rows sorted once by each dimension.  For an anchor the lists are read from the
end that its sign makes the better one, some entries of each at a time.  Rows met for the first time get their exact
integer score from the whole vector.  What the lists show at the depth reached bounds every row not met yet: the sum
over dimensions of the anchor's component times the last one read.  A search ends once that threshold lies strictly
below the last place of each of its windows (equal scores could still win by a smaller id), or below the window itself.

Rows are dealt into blocks of bounded size by a hash of their number, anchors into batches; every batch meets every
block, each pair of them a unit of work.  Units give their best few, Spark ranks these over all blocks.  A first pass
finds the positives; their scores are the windows of the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

BLOCK, BATCH, DEPTH = 4096, 512, 64
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
EVERY = (-(1 << 63), (1 << 63) - 1)


class Block(NamedTuple):
    """Candidates: their rows, ids, labels, components, and per dimension their places by rising and by falling component."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    lists: np.ndarray


def exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers as the shortest floats in which all inner products stay exact, which is fast, or as Python's integers."""
    most = int(np.abs(values).max(initial=0))
    largest = most * most * max(1, values.shape[1])
    return values.astype(np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object)


def block_of(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> Block:
    rising = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
    return Block(rows, ids, labels, exact(values), np.stack([rising, rising[:, ::-1]]))


def _settled(scores: np.ndarray, window: tuple[int, int], places: int, threshold: int) -> bool:
    """Whether a row not met yet, which has at most the threshold, can't come into the window's places."""
    low, high = window
    if low > high or threshold < low:
        return True
    if threshold >= high:  # no place of the window can lie above it
        return False
    inside = scores[(scores >= low) & (scores <= high)]
    return len(inside) >= places and threshold < np.partition(inside, len(inside) - places)[len(inside) - places]


def threshold_search(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], places: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first ``places`` allowed candidates of each window (least and greatest score), and all scores known.

    Higher scores come first, ties go by smaller id.
    """
    n, matrix = len(block.ids), block.matrix
    if matrix.dtype != anchor.dtype:
        kind = np.float64 if object not in (matrix.dtype, anchor.dtype) else object
        matrix, anchor = ((x if x.dtype == object else x.astype(np.int64)).astype(kind) for x in (matrix, anchor))
        if kind is np.float64 and float(np.abs(matrix).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * len(anchor) >= 1 << 53:
            matrix, anchor = (x.astype(np.int64).astype(object) for x in (matrix, anchor))
    live = np.flatnonzero(anchor != 0)
    weights, side = anchor[live], (anchor[live] > 0).astype(int)  # a positive component reads the falling list
    scores, met = np.zeros(n, matrix.dtype), np.zeros(n, bool)
    depth, step = 0, DEPTH
    if not len(live):
        met[:], depth = True, n  # all scores are zero
    while depth < n:
        to = min(n, depth + step)
        read = block.lists[side, live, depth:to]
        fresh = np.zeros(n, bool)
        fresh[read.ravel()] = True
        fresh &= ~met
        met |= fresh
        new = np.flatnonzero(fresh)
        scores[new] = matrix[new] @ anchor
        if met.all():
            break
        threshold = int((weights * matrix[read[:, -1], live]).sum())
        good = scores[met & allowed]
        if len(good) and (windows[0] != EVERY or threshold < good.max()) and all(_settled(good, w, places, threshold) for w in windows):
            break
        depth, step = to, 3 * step
    out, known = [], np.flatnonzero(met & allowed)
    for low, high in windows:
        mine = known[(scores[known] >= low) & (scores[known] <= high)]
        if len(mine) > places:
            mine = mine[scores[mine] >= np.partition(scores[mine], len(mine) - places)[len(mine) - places]]
        out.append(mine[np.lexsort((block.rows[mine], block.ids[mine], -scores[mine].astype(np.int64)))][:places])
    return out, scores


FOUND = "a_row bigint, anchor_id bigint, no int, row bigint, vec_id bigint, score bigint"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(columns)], [x.split()[0] for x in FOUND.split(", ")])


def _search(width: int, places: int, windowed: bool, low: int, high: int):
    """Sorted units of (block, batch): first the candidates, at most a block, then the anchors one by one.

    Without windows the positives of each anchor, else the negatives for each of its positives.
    """
    def ask(block: Block, row: int, vec_id: int, label: int, vector: np.ndarray, positives: list[dict]) -> Iterator[tuple]:
        if windowed:  # low p <= 100 n <= high p in whole numbers
            allowed, windows = block.labels != label, [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
        else:
            allowed, windows = (block.labels == label) & (block.ids != vec_id), [EVERY]
        if not windows or not allowed.any():
            return
        best, scores = threshold_search(block, vector, allowed, windows, places)
        for i, candidates in enumerate(best):
            for c in candidates:
                yield row, vec_id, positives[i]["no"] if windowed else 0, int(block.rows[c]), int(block.ids[c]), int(scores[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, group, asked, rows, ids, labels = (batch.column(i).to_numpy() for i in range(6))
            values = batch.column(6).flatten().to_numpy().astype(np.int64).reshape(-1, width)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(group) != 0) | (np.diff(asked) != 0)) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if (part[lo], group[lo]) != unit:
                    unit, parts, block = (part[lo], group[lo]), [], None
                if not asked[lo]:
                    parts.append((rows[lo:hi], ids[lo:hi], labels[lo:hi], values[lo:hi]))
                elif parts:
                    block = block or block_of(*(np.concatenate(x) for x in zip(*parts)))
                    vectors, positives = exact(values[lo:hi]), batch.column(7)[lo:hi].to_pylist()
                    for i in range(lo, hi):
                        out += ask(block, int(rows[i]), int(ids[i]), int(labels[i]), vectors[i - lo], positives[i - lo] or [])
            yield _found(out)
    return run


def _units(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_batches: int) -> DataFrame:
    """Every batch of anchors with every block: a stated set of queries against all rows, in blocks."""
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["row", "vec_id", "label", "vector"]
    stored = rows.select(deal(n_blocks).alias("block"), each(n_batches).alias("batch"), F.lit(0).alias("asked"), *columns,
                         F.lit(None).cast("array<struct<no:int,score:bigint>>").alias("positives"))
    queries = anchors.select(each(n_blocks).alias("block"), deal(n_batches).alias("batch"), F.lit(1).alias("asked"), *columns, "positives")
    return stored.union(queries).repartition("block", "batch").sortWithinPartitions("block", "batch", "asked", "row")


def _first(found: DataFrame, keys: list[str], places: int) -> DataFrame:
    """The first few over all blocks."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= places)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, relabel: Column | None) -> DataFrame:
    """vec_id, label, vector of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null").where(~F.exists("vector", odd))
    return rows if relabel is None else rows.withColumn("label", relabel.cast("int"))


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                        block_rows: int = BLOCK, batch_rows: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(256 x); a row's score is its whole-number inner product with the anchor.  For each
    anchor and each of its ``positives`` best rows of the same label and another id: the best ``negatives`` rows of
    other labels that have ``low`` to ``high`` percent of the positive's score.  Higher scores first, ties by smaller id.
    ``is_anchor`` is a condition on vec_id, ``relabel`` a label from vec_id and label.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.  Rows repeated with the
    same id, label and counted components are one; rows of one id that differ are different rows, but none is a positive
    of the other.  Components missing from a shorter vector count as zero; those so large that scores would leave a long
    are cut.  Other columns are not looked at; an empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col, label_col, relabel)
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    limit = min(isqrt(((1 << 63) - 1) // width), (1 << 31) - 1)
    whole = F.transform("vector", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(256 * x))).cast("int"))
    padded = F.slice(F.concat(whole, F.array_repeat(F.lit(0), width)), 1, width)
    rows = keep(rows.select("vec_id", "label", padded.alias("vector")).distinct().withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    n_blocks, n_batches = -(-n_rows // block_rows), -(-n_anchors // batch_rows)

    none = F.lit(None).cast("array<struct<no:int,score:bigint>>")
    near = _units(rows, anchors.withColumn("positives", none), n_blocks, n_batches).mapInArrow(_search(width, positives, False, low, high), FOUND)
    chosen = _first(near, ["a_row"], positives)
    chosen = keep(chosen.select("a_row", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    lists = chosen.groupBy(F.col("a_row").alias("row")).agg(F.collect_list(F.struct("no", F.col("positive_score").alias("score"))).alias("positives"))
    far = _units(rows, anchors.join(lists, "row"), n_blocks, n_batches).mapInArrow(_search(width, negatives, True, low, high), FOUND)
    return _first(far, ["a_row", "no"], negatives).join(chosen, ["a_row", "no"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
