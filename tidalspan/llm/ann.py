"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then sent down to its leaf.  A query visits leaves best bin first:
a priority queue holds the branches seen so far, nearest centre on top.  How many leaves are visited is calibrated: for
some sample queries the true neighbours among all rows are known, and visits widen until they hold the wanted share.
Leaves with many rows are cut into chunks, so no task holds a whole popular leaf; distances are exact.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

#: Bounds of what is fitted on the driver: rows of the sample, and queries of the calibration.
SAMPLE, CALIBRATION = 20_000, 200
BRANCHES, LEAF_ROWS, CHUNK, RECALL = 8, 64, 2048, 0.97


class Tree(NamedTuple):
    centres: np.ndarray  # of each node; node 0 is the root
    children: list[list[int]]
    leaf: list[int]  # number of the leaf, -1 for others


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        owner = ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        n = np.bincount(owner, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def grow(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf, leaves = [x.mean(axis=0)], [[]], [-1], 0
    todo = [(0, x)]
    while todo:
        node, rows = todo.pop()
        parts = []
        if len(rows) > leaf_rows:
            middle, owner = _kmeans(rows, min(branches, len(rows)), rng)
            parts = [(middle[k], rows[owner == k]) for k in range(len(middle)) if (owner == k).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for c, part in parts:
            children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(c), children.append([]), leaf.append(-1)
    return Tree(np.array(centres), children, leaf)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row reaches by the nearest child at each level."""
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
        elif len(rows):
            kids = np.array(tree.children[node])
            c = tree.centres[kids]
            owner = ((c ** 2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(int(kids[k]), rows[owner == k]) for k in range(len(kids))]
    return out


def best_bins(tree: Tree, q: np.ndarray):
    """Leaves in the order in which a best-bin-first traversal for ``q`` meets them."""
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        if tree.leaf[node] >= 0:
            yield tree.leaf[node]
        else:
            kids = tree.children[node]
            for d, k in zip(((tree.centres[kids] - q) ** 2).sum(axis=1).tolist(), kids):
                heapq.heappush(queue, (d, k))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def nearest(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``k`` nearest rows but its own, ties to the smaller id."""
    other = ids != own
    ids, d = ids[other], ((x[other] - q) ** 2).sum(axis=1)
    if len(d) > k:
        close = d <= np.partition(d, k - 1)[k - 1]
        ids, d = ids[close], d[close]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the vector; rows that take no part are gone."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and v is not null and size(v) > 0").where(~bad & F.exists(v, lambda x: x != 0))


def _packed(batches):
    """Vectors as bytes of doubles."""
    for batch in batches:
        column = batch.column(1)
        wide = len(column[0]) if batch.num_rows else 0
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide) if wide else np.zeros((0, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "v"])


def _batch(queries, ids, found, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64()), pa.array(found, pa.int32())],
                                      ["query_id", "vec_id", "d", "leaf"])


_FOUND = "query_id bigint, vec_id bigint, d double, leaf int"


def _true_neighbours(rows: DataFrame, queries: list[tuple[int, bytes]], dims: int, k: int) -> list:
    """Exact neighbours of a bounded set of queries among all rows, with their leaves; rows go by in blocks."""
    def run(batches):
        asked = [(i, np.frombuffer(v, np.float64)) for i, v in queries]
        for batch in batches:
            ids, x, leaves = batch.column(0).to_numpy(), _matrix(batch.column(1), dims), batch.column(2).to_numpy()
            where = dict(zip(ids.tolist(), leaves.tolist()))
            for i, q in asked:
                got, d = nearest(q, i, ids, x, k)
                yield _batch([i] * len(got), got, [where[g] for g in got.tolist()], d)
    best = Window.partitionBy("query_id").orderBy("d", "vec_id")
    near = rows.select("vec_id", "v", "leaf").mapInArrow(run, _FOUND)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "leaf").collect()


def calibrate(tree: Tree, queries: list[tuple[int, bytes]], near: list, recall: float) -> int:
    """Leaf visits after which the queries have met the wanted share of their true neighbours."""
    order = {i: {leaf: n for n, leaf in enumerate(best_bins(tree, np.frombuffer(v, np.float64)), 1)} for i, v in queries}
    visits = sorted(order[r.query_id][r.leaf] for r in near)
    return visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)] if visits else 1


_NEAR = "query bigint, query_id bigint, vec_id bigint, d double"


def _search(dims: int, k: int):
    """Sorted units of (leaf, chunk): first the rows of the index, at most a chunk, then the queries (with a number) one by one."""
    def run(batches):
        unit, ids, vectors, x = None, [], [], None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for leaf, chunk, query, i, v in zip(*(batch.column(n).to_pylist() for n in range(5))):
                if (leaf, chunk) != unit:
                    unit, ids, vectors, x = (leaf, chunk), [], [], None
                if query is None:
                    ids.append(i), vectors.append(v)
                elif ids:
                    if x is None:
                        x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dims)
                    got, d = nearest(np.frombuffer(v, np.float64), i, np.array(ids), x, k)
                    out[0].extend([query] * len(got)), out[1].extend([i] * len(got)), out[2].extend(got.tolist()), out[3].extend(d.tolist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.float64())], ["query", "query_id", "vec_id", "d"])
    return run


def search(rows: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows found by Euclidean distance, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``.  Rows whose id is null, or whose vector is null, empty, zero or holds
    null or non-finite numbers take no part, nor do vectors of another length than most have.  Rows under the query's
    id are its own and no candidates; other repeated ids are candidates like any.  Queries of one id with different
    vectors are answered one by one, each with its own ranks; a query repeated as it is, once.  A query gets all
    candidates if there are at most ``k``.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = _usable(rows, id_col, vector_col)
    lengths = sorted((-r["count"], r.n) for r in rows.groupBy(F.size("v").alias("n")).count().collect())  # one row per length
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total, dims = -lengths[0][0], lengths[0][1]
    packed = rows.where(F.size("v") == dims).mapInArrow(_packed, "vec_id bigint, v binary")
    packed = keep(packed, "vectors")
    draw = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(3)), 33) / float(1 << 31)
    sample = packed.where(draw < 2 * SAMPLE / total).orderBy(draw, "vec_id").limit(SAMPLE).collect()
    tree = grow(np.frombuffer(b"".join(r.v for r in sample), np.float64).reshape(-1, dims))
    parts = tuple(tree)
    shared = spark.sparkContext.broadcast(parts)  # as large as the sample at most

    def place(batches):
        tree = Tree(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(tree, _matrix(batch.column(1), dims)))], ["vec_id", "v", "leaf"])

    index = keep(packed.mapInArrow(place, "vec_id bigint, v binary, leaf int"), "index")
    counts = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row per leaf
    asked = [(r.vec_id, bytes(r.v)) for r in sample[:CALIBRATION]]
    visits = calibrate(tree, asked, _true_neighbours(index, asked, dims, k), recall)

    def visit(batches):
        tree = Tree(*shared.value)
        for batch in batches:
            ids, vectors, leaves, pieces, numbers = [], [], [], [], []
            for i, v, number in zip(*(batch.column(n).to_pylist() for n in range(3))):
                seen = 0
                for n, leaf in enumerate(best_bins(tree, np.frombuffer(v, np.float64))):
                    if n >= visits and seen > 2 * k:
                        break
                    here = counts.get(leaf, 0)
                    seen += here
                    for c in range(-(-here // CHUNK)):
                        ids.append(i), vectors.append(v), leaves.append(leaf), pieces.append(c), numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(pieces, pa.int32()), pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()),
                                              pa.array(vectors, pa.binary())], ["leaf", "chunk", "query", "vec_id", "v"])

    chunks = F.element_at(F.lit([-(-counts.get(n, 1) // CHUNK) for n in range(max(counts) + 1)]), F.col("leaf") + 1)
    stored = index.select("leaf", F.pmod(F.xxhash64("vec_id", "v"), chunks).cast("int").alias("chunk"), F.lit(None).cast("bigint").alias("query"), "vec_id", "v")
    queries = packed.where(is_query).distinct().withColumn("query", F.xxhash64("vec_id", "v"))
    queries = queries.mapInArrow(visit, "leaf int, chunk int, query bigint, vec_id bigint, v binary")
    units = stored.union(queries).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", F.asc_nulls_first("query"))
    best = Window.partitionBy("query_id", "query").orderBy("d", "vec_id")
    near = units.mapInArrow(_search(dims, k), _NEAR).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d").alias("score"))
