"""The k-means tree and searches in it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidalspan.llm.ann import best_bins, grow, leaf_of, search

SF = "/root/testdata/sf0.1"


def brute(ids, x, q, own, k=10):
    other = ids != own
    d = np.sqrt(((x[other] - q) ** 2).sum(axis=1))
    order = np.lexsort((ids[other], d))[:k]
    return ids[other][order], d[order]


def test_every_leaf_is_met_once():
    x = np.random.default_rng(1).normal(size=(700, 5))
    tree = grow(x, branches=4, leaf_rows=20)
    leaves = leaf_of(tree, x)
    assert sorted(best_bins(tree, x[0])) == list(range(max(tree.leaf) + 1)) and set(leaves) <= set(tree.leaf)
    assert len(grow(np.ones((300, 3)), leaf_rows=10).children) == 1  # equal rows can't be cut


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = rows.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = search(rows, F.col("vec_id") % 100 == 0).toPandas()
    assert got.groupby("query_id").size().eq(10).all() and set(got.query_id) == set(ids[ids % 100 == 0])
    met = 0
    for q, g in got.groupby("query_id"):
        near, _ = brute(ids, x, x[ids == q][0], q)
        g = g.sort_values("rank")
        exact = np.sqrt(((x[np.searchsorted(ids, g.vec_id)] - x[ids == q][0]) ** 2).sum(axis=1))
        assert np.allclose(g.score, exact, rtol=1e-13) and (np.diff(g.score) >= 0).all() and list(g["rank"]) == list(range(1, 11))
        met += len(set(near) & set(g.vec_id))
    assert met / len(got) >= 0.9


def test_odd_vectors(spark):
    rows = [(i, [float(i // 3), 1.0]) for i in range(12)] + [(20, None), (21, []), (22, [0.0, 0.0]), (23, [float("nan"), 1.0]), (24, [float("inf"), 1.0]), (25, [None, 1.0]),
                                                          (26, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, leaf string, v int")
    got = search(df, F.col("vec_id") % 10 == 0, k=15).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 10} and all(r.vec_id != r.query_id and r.vec_id < 12 for r in got)
    ten = [(r.vec_id, r.score) for r in got if r.query_id == 10]
    assert ten[:5] == [(9, 0.0), (11, 0.0), (6, 1.0), (7, 1.0), (8, 1.0)] and len(ten) == 12  # ties to the smaller id; all there are
    assert search(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert search(df.where("vec_id = 20"), F.col("vec_id") == 20).count() == 0


def test_copies_of_one_vector(spark):
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(6000)] + [(9000 + i, [float(i), 2.0]) for i in range(50)], "vec_id bigint, embedding array<float>")
    got = search(df, F.col("vec_id") == 5000).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10)) and {r.score for r in got} == {0.0}


def test_repeated_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (0, [20.2, 1.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    near = sorted((r["rank"], r.vec_id) for r in got)
    assert near == [(1, 1), (1, 20), (2, 2), (2, 21), (3, 3), (3, 19)]
