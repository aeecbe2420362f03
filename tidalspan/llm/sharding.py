"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each input block go to each piece of a shard is drawn first, from the multivariate hypergeometric law
that a uniform shuffle of all rows would follow.  A block then permutes its rows to decide which go where, the rows are
exchanged once, and each piece permutes what it has received.  Sizes are exact because they are drawn, not hoped for.

The driver sees one count per input file and the matrix; the matrix has at most ``max_blocks`` rows and
``shards * max_pieces`` columns, whatever the number of rows.  All draws follow from the seed and from row numbers
that stay the same if a task runs again: those in the Parquet files of a table that is read as it is, else those of a
copy that is written down first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

PARTITION_BITS = 33  # of monotonically_increasing_id
RANGE_BITS = 20  # rows of a file that are placed together


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among ``n`` drawn; numpy's own sampler ends at 10^9."""
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    wide = 40 * (mean * bad / total * (total - n) / max(1, total - 1)) ** 0.5 + 10
    x = np.arange(max(0, n - bad, int(mean - wide)), min(n, good, int(mean + wide)) + 1, dtype=float)
    ratio = (good - x[:-1]) * (n - x[:-1]) / ((x[:-1] + 1) * (bad - n + x[:-1] + 1))  # of each chance to the one before
    log = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    odds = np.exp(log - log.max()).cumsum()
    return int(x[np.searchsorted(odds, rng.random() * odds[-1], "right")])


def matrix(blocks: np.ndarray, pieces: np.ndarray, seed: int) -> np.ndarray:
    """Rows from each block to each piece; row sums are ``blocks`` and column sums are ``pieces``."""
    rng = np.random.default_rng(seed)
    left, out = pieces.astype(np.int64).copy(), np.zeros((len(blocks), len(pieces)), np.int64)
    for b, n in enumerate(blocks.tolist()):
        total = int(left.sum())
        if total < 10**9:
            out[b] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        else:
            for k, good in enumerate(left.tolist()):
                total -= good
                out[b, k] = hypergeometric(rng, good, total, n)
                n -= out[b, k]
        left -= out[b]
    return out


def piece_sizes(rows: int, shards: int, max_pieces: int, piece_rows: int, seed: int) -> tuple[np.ndarray, int]:
    """Sizes of all pieces, shard by shard, and how many a shard has; shards differ by one row at most."""
    per = int(min(max_pieces, max(1, -(-rows // (shards * piece_rows)))))
    extra = np.random.default_rng(seed).permutation(shards) < rows % shards
    sizes = rows // shards + extra
    return np.concatenate([n // per + (np.arange(per) < n % per) for n in sizes]).astype(np.int64), per


def _numbered(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows as (row, file, at), at counting from 0 in every file, and the rows of each file by its number."""
    row = F.struct(*(df[c] for c in names)).alias("row") if names else F.lit(None).alias("row")
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":  # a table as it is, nothing done to it
        try:
            rows = df.select(row, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        except AnalysisException:  # files of a kind without row numbers
            rows = None
        if rows is not None:
            found = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")).groupBy("path").agg(
                F.count("*").alias("n"), F.max("at").alias("last")).select(F.xxhash64("path").alias("file"), "n", "last").collect()
            if len({r.file for r in found}) == len(found) and all(r.n == r.last + 1 for r in found):
                return rows, sorted((r.file, r.n) for r in found)
    copy = keep(df.select(row, F.monotonically_increasing_id().alias("id")), "rows")
    rows = copy.select("row", F.shiftright("id", PARTITION_BITS).alias("file"), F.col("id").bitwiseAND((1 << PARTITION_BITS) - 1).alias("at"))
    return rows, sorted((r.file, r.n) for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect())  # one per input partition


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 2, max_blocks: int = 256, max_pieces: int = 1024,
                        piece_rows: int = 4096) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Columns of ``df`` with those names are replaced.  Nulls, empty and repeated rows are rows like any other; an empty
    table stays empty.  Shard sizes differ by at most one row, and every arrangement is equally likely.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows, counts = _numbered(df, names)
    files = np.array([f for f, _ in counts], np.int64)
    ranges = np.array([-(-n >> RANGE_BITS) for _, n in counts], np.int64)  # of each file
    first = np.cumsum(ranges) - ranges
    size = np.array([min(n - (i << RANGE_BITS), 1 << RANGE_BITS) for _, n in counts for i in range(-(-n >> RANGE_BITS))], np.int64)
    total = int(size.sum())
    block_of = np.arange(len(size)) % max_blocks
    blocks = np.bincount(block_of, size, minlength=min(max_blocks, len(size))).astype(np.int64) if total else np.zeros(0, np.int64)
    before = np.zeros(len(size), np.int64)  # rows of the block in earlier ranges
    for b in range(len(blocks)):
        mine = block_of == b
        before[mine] = np.cumsum(size[mine]) - size[mine]
    pieces, per = piece_sizes(total, shards, max_pieces, piece_rows, seed)
    to = spark.sparkContext.broadcast((files, first, block_of, before, np.cumsum(matrix(blocks, pieces, seed), axis=1)))
    starts = np.cumsum(pieces) - pieces
    within = (starts - np.repeat(starts[::per], per)).tolist()

    @F.pandas_udf("int")
    def piece_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        files, first, block_of, before, ends = to.value
        block, order = -1, None
        for file, at in batches:
            at = at.to_numpy()
            p = first[np.searchsorted(files, file.to_numpy())] + (at >> RANGE_BITS)
            out = np.zeros(len(at), np.int32)
            for x in np.unique(p):
                if block_of[x] != block:
                    block = int(block_of[x])
                    order = np.random.default_rng([seed, block]).permutation(int(ends[block, -1]))
                mine = p == x
                place = order[before[x] + (at[mine] & ((1 << RANGE_BITS) - 1))]
                out[mine] = np.searchsorted(ends[block], place, "right")
            yield pd.Series(out)

    sent = rows.select("row", "file", "at", piece_of("file", "at").alias("piece"))
    arrived = Window.partitionBy("piece").orderBy(F.xxhash64(F.lit(seed), "file", "at"), "file", "at")
    rank: Column = F.row_number().over(arrived) - 1
    offset = F.element_at(F.lit(within), F.col("piece") + 1)
    return sent.select(*([F.col("row")[c].alias(c) for c in names]), F.expr(f"int(piece div {per})").alias("shard"), (offset + rank).cast("bigint").alias("slot"))
