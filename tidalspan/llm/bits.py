"""A bit table of fixed size over a set of 64-bit hashes, to keep hopeless rows out of a shuffle.

It may let a row pass that is not in the set, never the other way round; the join behind it decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LOG_BITS, BLOCK = 25, 1 << 16


def bit_table(hashes: DataFrame) -> bytes:
    """Two bits of each value of the only column, a long; repeated values and nulls are harmless.

    Tasks set the bits of their own rows and Spark brings the blocks of a place together, so that the driver gets 64
    blocks of 64 KB at most, not the rows or words behind them.
    """
    shape = "block int, bits binary"
    blocks = hashes.mapInArrow(_blocks, shape).repartition("block").mapInArrow(_joined, shape)
    table = bytearray(1 << (LOG_BITS - 3))
    for block, bits in blocks.collect():
        table[block * BLOCK: (block + 1) * BLOCK] = bits
    return bytes(table)


def _blocks(batches):
    """The blocks of a task's bits that are not empty."""
    table = np.zeros(1 << LOG_BITS, bool)
    for batch in batches:
        h = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
        table[h & np.uint64((1 << LOG_BITS) - 1)] = table[h >> np.uint64(64 - LOG_BITS)] = True
    table = np.packbits(table, bitorder="little").reshape(-1, BLOCK)
    for i in np.flatnonzero(table.any(axis=1)).tolist():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([table[i].tobytes()], pa.binary())], ["block", "bits"])


def _joined(batches):
    """Each block once, with the bits that any task has set."""
    table = {}
    for batch in batches:
        for i, bits in zip(*(c.to_pylist() for c in batch.columns)):
            table[i] = table.get(i, 0) | np.frombuffer(bits, np.uint8)
    for i, bits in table.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])


def may_hold(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of some hashes (unsigned) may be in the set."""
    bits = np.frombuffer(table, np.uint64)
    low, high = hashes & np.uint64((1 << LOG_BITS) - 1), hashes >> np.uint64(64 - LOG_BITS)
    both = (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & (bits[high >> np.uint64(6)] >> (high & np.uint64(63)))
    return (both & np.uint64(1)).astype(bool)


def passing(table):
    """Filter of rows by their first column, a long, and a bit table that was broadcast."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(table.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
    return run
