"""The bit table that keeps hopeless rows out of a shuffle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tidalspan.llm.bits import LOG_BITS, bit_table, may_hold


@pytest.mark.parametrize("n", [0, 1, 300_000])
def test_bit_table_comes_to_the_driver_in_few_rows(spark, monkeypatch, n):
    hashes = spark.range(n).select(F.xxhash64("id").alias("h"))
    h = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    bits = np.zeros(1 << LOG_BITS, bool)
    bits[h & np.uint64((1 << LOG_BITS) - 1)] = bits[h >> np.uint64(64 - LOG_BITS)] = True
    came, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: came.append(collect(df)) or came[-1])
    table = bit_table(hashes.repartition(5).union(hashes.limit(3)))
    assert sum(map(len, came)) <= 64
    assert table == np.packbits(bits, bitorder="little").tobytes()
    assert may_hold(table, h).all()
