"""Export of breath tables (S8) and the bucketed breath store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def export_breaths(breaths: DataFrame, path: str, fmt: str = "csv", folders: int = 64) -> None:
    """Write breaths, grouped by a hash of the test.

    One folder per test would mean millions of tiny files; ``folders`` hash folders keep
    a test together and the file count fixed.  Rows are spread over tasks by hash and row
    range, so a very long test is written by many tasks.
    """
    folder = F.pmod(F.hash(KEY), F.lit(folders)).alias("bucket")
    order = [KEY, "rn"] if "rn" in breaths.columns else [KEY, "time_s"]
    out = breaths.drop("split", "chunk").select("*", folder)
    out = out.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
    writer = out.write.partitionBy("bucket").mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")


def store_breaths(prepared: DataFrame, name: str, path: str, buckets: int = 512) -> DataFrame:
    """Write a prepared frame as a bucketed table in a shared folder and return the table.

    Rows are bucketed by test (by test and chunk if some test is split) and sorted by row
    number, so that the windows and aggregates of every operator read it without another
    shuffle, and only the columns they need.  Pick ``buckets`` so that a bucket fits a task.
    """
    keys = [KEY, "chunk"] if "split" in prepared.columns else [KEY]
    # Hashing on the bucket keys first makes one file per bucket instead of one per task and bucket.
    hashed = prepared.repartition(buckets, *keys)
    writer = hashed.write.bucketBy(buckets, *keys).sortBy(*keys, "rn")
    writer.option("path", path).mode("errorifexists").format("parquet").saveAsTable(name)
    return prepared.sparkSession.table(name)
