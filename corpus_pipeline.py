"""A corpus from raw documents to shards, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a DataFrame, which is
written as Parquet and read again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalspan.llm.decontaminate import contamination
from tidalspan.llm.language_id import UNKNOWN, identify, train
from tidalspan.llm.mixing import mix_sources
from tidalspan.llm.near_dedup import near_duplicate_groups
from tidalspan.llm.sharding import shuffle_into_shards
from tidalspan.llm.store import keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language they are written in; those without any letter go.

    Null and empty texts have no letter and go.  Repeated rows and null ids are rows like any other; an empty table
    stays empty.  All columns stay as they are but for lang.
    """
    taken = {c: f"own {c}" for c in ("lang_pred", "score") if c in docs.columns}
    known = identify(docs.withColumnsRenamed(taken), train(docs)).where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.col("lang_pred"))
    return known.select([F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest id, and of such the smallest text hash.

    Rows are told apart by id and text, so unrelated texts under one id all stay, and rows without an id are kept or
    dropped like others (a null id comes after all others).  Repeated rows become one.  Null texts and texts without
    words are nobody's duplicates and all stay.  An empty table stays empty.
    """
    found = keep(near_duplicate_groups(docs).select("doc_id", "text_xxh", "group"), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_xxh")).alias("least")
    named = found.where("group is not null").groupBy("group").agg(least).select("least.doc_id", "least.text_xxh", F.lit(True).alias("grouped"))
    alone = found.where("group is null").select("doc_id", "text_xxh").distinct().withColumn("grouped", F.lit(False))
    kept = named.union(alone).select(F.col("doc_id").alias("kept_id"), F.col("text_xxh").alias("kept_text"), "grouped")
    texts = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("bigint").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("hash"))
    rows = texts.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_text")))
    repeated = found.where("group is not null").groupBy("doc_id", "text_xxh").count().where("count > 1")
    if not repeated.isEmpty():  # else nothing has to be shuffled again
        rows = rows.where("grouped").dropDuplicates(["id", "hash"]).union(rows.where("not grouped"))
    return rows.select([F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go; the rest stays untouched.

    Null and empty texts have no window and stay, as do repeated rows and rows without an id if their own text is
    clean: rows are told apart by id and text.  An empty table stays empty.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    found = found.select(F.col("doc_id").alias("bad_id"), F.col("text_xxh").alias("bad_text")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_text")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: the part files, read in turn, hold the sources by their weights.

    Weights are the square roots of the sources' sizes.  A null source is a source of its own; nulls, empty texts and
    repeated rows are rows like any other; an empty table stays empty.  The sharding behind it is a uniform shuffle, so
    in run() the order is that of this stage's table only.
    """
    return mix_sources(docs).orderBy("slot", "row_in_block").select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it; nulls, empty texts and repeated rows are rows like any
    other, an empty table stays empty, and columns named shard and slot are replaced."""
    return shuffle_into_shards(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Learned languages and random shards are nothing that SQL can repeat; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
