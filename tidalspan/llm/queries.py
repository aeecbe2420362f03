"""One query per operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalspan.llm.alignment import cross_tokenizer_alignment
from tidalspan.llm.ann import search
from tidalspan.llm.decontaminate import contamination
from tidalspan.llm.divergence import quality_rules
from tidalspan.llm.hard_negatives import mine_hard_negatives
from tidalspan.llm.language_id import identify, is_held_out, train
from tidalspan.llm.line_dedup import fuzzy_line_dedup
from tidalspan.llm.mixing import mix_sources
from tidalspan.llm.near_dedup import near_duplicates
from tidalspan.llm.quality import describe, fit, score_quality
from tidalspan.llm.quality import is_held_out as quality_held_out
from tidalspan.llm.secrets import secret_scan
from tidalspan.llm.sharding import shuffle_into_shards
from tidalspan.llm.store import keep
from tidalspan.llm.warc import read_archives, write_archives


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A document is a repository of its own, its source the owner."""
    return secret_scan(_table(spark, folder, "documents"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents are sharded and written; the digest is that of the texts as they arrived.

    A null text has no bytes: size 1, CRC 0.
    """
    return keep(shuffle_into_shards(_table(spark, folder, "documents")), "shards").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("text_xxh")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_line_dedup(_table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    described = keep(describe(_table(spark, folder, "documents").select("doc_id", "text")), "described")
    model = fit(described, _table(spark, folder, "labels"))
    return score_quality(described, model).select("doc_id", quality_held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = read_archives(write_archives(_table(spark, folder, "pages")))
    return read.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"), "problem")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents").select("doc_id", "source"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(_table(spark, folder, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("word_distance", "class_distance")})


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return cross_tokenizer_alignment(_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, relabelled)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sharding": op2_sharding,
    "op3_nearest": op3_nearest,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_quality_rules": op11_quality_rules,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}
