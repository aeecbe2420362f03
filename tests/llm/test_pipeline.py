"""Registered queries of the subpackage against their SQL, and the pipeline's stages against what they must keep."""

from __future__ import annotations

import zlib

import duckdb
import pytest
from check_oracle import compare, connect
from corpus import documents, odd_rows, sentence

import corpus_pipeline
from tidalspan.llm import queries
from tidalspan.llm.oracle import ORACLE
from tidalspan.llm.queries import QUERIES
from tidalspan.llm.sharding import shuffle_into_shards
from tests.llm.test_texts import brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_mixing_of_unequal_sources(spark, tmp_path):
    rows = [(i, s) for i, s in enumerate(s for s, n in (("a", 700), ("b", 250), ("c", 33), ("d", 16), ("e", 1)) for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert compare(spark, con, str(tmp_path), "op10_mixing") is None


def two_texts(spark, like):
    """One id with two unrelated texts, a near copy of one of them, repeated rows, and rows without an id."""
    a, b = sentence(1, 200), sentence(2, 200)
    rows = [(1, a), (1, b), (2, b + " and more"), (3, sentence(3, 60)), (3, sentence(3, 60)), (None, sentence(4, 60)), (None, sentence(4, 60)), (None, sentence(5, 60)), (4, sentence(5, 60)), (5, None), (6, "")]
    return documents(spark, rows).select(like.columns), a, b


def test_near_dedup_loses_no_text(spark):
    docs, a, b = two_texts(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted([("1", a), ("1", b), ("3", sentence(3, 60)), ("None", sentence(4, 60)), ("4", sentence(5, 60))])
    assert sorted(r.doc_id for r in kept if not r.text) == [5, 6]


def test_language_stage_leaves_own_columns(spark):
    docs = documents(spark, [(1, sentence(1, 30), "en"), (2, None, "en"), (3, "123", "en")])
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and [(r.doc_id, r.score, r.lang_pred) for r in kept.collect()] == [(1, "x", "x")]


def test_sharding_moves_the_texts(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries, "shuffle_into_shards", lambda df: given.append(df.columns) or shuffle_into_shards(df))
    out = {r.doc_id: (r["size"], r.text_crc32) for r in QUERIES["op2_sharding"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert given == [docs.columns]
    assert out == {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    odd = documents(spark, odd_rows()).select(docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
        ids = [r.doc_id for r in rows]
        if name == "language_id":
            assert sorted(ids) == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text or ""))
        elif name == "near_dedup":
            dups = {r["doc_id"]: r["component_id"] for r in QUERIES["op8_near_dedup"](spark, SF).collect()}
            assert sorted(ids) == sorted({dups[r.doc_id] for r in before})
        elif name == "decontaminate":
            assert sorted(ids) == sorted(r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before], items) if not r[-1])
        else:
            assert sorted(ids) == sorted(r.doc_id for r in before)
        assert stage(spark, docs.where("false"), SF).count() == 0
        kept = stage(spark, odd, SF).collect()
        assert len(kept) <= len(odd_rows()) and (name not in ("mixing", "sharding") or len(kept) == len(odd_rows()))
        docs = spark.createDataFrame(rows, out.schema).select(docs.columns)


def test_run(spark):
    """The rows that the stages' operators, each on the whole table, say should be left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lettered = {r.doc_id: r.text for r in docs if any(c.isalpha() for c in r.text or "")}
    dups = {r.doc_id: r.component_id for r in QUERIES["op8_near_dedup"](spark, SF).collect()}
    first = {dups[i] for i in lettered}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_contamination([(i, lettered[i]) for i in first], items) if not r[-1]}
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(clean) and all(r.text == lettered[r.doc_id] for r in out)
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(16) for i in range(sum(r.shard == s for r in out))]
