"""WARC records, archives and their reader."""

from __future__ import annotations

import hashlib
import io
import zlib

import pytest

from tidalspan.llm.queries import QUERIES
from tidalspan.llm.warc import members, parse, read_archives, record, write_archives


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_members_come_apart_at_any_read_size(piece):
    packed = [record(i, f"http://x/{i}", b"abc" * i) for i in range(6)]
    got = list(members(io.BytesIO(b"".join(packed)), piece))
    assert [g for g, _ in got] == [zlib.decompress(p, 31) for p in packed] and all(whole for _, whole in got)


def test_damage_is_told():
    good = zlib.decompress(record(1, "http://x\r\nInjected: 1", b"payload \r\n\r\n WARC/1.1"), 31)
    assert parse(good) == ("1", "response", "http://xInjected: 1", 21, hashlib.sha1(b"payload \r\n\r\n WARC/1.1").hexdigest(), None, None)
    assert parse(good.replace(b"payload", b"Payload"))[-1] == "digest"
    assert parse(good[:-6])[-1] == "length" and parse(good[:-6], False)[-1] == "truncated" and parse(b"")[-1] == "length"
    cut = record(1, None, b"x" * 5000)[:-9]
    assert [whole for _, whole in members(io.BytesIO(record(2, None, b"") + cut))] == [True, False]
    broken = bytearray(record(1, None, b"abc" * 500))
    broken[30] ^= 255
    assert list(members(io.BytesIO(bytes(broken))))[-1][1] is False
    assert list(members(io.BytesIO(b""))) == []


def test_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", big), (7, "u7", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (8, "u8", ""), (None, "un", big), (None, "uo", other),
            (None, "uo", other), (9, "u9", "y" * 999), (10, "u10", "y" * 999), (11, "u11", "long " * 200_000), (12, "u12", "t" * 2000), (12, "u12", "t" * 2000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, path string").repartition(3)
    manifest = write_archives(pages, archive_bytes=500)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 3
    got = read_archives(manifest).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if h == html and p is not None]
        revisit = len(data) >= 1000 and ids and page != max(ids)
        want.append((None if page is None else str(page), "revisit" if revisit else "response", len(data), hashlib.sha1(data).hexdigest(), str(max(ids)) if revisit else None, None))
    assert sorted(map(str, ((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.problem) for r in got))) == sorted(map(str, want))
    assert read_archives(manifest)._jdf.queryExecution().toRdd().getNumPartitions() == manifest.count()  # a task for each archive
    empty = write_archives(pages.where("false"))
    assert empty.count() == 0 and read_archives(empty).count() == 0


def test_query_with_null_ids(spark, tmp_path):
    rows = [(1, "u", "z" * 2000), (None, "v", "z" * 2000), (None, None, "short"), (2, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op9_warc"](spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        ("1", 2000, "response", None), ("2", 0, "response", None), ("None", 5, "response", None), ("None", 2000, "revisit", 1)]
    assert all(r.problem is None for r in got)
