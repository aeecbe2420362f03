"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Archives are real files in a folder that all executors share.  The manifest that the writer returns names the files of
the tasks that succeeded, so what a lost task has left behind is never read.  The reader decompresses a stream piece
by piece, frames records by their Content-Length and checks block and payload digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.store import keep, new_folder

ARCHIVE_BYTES, PIECE = 32 << 20, 1 << 18
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:page:"
RECORD = "page_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to string, problem string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A compressed response record, or a revisit record of the page ``refers_to`` whose payload is left out.

    The record of a page without an id is named by a UUID.
    """
    name = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"{PAGE}{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
              f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO, piece: int = PIECE) -> Iterator[tuple[bytes, bool]]:
    """Each gzip member of a stream, and whether it is complete."""
    rest = b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                yield b"".join(parts), False
                return
            try:
                parts.append(unpacker.decompress(rest))
            except zlib.error:  # nothing after a damaged member can be framed
                yield b"".join(parts), False
                return
            rest = unpacker.unused_data if unpacker.eof else stream.read(piece)
        yield b"".join(parts), True


def _headers(text: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in text.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(member: bytes, whole: bool = True) -> tuple:
    """The fields of ``RECORD``; problem is null, truncated, length or digest."""
    head, _, rest = member.partition(b"\r\n\r\n")
    warc = _headers(head)
    size = int(warc.get("content-length", -1)) if warc.get("content-length", "").isdigit() else -1
    block, tail = rest[: max(size, 0)], rest[max(size, 0):]
    http, _, payload = block.partition(b"\r\n\r\n")
    problem = None if whole else "truncated"
    if problem is None and (size < 0 or len(block) != size or tail != b"\r\n\r\n"):
        problem = "length"
    if problem is None and _sha1(block) != warc.get("warc-block-digest", _sha1(block)):
        problem = "digest"
    named = warc.get("warc-payload-digest", "")
    page = lambda key: warc[key].strip("<>").removeprefix(PAGE) if warc.get(key, "").startswith("<" + PAGE) else None
    if warc.get("warc-type") == "revisit":  # its payload is the referred page's: size and digest are told, not stored
        count = _headers(http).get("content-length", "")
        size, digest = int(count) if count.isdigit() else None, base64.b32decode(named.removeprefix("sha1:")).hex() if named else None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if problem is None and named and named != _sha1(payload):
            problem = "digest"
    return page("warc-record-id"), warc.get("warc-type"), warc.get("warc-target-uri"), size, digest, page("warc-refers-to"), problem


def _writer(folder: str, most: int):
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        path = out = None
        count = size = 0
        done = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                packed = record(row[0], row[1], (row[2] or "").encode(), row[3])
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= most:
                    out.close()
                    done.append((path, count, size))
                    out, count, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, count, size))
        names = [folder.rstrip("/") + p[len(base.rstrip("/")):] for p, _, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64())],
                                         ["path", "records", "bytes"])
    return run


def _reader(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as stream:
                rows = []
                for member, whole in members(stream):
                    rows.append(parse(member, whole))
                    if len(rows) == 1000:
                        yield _table(rows)
                        rows = []
                yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per page; returns the manifest (path, records, bytes) of the archives.

    Of pages with equal payloads of ``least_revisit`` bytes or more, those with the largest id are responses and the
    others revisit them; smaller payloads are always responses.  A null payload is empty, a null URL is left out.  A
    null id loses to any other; if all are null, all are responses; its record reads back with a null page_id.  Rows
    repeated under the largest id are all responses.  An empty table writes no archive.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_revisit
    first = pages.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = pages.join(first, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return keep(rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(
        _writer(folder or new_folder(spark, "warc"), archive_bytes), "path string, records bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives whose ``path`` is listed: the fields of ``RECORD``, one row per record.

    Paths are URIs that pyarrow opens.  A damaged or cut-off member ends its archive and is told in ``problem``, as are
    wrong lengths and digests.  There are as many tasks as archives, so reading takes as long as the larger archives do.
    """
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(_reader, RECORD)
