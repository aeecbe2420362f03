"""Secrets in texts, judged by who owns them across the corpus.

A text is searched for assignments, access keys and hexadecimal runs (the base spans), and for other long tokens that
mix letters and digits.  Every candidate value is hashed, and the hashes are counted over the whole corpus by distinct
repositories and distinct owners.  A value that many owners or many repositories have is a widely copied example; any
other that looks random is a live-looking credential of its owner.  Base spans always stay; other tokens become spans
only if they look live.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Equal to the longest runs that are then held to 18 and 16 characters: a shorter start never leads to a longer run.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Dots may join the parts of a token, but don't begin or end it.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{24,}")
LEAST_TOKEN = 24
_SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("bits", pa.float32())])
_FIELDS = "key binary, n_assign bigint, n_access bigint, n_hex bigint, found array<struct<kind: tinyint, start: int, end: int, value: bigint, bits: float>>"


def entropy(value: str) -> float:
    """Bits per character of a string by its own letter counts."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start, then kind; positions are code points, end exclusive."""
    found = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    starts, ends = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for m in TOKEN.finditer(text):
        value = m[0].strip(".")
        s = m.start() + len(m[0]) - len(m[0].lstrip("."))
        e = s + len(value)
        before = bisect_left(starts, e)
        clear = not before or ends[before - 1] <= s  # of all base spans
        if clear and len(value) >= LEAST_TOKEN and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.append((3, s, e, value))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _scan(batches):
    for batch in batches:
        keys, counts, found = [], [], []
        for text in batch.column(0).to_pylist():
            spans = find(text or "")
            kinds = Counter(s[0] for s in spans)
            counts.append([kinds[k] for k in range(3)])
            keys.append(xxhash.xxh3_128_digest(text) if spans else None)
            found.append([{"kind": k, "start": s, "end": e, "value": xxhash.xxh3_64_intdigest(v) - (1 << 63), "bits": entropy(v)} for k, s, e, v in spans] or None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(keys, pa.binary()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
             pa.array(found, pa.list_(_SPAN))],
            [*batch.schema.names[1:], "key", "n_assign", "n_access", "n_hex", "found"])


def _text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
                common_owners: int = 3, common_repos: int = 10, live_bits: float = 3.0) -> DataFrame:
    """Spans of secrets in every text, and what their owners say about them.

    doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all), n_common (spans whose value has
    ``common_owners`` owners or ``common_repos`` repositories or more), n_live (others of at least ``live_bits`` bits per character),
    verdicts (array of kind, start, end, value hash, repositories, owners, verdict).

    One row per input row.  A null or empty text has no span.  A null repository or owner is not counted.  Repeated rows get equal results and count once.  Other columns are ignored and an
    empty table stays empty.
    """
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"),
                       F.col(owner_col).cast("string").alias("owner"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    scanned = keep(docs.mapInArrow(_scan, f"{fields}, {_FIELDS}"), "spans")
    some = scanned.where("key is not null")
    values = some.select("repo", "owner", F.explode("found.value").alias("value")).distinct()
    # Distinct pairs first: a value that a third of all rows share is spread over its repositories.
    repos = values.where("repo is not null").select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("repos"))
    owners = values.where("owner is not null").select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    spread = repos.join(owners, "value", "full")
    # Equal texts have equal spans, so the verdicts are worked out once for each text that has any.
    spans = some.groupBy("key").agg(F.first("found").alias("found")).select("key", F.inline("found"))
    judged = spans.join(spread, "value", "left").withColumns({"repos": F.coalesce("repos", F.lit(0)), "owners": F.coalesce("owners", F.lit(0))})
    common = (F.col("owners") >= common_owners) | (F.col("repos") >= common_repos)
    verdict = F.when(common, "common").when(F.col("bits") >= live_bits, "live").otherwise("unclear")
    judged = judged.withColumn("verdict", verdict).where("kind < 3 or verdict = 'live'")
    by_text = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "repos", "owners", "verdict"))).alias("verdicts"))
    plain = ["doc_id", "key", "n_assign", "n_access", "n_hex"]
    found = some.select(plain).join(by_text, "key", "left").select(*plain, "verdicts")
    rows = found.union(scanned.where("key is null").select(*plain, F.lit(None).cast(by_text.schema["verdicts"].dataType)))
    spans = F.coalesce("verdicts", F.array().cast(by_text.schema["verdicts"].dataType))
    count = lambda what: F.size(F.filter(spans, lambda s: s["verdict"] == what)).cast("bigint")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex",
                       F.sha2(_text_of(F.filter(spans, lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
                       _text_of(spans).alias("spans"), count("common").alias("n_common"), count("live").alias("n_live"), spans.alias("verdicts"))
