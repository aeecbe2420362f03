"""Benchmark decontamination by winnowing.

Of every ten words in a row the least of the six 5-gram hashes is the fingerprint; equal runs of ten words have equal
fingerprints, so every shared span of ten words or more shares one (k-gram 5 + window 6 - 1 = 10).  Fingerprints of
documents are joined with those of the benchmark, and a hit counts only when it extends to the whole window.  Benchmark
items of fewer than ten words are one window of their own length.

Nothing that grows is broadcast: what tasks get is a bit table of fixed size (4 MB) over the benchmark's fingerprints.
It only keeps hopeless fingerprints out of the shuffle; all decisions come from the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.bits import bit_table, may_hold
from tidalspan.llm.store import keep
from tidalspan.llm.textbytes import _PLACE, LETTERS_DIGITS, buffers, grams, mix, slices, words
from tidalspan.llm.workers import lean

WINDOW, GRAM = 10, 5
_HITS = pa.list_(pa.struct([("fp", pa.int64()), ("win", pa.int64()), ("len", pa.int32()), ("starts", pa.list_(pa.int32()))]))


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    """For each window of ten words the least hash of its 5-grams."""
    g = grams(hashes, GRAM)
    n = len(hashes) - WINDOW + 1
    least = g[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, g[j: j + n], out=least)
    return least


def _at(hashes: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """The k-gram hashes that begin at ``where``, as ``grams`` makes them."""
    total = np.full(len(where), np.uint64(k))
    for j in range(k):
        total += hashes[where + j] * _PLACE[j]
    return mix(total)


def _item_windows(batches):
    for batch in batches:
        ids, fps, wins, lens = [], [], [], []
        data, offsets = buffers(batch.column(1))
        names = batch.column(0).to_pylist()
        for lo, hi in slices(offsets):
            hashes, first = words(data, offsets[lo: hi + 1], LETTERS_DIGITS)
            for row, a, b in zip(range(lo, hi), first[:-1], first[1:]):
                if b == a:
                    continue
                k = min(WINDOW, int(b - a))
                win = grams(hashes[a:b], k)
                fp = _fingerprints(hashes[a:b]) if k == WINDOW else win
                ids += [names[row]] * len(win)
                fps.append(fp.astype(np.int64)), wins.append(win.astype(np.int64))
                lens += [k] * len(win)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.concatenate(fps)), pa.array(np.concatenate(wins)),
                                              pa.array(lens, pa.int32())], ["item", "fp", "win", "len"])


def _scan(table, lengths: list[int]):
    """Words of each document, and its windows whose fingerprint the benchmark may have."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(1))
            counts, keys, found = [], [None] * batch.num_rows, [None] * batch.num_rows
            for lo, hi in slices(offsets):
                hashes, first = words(data, offsets[lo: hi + 1], LETTERS_DIGITS)
                counts.append(np.diff(first))
                row = np.repeat(np.arange(lo, hi), counts[-1])
                hits: dict[int, dict] = {}
                for k in lengths:
                    if len(hashes) < k:
                        continue
                    fp = _fingerprints(hashes) if k == WINDOW else grams(hashes, k)
                    at = np.flatnonzero((row[: len(fp)] == row[k - 1:]) & may_hold(table.value, fp))
                    for r, f, w, s in zip(row[at].tolist(), fp[at].astype(np.int64).tolist(), _at(hashes, at, k).astype(np.int64).tolist(),
                                          (at - first[row[at] - lo]).tolist()):
                        hits.setdefault(r, {}).setdefault((f, w, k), []).append(s)
                for r, wins in hits.items():
                    keys[r] = xxhash.xxh3_128_digest(data[offsets[r]: offsets[r + 1]])
                    found[r] = [{"fp": f, "win": w, "len": k, "starts": s} for (f, w, k), s in wins.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(counts), pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(found, _HITS)], ["doc_id", "text_xxh", "n_words", "key", "hits"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_xxh (xxhash64 of the text).

    One row per input row.  Null and empty texts have no words and no hits; an empty or null item has no window.  Items
    sharing an id count once; an item without an id marks words but is not counted or named.  Repeated rows get equal
    results, other columns are ignored, an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_xxh"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = keep(items.mapInArrow(lean(_item_windows), "item string, fp bigint, win bigint, len int").distinct(), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # ten values at most
    table = spark.sparkContext.broadcast(bit_table(windows.select("fp")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = keep(docs.mapInArrow(
        lean(_scan(table, lengths)),
        f"doc_id {kind}, text_xxh bigint, n_words bigint, key binary, hits array<struct<fp: bigint, win: bigint, len: int, starts: array<int>>>"), "scanned")
    # Equal texts are looked up once.
    some = scanned.where("key is not null").groupBy("key").agg(F.first("hits").alias("hits")).select("key", F.inline("hits"))
    on = ["fp", "win", "len"]
    spans = some.join(windows.select(on).distinct(), on, "left_semi").select(
        "key", F.expr("transform(starts, s -> struct(s as a, s + len as b))").alias("spans"))
    covered = F.expr("""aggregate(sort_array(flatten(collect_list(spans))), named_struct('n', 0L, 'to', 0),
      (x, s) -> named_struct('n', x.n + greatest(0, s.b - greatest(s.a, x.to)), 'to', greatest(x.to, s.b)), x -> x.n)""")
    hit = spans.groupBy("key").agg(covered.alias("n_hit"))
    named = some.select("key", *on).join(windows.where("item is not null"), on).select("key", "item").distinct()
    named = named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    verdicts = hit.join(named, "key", "left")
    plain = ["doc_id", "text_xxh", "n_words", "key"]
    rows = scanned.where("key is not null").select(plain).join(verdicts, "key", "left").select(*plain, "n_hit", "items").union(
        scanned.where("key is null").select(*plain, F.lit(None).cast("bigint"), F.lit(None).cast("array<string>")))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_xxh")
