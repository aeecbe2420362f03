"""Near-duplicate documents: MinHash signatures, banding, signature checks, exact checks, alternating star components.

A document is its set of distinct word shingles (five words; fewer words make one shingle).  Equal sets are one class
from the start, so copies cost nothing after the scan.  Every class gets universal hash minima, cut into bands; classes
that share a band are candidates.  Candidate pairs whose signatures agree too little are dropped, all others are
decided by the exact similarity of the full sets.

No bucket is expanded into all its pairs.  Every bucket is a star around its smallest class: first each class is held
against one of its stars, then against those whose other end is not already one link away.  Buckets that hold several components
even then are looked at again: their classes are compared across components in blocks of bounded size, by signature and
then by full set, and a block gives links only, never candidate pairs.  A pair sharing a band is thus either linked,
compared, or in one component.  A pair that shares several bands is compared in the bucket of the first of them only.

No whole text is shuffled: bit tables of what is wanted keep all other bands, signatures and texts in their task.

At similarity 0.75 a pair shares no band with probability 5e-6 (32 bands of 4 minima) and fails the signature check
with about 1e-6.  Classes and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.bits import bit_table, may_hold, passing
from tidalspan.llm.components import apart, blocks_across, components
from tidalspan.llm.store import keep
from tidalspan.llm.textbytes import NOT_SPACE, buffers, grams, mix, slices, words
from tidalspan.llm.workers import lean

BANDS, ROWS, SHINGLE, UNIT = 32, 4, 5, 256
MINIMA = BANDS * ROWS
SLACK = 0.19  # five standard deviations of a signature's similarity at 0.75
_rng = np.random.default_rng(8)
_FACTOR = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADDEND = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_MIXERS = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets):
        hashes, first = words(data, offsets[lo: hi + 1], NOT_SPACE)
        runs = grams(hashes, k)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(runs[a: b - k + 1])
            else:
                yield grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of universal hashes of a set."""
    x = shingles.astype(np.uint32)
    least = np.full(MINIMA, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at: at + 1024, None] * _FACTOR + _ADDEND).min(axis=0), out=least)
    return least


def bands_of(minima: np.ndarray) -> np.ndarray:
    """The band hashes of signatures, a row each."""
    rows = (minima.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _MIXERS
    return mix(rows.sum(axis=2, dtype=np.uint64) + _SALT).astype(np.int64)


def _stacked(minima: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(minima), np.uint32).reshape(-1, MINIMA)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    folded = mix(shingles + np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.array([folded.sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).astype(np.int64)[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, names, minima = [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            if not len(s):
                names.append(None), minima.append(None)
                continue
            names.append(class_of(s))
            minima.append(signature(s).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(minima, pa.binary())],
            ["doc_id", "text_xxh", "n_shingles", "cls", "minima"])


def _banded(table=None):
    """(cls, band) for every band of a signature, or for those that a bit table lets pass."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                band = bands_of(_stacked(batch.column(1).to_pylist())).ravel()
                cls = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                if table is not None:
                    good = may_hold(table.value, band.view(np.uint64))
                    cls, band = cls[good], band[good]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(band)], ["cls", "band"])
    return run


def _sets(table):
    """Names and full sets of the texts whose key a bit table lets pass."""
    def run(batches):
        for batch in passing(table)(batches):
            names, sets = [], []
            for s in shingle_sets(batch.column(1)):
                if len(s):
                    names.append(class_of(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["cls", "shingles"])
    return run


def _agreeing(share: float):
    """Filter of pairs by their signatures."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_stacked(batch.column(i).to_pylist()) for i in (2, 3))
                yield batch.filter(pa.array((a == b).mean(axis=1) >= share)).select(["u", "v"])
    return run


def _similar(percent: int):
    """Filter of pairs by 100 * intersection >= percent * union of their full sets."""
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])
    return run


def _by_unit(handle):
    """Runs of rows with equal bucket, x and y, which come sorted and whole, go to ``handle``."""
    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if row[:3] != key:
                    if len(rows) > 1:
                        yield handle(key, *zip(*rows))
                    key, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            yield handle(key, *zip(*rows))
    return run


def _facing(side: np.ndarray, comp: np.ndarray, i: int) -> np.ndarray:
    """The rows of a unit that row ``i`` is held against: the other side's, or all if there is one, of other components."""
    return (comp != comp[i]) & ((side == 1) | (not side.any()))


def _open_rows(share: float):
    """The rows of a unit whose signature is near to that of a facing row: never more than came in.

    Two rows meet in the bucket of every band that they share; only in that of the first do they open each other.
    """
    def unit(key, side, comp, cls, minima):
        side, comp = np.array(side), np.array(comp)
        m = _stacked(minima)
        here = bands_of(m) == key[0]
        good = np.zeros(len(side), bool)
        for i in np.flatnonzero(side == 0):
            far = np.flatnonzero(_facing(side, comp, i))
            same = m[far] == m[i]
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            near = far[(same.mean(axis=1) >= share) & here[i, first]]
            good[near] = True
            good[i] |= len(near) > 0
        n = int(good.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), pa.array(side[good], pa.int32()),
             pa.array(comp[good]), pa.array(np.array(cls)[good])], ["bucket", "x", "y", "side", "comp", "cls"])
    return _by_unit(unit)


def _linked_rows(percent: int):
    """Links of a unit by the full sets: for each row one to every facing component that holds a similar row."""
    def unit(key, side, comp, cls, shingles):
        side, comp, cls = np.array(side), np.array(comp), np.array(cls)
        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        sizes = np.array([len(x) for x in sets])
        known, where = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        mark = np.zeros(len(known), np.int64)
        us, vs = [], []
        for i in np.flatnonzero(side == 0):
            mine = where[first[i]: first[i] + sizes[i]]
            mark[mine] = 1
            both = np.add.reduceat(mark[where], first)
            mark[mine] = 0
            near = np.flatnonzero(_facing(side, comp, i) & (100 * both >= percent * (sizes + sizes[i] - both)))
            one = near[np.unique(comp[near], return_index=True)[1]]
            us += [cls[i]] * len(one)
            vs += cls[one].tolist()
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
    return _by_unit(unit)


def _table(hashes: DataFrame):
    """A bit table for all tasks: 4 MB."""
    return hashes.sparkSession.sparkContext.broadcast(bit_table(hashes))


def _likely(pairs: DataFrame, sigs: DataFrame, share: float) -> DataFrame:
    """Those of ``pairs`` whose signatures agree often enough."""
    a = sigs.select(F.col("cls").alias("u"), F.col("minima").alias("a"))
    b = sigs.select(F.col("cls").alias("v"), F.col("minima").alias("b"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(lean(_agreeing(share)), "u bigint, v bigint")


def _full_sets(nodes: DataFrame, ids: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The full shingle sets of some classes (column cls).  One document of each is hashed again, and few others."""
    table = _table(ids.join(nodes, "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key")).select("key"))
    sets = docs.select("key", "text").mapInArrow(lean(_sets(table)), "cls bigint, shingles binary")
    return keep(sets.join(nodes, "cls", "left_semi").dropDuplicates(["cls"]), f"{name}-sets")


def _verified(pairs: DataFrame, ids: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""
    sets = _full_sets(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct(), ids, docs, name)
    a = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b")
    return keep(both.mapInArrow(lean(_similar(percent)), "u bigint, v bigint").distinct(), name)


def _sorted_units(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def _rest(buckets: DataFrame, found: DataFrame, sigs: DataFrame, share: float) -> DataFrame:
    """Rows of buckets with several components, in units, that may be similar to a row of another component."""
    rows = buckets.join(found, buckets.cls == found.node, "left").select("bucket", F.coalesce("root", "cls").alias("comp"), "cls")
    units = blocks_across(keep(rows, "bucket-rows"), UNIT).join(sigs, "cls").select("bucket", "x", "y", "side", "comp", "cls", "minima")
    fields = "bucket bigint, x int, y int, side int, comp bigint, cls bigint"
    return keep(_sorted_units(units).mapInArrow(lean(_open_rows(share)), fields), "rest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: as ``near_duplicate_groups`` gives them."""
    return near_duplicate_groups(docs, id_col, text_col, percent).drop("text_xxh", "group")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id = component_id),
    text_xxh (xxhash64 of the text), group (a number for each set of linked rows, whatever their ids; null without words).

    One row per input row.  A text that is null or has no words has an empty set: it is linked with nothing, is its own
    component and kept.  Repeated rows get equal results.  A null id takes part in links but is no component's name
    unless all ids there are null; its row is kept only then.  Unrelated texts under one id are different groups with the
    same component_id; text_xxh and group tell them apart.  Other columns of ``docs`` are not looked at, whatever
    their names.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = docs.withColumn("text_xxh", F.xxhash64("text"))
    signed = keep(texts.mapInArrow(lean(_signed), "doc_id bigint, text_xxh bigint, n_shingles bigint, cls bigint, minima binary"), "signed")
    share = percent / 100 - SLACK
    minima = signed.where("cls is not null").select("cls", "minima")
    # Buckets with more than one class; copies are one class, so they open no bucket.
    hubs = minima.mapInArrow(lean(_banded()), "cls bigint, band bigint").groupBy("band").agg(F.min("cls").alias("u"), F.max("cls").alias("last"))
    hubs = keep(hubs.where("u != last").select("band", "u"), "hubs")
    rows = minima.mapInArrow(lean(_banded(_table(hubs.select("band")))), "cls bigint, band bigint")
    buckets = keep(rows.join(hubs, "band").distinct(), "buckets")
    stars = buckets.where("cls != u").select("u", F.col("cls").alias("v")).distinct()
    nodes = buckets.select("cls").distinct()
    sigs = minima.mapInArrow(lean(passing(_table(nodes))), "cls bigint, minima binary").join(nodes, "cls", "left_semi")
    sigs = keep(sigs.dropDuplicates(["cls"]), "signatures")
    key = F.xxhash64("doc_id", "text_xxh").alias("key")
    ids, docs = signed.select("cls", key), texts.select(key, "text")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        return _verified(keep(_likely(pairs, sigs, share), f"{name}-likely"), ids, docs, percent, name)

    # One star per class first: large groups hang together after it, and most of their other stars need no look.
    first = linked(stars.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "first")
    links = first.union(linked(apart(stars, first), "stars"))
    found = components(links)
    rest = _rest(buckets.select(F.col("band").alias("bucket"), "cls"), found, sigs, share)
    if not rest.isEmpty():
        units = rest.join(_full_sets(rest.select("cls").distinct(), ids, docs, "rest"), "cls")
        units = _sorted_units(units.select("bucket", "x", "y", "side", "comp", "cls", "shingles"))
        found = components(links.union(keep(units.mapInArrow(lean(_linked_rows(percent)), "u bigint, v bigint").distinct(), "more")))
    return _labelled(signed, found)


def _labelled(signed: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with the smallest id of its component."""
    named = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = named.join(found, named.cls == found.node, "left").select("cls", "least", "n", F.coalesce("root", "cls").alias("group"))
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_class = keep(named.join(names, "group").select("cls", "n", "component_id", "group"), "classes")
    # A class with a thousandth of all rows or more would be one large task: there are a thousand of these at most.
    total = by_class.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") >= max(1000, total / 1000)
    some = F.broadcast(by_class.where(large).drop("n"))
    rows = signed.where("cls is not null").select("doc_id", "text_xxh", "n_shingles", "cls")
    labelled = rows.join(some, "cls").unionByName(rows.join(some, "cls", "left_anti").join(by_class.where(~large).drop("n"), "cls")).drop("cls")
    alone = signed.where("cls is null").select("doc_id", "text_xxh", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("group"))
    return labelled.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_xxh", "group")
