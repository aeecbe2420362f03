"""Alignment of the tokens of two tokenizers by merge-path partitioning, and how often token pairs end together.

Both tokenizers cut the same bytes, so each gives a rising list of token ends.  Merging the two lists finds the bytes
where both end: these cut the tokens into groups, and the two tokens that end there are linked.  The merge is divided
along the diagonals of the merge grid: a binary search on each diagonal tells how many ends of either list come before
it, so that every piece merges an equal number of ends on its own, wherever in the text they lie.  A piece emits the
overlaps of its tokens; where a border cuts an overlap, both pieces emit it and the stitching joins the two.

Of two tokens that end together one is a suffix of the other.  The pairs that can be linked at all therefore follow
from the two vocabularies (some hundred thousand), and counts over any corpus fit in one array of that size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 8192  # ends merged by one piece
SLICE = 1 << 20  # characters of text behind one batch of results
A_ENDS, B_ENDS = 1, 2


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Two tokenizers, the bytes of their tokens and the pairs of tokens that can end together."""

    def __init__(self, file_a: bytes, file_b: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(file_a)
        letters = byte_letters()
        special = {x["id"] for x in model.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special}
        self.bytes_a = [b""] * (1 + max([*ranks.values(), *special]))
        for t, i in ranks.items():
            self.bytes_a[i] = t
        # The same merges as the file's own library makes, ids being their order; that library remains for texts on
        # which this one gives up.
        self._fast = tiktoken.Encoding("a", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
                                       mergeable_ranks=ranks, special_tokens={})
        self._slow = lambda: Tokenizer.from_str(file_a.decode())
        self._b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.pairs = np.array(sorted(self._suffix_pairs()), np.int64)
        self.texts = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))] + [f"{i}{end}" for end in ",;" for i in range(len(pieces))]

    def _suffix_pairs(self) -> set[int]:
        """a * (size of B) + b of all pairs of which one token is a suffix of the other."""
        of_a, of_b = {}, {}
        for tokens, of in ((self.bytes_a, of_a), (self.bytes_b, of_b)):
            for i, t in enumerate(tokens):
                if t:
                    of.setdefault(t, []).append(i)
        n = len(self.bytes_b)
        out = {a * n + b for t, ids in of_a.items() for k in range(len(t)) for b in of_b.get(t[k:], ()) for a in ids}
        return out | {a * n + b for t, ids in of_b.items() for k in range(1, len(t)) for a in of_a.get(t[k:], ()) for b in ids}

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text`` behind a space; None if the tokens of either don't spell exactly that."""
        spaced = " " + text
        try:
            whole = spaced.encode()
        except UnicodeEncodeError:
            return None
        try:
            a = self._fast.encode_ordinary(spaced)
        except BaseException as error:  # its panics are no Exceptions
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            slow = self._slow()
            slow.encode_special_tokens = True
            a = slow.encode(spaced, add_special_tokens=False).ids
        b = self._b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def _loaded(shared) -> Tokenizers:
    """What the broadcast [file of A, file of B, None] holds, made once in a worker and kept in the third place."""
    held = shared.value
    if held[2] is None:
        held[2] = Tokenizers(*held[:2])
    return held[2]


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` merged ends come from ``a``, for every diagonal d; of equal ends that of ``a`` comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        i, j = np.where(open_, middle, 0), np.where(open_, diagonals - 1 - middle, 0)
        earlier = a[i] <= b[j] if len(a) and len(b) else np.zeros(len(low), bool)
        low, high = np.where(open_ & earlier, middle + 1, low), np.where(open_ & ~earlier, middle, high)
    return low


def merge_piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps that end at an end of this piece: (end, token of a, token of b, which of them end there)."""
    mine_a, mine_b = a[i[0]: i[1]], b[j[0]: j[1]]
    ends = np.union1d(mine_a, mine_b)
    at_a, at_b = np.searchsorted(mine_a, ends), np.searchsorted(mine_b, ends)
    is_a, is_b = np.append(mine_a, -1)[at_a] == ends, np.append(mine_b, -1)[at_b] == ends
    return ends, i[0] + at_a, j[0] + at_b, is_a * A_ENDS + is_b * B_ENDS


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two tokenizations in order: the pieces of the merge, stitched where a border cut an overlap."""
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = crossings(a, b, diagonals)
    j = diagonals - i
    pieces = [merge_piece(a, b, (i[k], i[k + 1]), (j[k], j[k + 1])) for k in range(len(diagonals) - 1)]
    ends, at_a, at_b, which = (np.concatenate(x) for x in zip(*pieces))
    cut = np.flatnonzero(ends[1:] == ends[:-1])  # only across a border: the end of a token of a, then that of b
    which[cut] |= which[cut + 1]
    stay = np.ones(len(ends), bool)
    stay[cut + 1] = False
    # The token of b that an overlap of the earlier piece names is the right one: that of the later piece began there.
    return ends[stay], at_a[stay], at_b[stay], which[stay]


def group_text(t: Tokenizers, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
    """`a1,a2|b1;a3|b2,b3` of groups that end with the given tokens."""
    n = len(t.bytes_a)
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[last_a] = closes_b[last_b] = 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + n * closes_a
    out[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * n + b + len(t.bytes_b) * closes_b
    return "".join(map(t.texts.__getitem__, out.tolist()))[:-1]


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<int>, times array<int>"


def _aligned(files, piece: int):
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(files)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = t.encode(text) if text else None
                if ids is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", [], []))
                else:
                    a, b = ids
                    _, at_a, at_b, which = overlaps(np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b]), piece)
                    both = which == A_ENDS | B_ENDS
                    last_a, last_b = at_a[both], at_b[both]
                    found, times = np.unique(a[last_a] * len(t.bytes_b) + b[last_b], return_counts=True)
                    pairs = np.searchsorted(t.pairs, found).astype(np.int32)
                    rows.append((doc_id, len(a), len(b), len(last_a), len(last_a), group_text(t, a, b, last_a, last_b), pairs, times.astype(np.int32)))
                size += len(text or "")
                if size >= SLICE:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)
    return run


def _counted(n: int):
    """Links of each pair in a partition."""
    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten(), batch.column(1).flatten(), n).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["pair", "n"])
    return run


def _scored(counts):
    def run(batches):
        n, best = counts.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(k)) for k in ("pairs", "times"))
            ends = np.append(0, np.cumsum(np.array(pc.list_value_length(pairs))))
            pair, time = np.array(pairs.flatten(), np.int64), np.array(times.flatten(), np.int64)
            sums = [np.append(0, np.cumsum(time * x[pair]))[ends] for x in (best, n)]
            out = [x for x, name in zip(batch.columns, batch.schema.names) if name not in ("pairs", "times")]
            names = [x for x in batch.schema.names if x not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(np.diff(x)) for x in sums)], [*names, "n_best", "count_sum"])
    return run


def read_files(folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> tuple[bytes, bytes]:
    """The vocabulary files, read on the driver; tasks get their bytes (some megabytes) with a broadcast."""
    out = []
    for name in (file_a, file_b):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def align_tokens(docs: DataFrame, files: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;...`), pairs and times (numbers of linked id pairs, how often).

    One row per input row, repeated rows and null ids included.  A text that is null or empty, or that the tokens of
    either tokenizer don't spell with a space in front, has no tokens: zeros, '' and empty lists.  Other columns of
    ``docs`` are not looked at; an empty table gives an empty one.  Texts are encoded whole, one after the other.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_aligned(docs.sparkSession.sparkContext.broadcast([*files, None]), piece), ALIGNED)


def count_links(aligned: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """``aligned`` (written down before, as it is read twice) with n_best and count_sum in place of pairs and times.

    A pair's count is how many links of all rows hold it.  n_best: the row's links whose count is the highest of any
    pair with the same B id, ties included; count_sum: the counts of all its links.  0 for rows without links.  What
    comes to the driver and is broadcast has one number for each pair that the vocabularies allow.
    """
    t = Tokenizers(*files)
    size = len(t.pairs)
    by_pair = aligned.select("pairs", "times").mapInArrow(_counted(size), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = by_pair.toArrow()
    n = np.zeros(size, np.int64)
    n[np.array(found.column(0), np.int64)] = np.array(found.column(1), np.int64)
    of_b = t.pairs % len(t.bytes_b)
    highest = np.zeros(len(t.bytes_b), np.int64)
    np.maximum.at(highest, of_b, n)
    counts = aligned.sparkSession.sparkContext.broadcast((n, (n == highest[of_b]).astype(np.int64)))
    fields = [f"{x.name} {x.dataType.simpleString()}" for x in aligned.schema.fields if x.name not in ("pairs", "times")]
    return aligned.mapInArrow(_scored(counts), ", ".join([*fields, "n_best bigint", "count_sum bigint"]))


def cross_tokenizer_alignment(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Alignment of every row with a digest of its groups in place of their text; see the two steps."""
    files = read_files(folder)
    aligned = align_tokens(docs, files)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    return count_links(keep(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), "aligned"), files)
