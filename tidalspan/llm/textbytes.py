"""Words and word k-grams of whole Arrow text columns, worked out on their UTF-8 bytes with numpy.

Words and k-grams are represented by 64-bit hashes: a polynomial over random byte values, finished by a mixer.
Texts are handled in slices of about half a megabyte, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _rng.integers(1, 1 << 63, 1, dtype=np.uint64)[0] | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Word bytes after lower-casing A-Z: all but white space; and letters a-z, digits and everything beyond ASCII.
NOT_SPACE = np.array([i != 32 and not 9 <= i <= 13 for i in range(256)])
LETTERS_DIGITS = np.array([48 <= i <= 57 or 97 <= _LOWER[i] <= 122 or i >= 128 for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    at, last = 0, len(offsets) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, last)
        at = min(to, last)


class Words(NamedTuple):
    """Words of some rows in order: hash of each, and per row the index of its first word (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of the rows that ``offsets`` cut out of ``data``."""
    lo, n = offsets[0], int(offsets[-1] - offsets[0])
    at = offsets - lo
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    b = data[lo: lo + n]
    inside = kind[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), first)
    span = np.diff(starts, append=n)
    powers = np.ones(int(span.max()), np.uint64)
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    values = np.where(kind, _BYTE[_LOWER], np.uint64(0))[b[starts[0]:]] * powers[place]
    return Words(mix(np.add.reduceat(values, starts - starts[0])), first)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word; runs over a row's end are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += hashes[j: j + n] * _PLACE[j % 64]
    return mix(total)
