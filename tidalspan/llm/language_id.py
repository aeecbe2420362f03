"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of some labelled text.  A text is cut, from left to right, into the longest phrases
that the automaton of a language contains; the language that needs the fewest phrases per letter wins.  Texts are
lower-cased, and whatever is not a letter becomes one space.

The automata are dense transition tables, and a task walks them for many texts and all languages at once, one numpy
step per letter.  Long texts are walked in segments of ``SEGMENT`` letters, which costs every language at most one
phrase per segment; all of every text is read.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.workers import lean

SEGMENT, SLICE = 1024, 1 << 21
#: Bound of the sample that the automata are made of: documents per language, and letters of one piece of each.
SAMPLE_DOCS, SAMPLE_LETTERS = 100, 300
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    letters: str  # symbol i + 1 is letters[i]; 0 is a space; len + 1 any other letter
    table: np.ndarray  # row offset of the next state at [state row + symbol]; negative if a phrase begins with the symbol
    starts: np.ndarray  # row offsets
    log_size: float


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(to)
        to.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(to)
                to.append(dict(to[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return to


def fold(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def build(texts: dict[str, list[str]]) -> Model:
    """Automata of some texts per language; only letters count."""
    folded = {k: " ".join(" ".join(fold(t).split()) for t in sorted(v)) for k, v in sorted(texts.items())}
    folded = {k: v for k, v in folded.items() if v.strip()}
    letters = "".join(sorted({c for v in folded.values() for c in v} - {" "}))
    symbol = {" ": 0} | {c: i + 1 for i, c in enumerate(letters)}
    wide, at, tables, starts = len(letters) + 2, 0, [], []
    for text in folded.values():
        to = automaton([symbol[c] for c in text])
        rows = np.full((len(to) + 1, wide), -1, np.int64)  # the last: nothing of a phrase yet
        for i, d in enumerate(to):
            for c, j in d.items():
                rows[i, c] = at + j * wide
        start = at + len(to) * wide
        again = np.where(rows[0] >= 0, rows[0], start)  # a new phrase begins here; a letter never seen is one by itself
        rows = np.where(rows >= 0, rows + 1, -(again[None, :] + 1))  # one more, for a sign at 0 too
        tables.append(rows)
        starts.append(start)
        at += rows.size
    table = np.concatenate([t.ravel() for t in tables]).astype(np.int32) if tables else np.zeros(0, np.int32)
    return Model(list(folded), letters, table, np.array(starts, np.int32), math.log(max([2, *map(len, folded.values())])))


class Folding:
    """Code points to symbols."""

    def __init__(self, letters: str):
        self.symbol = np.full(0x110000, 0, np.uint16)
        self.symbol[[i for i in range(0x110000) if chr(i).isalpha()]] = len(letters) + 1
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = i + 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, spaces squeezed, and where each text begins."""
        lower = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), np.uint32)
        symbols = self.symbol[codes]
        keep = (symbols != 0) | np.concatenate([[False], symbols[:-1] != 0])
        ends = np.cumsum([len(t) + 1 for t in lower])
        left = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], np.concatenate([[0], left[ends]])


def phrases(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrases that each text (rows) needs in each language (columns)."""
    lengths = np.diff(first)
    parts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    langs = len(model.starts)
    state = np.repeat(model.starts[:, None], len(size), axis=1)
    missed = np.zeros((langs, len(size)), np.int32)
    padded = np.concatenate([symbols, np.zeros(1, symbols.dtype)]).astype(np.int32)
    live = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), "right")
    for t in range(int(size.max()) if len(size) else 0):
        n = live[t]
        now = state[:, :n]
        now += padded[start[:n] + t]
        got = model.table.take(now)
        missed[:, :n] += got < 0
        np.abs(got, out=got)
        got -= 1
        state[:, :n] = got
    total = np.zeros((len(lengths), langs))
    for k in range(langs):
        total[:, k] = np.bincount(owner, missed[k], minlength=len(lengths))
    return total


def _predict(shared, position: int):
    def run(batches):
        model = Model(*shared.value)
        folding = Folding(model.letters)
        for batch in batches:
            texts = [t or "" for t in batch.column(position).to_pylist()]
            names, scores, at = [], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
                    size += len(texts[to])
                    to += 1
                symbols, first = folding(texts[at:to])
                has = np.add.reduceat(np.concatenate([symbols != 0, [False]]), first[:-1].clip(0, len(symbols))) * (np.diff(first) > 0)
                count = phrases(model, symbols, first)
                for n, c in zip(has, count):
                    if not n or not len(c):
                        names.append(UNKNOWN), scores.append(0.0)
                        continue
                    best = int(c.argmin())
                    names.append(model.languages[best])
                    scores.append(float(1 / np.exp((c[best] - c) * model.log_size).sum()))
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])
    return run


def is_held_out(id_col: str) -> F.Column:
    """A quarter of the documents, told by the id alone, is kept from the training; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> Model:
    """Automata from a piece of at most ``sample_docs`` labelled documents per language that are not held out.

    The sample is drawn by the hash of the id over all documents.  A piece is ``sample_letters`` long, not counting what
    is no letter but one space between words, and begins anywhere in its text, also by the hash of the id.  Rows without
    id, label or any letter teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out("id"))
    draw, place = (F.shiftrightunsigned(F.xxhash64("id", F.lit(i)), 33) / float(1 << 31) for i in (5, 6))
    share = {r.lang: 3 * sample_docs / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not share:
        return build({})
    limit = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    words = F.trim(F.regexp_replace(F.lower("text"), r"\P{L}+", " "))
    drawn = rows.where(draw < limit).select("lang", draw.alias("draw"), "id", words.alias("words")).where("words != ''")
    begin = F.floor(place * (F.greatest(F.length("words") - sample_letters, F.lit(0)) + 1)).cast("int") + 1
    drawn = drawn.select("lang", "draw", "id", F.substring("words", begin, F.lit(sample_letters)).alias("text"))
    taken = drawn.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "id", "text"))), 1, sample_docs).alias("rows"))
    return build({r.lang: [x.text for x in r.rows] for r in taken.collect()})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (0 to 1, the chance among the languages at equal odds).

    ``und`` with score 0 stands for a text that is null, empty or has no letter, and for any text if nothing was
    learned.  Ties go to the first language by name.  Columns of ``docs`` of those names are replaced.  Repeated rows
    get equal results; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # its size follows the sample's bound and the languages
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["lang_pred string", "score double"])
    return docs.mapInArrow(lean(_predict(shared, docs.columns.index(text_col))), fields)
