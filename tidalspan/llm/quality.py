"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics.  Each class has the mean of its vectors and their covariance,
shrunk towards its diagonal; both come from sums over all labelled rows, so nothing is sampled.  The score is the
logistic of the difference of the two log densities, each from a Mahalanobis distance by the class's Cholesky factor.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalspan.llm.textbytes import NOT_SPACE, buffers, slices, words

SHRINKAGE, RIDGE, CUT = 0.1, 1e-3, 0.3
FEATURES = ("word_length", "upper", "digits", "punctuation", "marks", "bars", "distinct_words", "same_as_last", "top_word")
#: Every text is taken to begin with so many ordinary words, so that a very short one says little either way.
PRIOR_WORDS, PRIOR_BYTES = 20, 120
_PRIOR = np.array([2.5, 0.5, 3.0, 0.0, 0.0])  # upper, digits, punctuation, marks, bars
_COUNTED = np.zeros((256, 5), np.int8)
_COUNTED[65:91, 0] = 1
_COUNTED[48:58, 1] = 1
for _c in b".,;:'\"-()":
    _COUNTED[_c, 2] = 1
for _c in b"!?#$%&*@^~=+<>\\/_":
    _COUNTED[_c, 3] = 1
for _c in b"|{}[]`":
    _COUNTED[_c, 4] = 1


class Discriminant(NamedTuple):
    means: np.ndarray  # per class
    factors: np.ndarray  # inverse Cholesky factors
    offsets: np.ndarray  # log prior - log determinant / 2


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text; an empty one has those of the ordinary words alone."""
    data, offsets = buffers(texts)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for lo, hi in slices(offsets):
        at = offsets[lo: hi + 1]
        size = np.diff(at).astype(float)
        hashes, first = words(data, at, NOT_SPACE)
        n = np.diff(first).astype(float)
        piece = data[at[0]: at[-1]]
        counts = np.zeros((hi - lo, 5))
        for k in range(5):
            total = np.concatenate([[0], np.cumsum(_COUNTED[:, k][piece], dtype=np.int64)])
            counts[:, k] = np.diff(total[at - at[0]])
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        again = np.zeros(hi - lo)
        if len(hashes) > 1:
            again = np.bincount(row[1:], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), minlength=hi - lo)
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        distinct = np.bincount(r[new], minlength=hi - lo)
        runs = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
        top = np.zeros(hi - lo)
        np.maximum.at(top, r[new], runs)
        many, bytes_ = n + PRIOR_WORDS, size + PRIOR_BYTES
        out[lo:hi] = np.column_stack([np.log(bytes_ / many), np.sqrt((counts + _PRIOR) / bytes_[:, None]), np.log(distinct + PRIOR_WORDS) / np.log(many),
                                      np.sqrt(again / many), np.sqrt((top + 2) / many)])
    return out


def describe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and its ``statistics``: the only thing that is ever moved or kept of it.

    A column of that name is replaced.
    """
    docs = docs.drop("statistics")
    position = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(batch.column(position)).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            columns, names = list(batch.columns), list(batch.schema.names)
            del columns[position], names[position]
            yield pa.RecordBatch.from_arrays([*columns, x], [*names, "statistics"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col] + ["statistics array<double>"])
    return docs.mapInArrow(run, fields)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(batches):
    """Per class the sums of a partition: rows, vectors and products of vectors."""
    wide = len(FEATURES)
    sums = np.zeros((2, 1 + wide + wide * wide))
    for batch in batches:
        x = _vectors(batch.column(1))
        label = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
        for k in (0, 1):
            y = x[label == k]
            sums[k] += np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["label", "sums"])


def is_held_out(id_col: str) -> F.Column:
    """A fifth of the documents, told by the id alone, is kept from the training; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Class means and shrunk covariances of all labelled documents (see ``describe``) that are not held out.

    Labels other than 0 and 1 and rows without an id teach nothing.  A class without rows takes the other's covariance
    at the mean of all zeros, so that scores stay defined.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~is_held_out("id")).distinct()
    rows = known.join(described.select(F.col(id_col).alias("id"), "statistics"), "id").select("label", "statistics")
    sums = rows.mapInArrow(_moments, "label int, sums array<double>").select("label", F.posexplode("sums").alias("i", "x"))
    wide = len(FEATURES)
    total = np.zeros((2, 1 + wide + wide * wide))
    for label, i, x in sums.groupBy("label", "i").agg(F.sum("x")).collect():  # a few hundred numbers
        total[label, i] = x
    means, factors, offsets = [], [], []
    for s in total:
        n = max(s[0], 1)
        mean = s[1: 1 + wide] / n
        cov = s[1 + wide:].reshape(wide, wide) / n - np.outer(mean, mean)
        cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + RIDGE * np.eye(wide)
        low = np.linalg.cholesky(cov)
        means.append(mean), factors.append(np.linalg.inv(low))
        offsets.append(np.log((s[0] + 1) / (total[:, 0].sum() + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def scores(model: Discriminant, x: np.ndarray) -> np.ndarray:
    """Chance of class 1."""
    log = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(*model)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def score_quality(described: DataFrame, model: Discriminant) -> DataFrame:
    """All rows of ``described`` without the statistics, with score and predicted.

    The score is 0 to 1, higher if label 1 is likelier; predicted is 1 if it is 0.3 or more.  A null or empty text is
    scored by the statistics of nothing.  Columns of those names are replaced.  Repeated rows get equal results; an
    empty table stays empty.
    """
    described = described.drop("score", "predicted")
    position, parts = described.columns.index("statistics"), tuple(model)

    def run(batches):
        for batch in batches:
            p = scores(Discriminant(*parts), _vectors(batch.column(position)))
            columns, names = list(batch.columns), list(batch.schema.names)
            del columns[position], names[position]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= CUT).astype(np.int32))], [*names, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in described.schema.fields if f.name != "statistics"]
    return described.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))
