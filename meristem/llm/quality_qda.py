"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A text becomes a short vector of transformed statistics. Each class's mean and covariance come from
summed moments over the labelled rows, at most about FIT_ROWS of them; a class covariance is shrunk towards the pooled one and then
towards a multiple of the identity. The score is the logistic of the log-density difference of the two
classes, from Mahalanobis distances by Cholesky factors that are computed once and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._labels import FIT_ROWS, drawn_labels, labelled_rows
from ._session import extended

#: Byte classes, in the order of their statistics.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t\x0b\x0c\r",
    b"\n",
    b".,;:?'\"()-",
    b"!",
    b"|<>{}[]=\\/",
    b"#$%&*@^~_+",
    bytes(range(0xC0, 0x100)),
)
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c)] = _i
NAMES = (
    "upper", "lower", "digit", "blank", "newline", "stop", "exclamation", "bracket", "symbol", "non_ascii",
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_windows", "words_per_line",
)
WINDOW = 4


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) transformed statistics per text; an empty text's are all 0."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    kind = _CLASS_OF[data]
    document = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(document * 16 + kind, minlength=n * 16).reshape(n, 16)[:, : len(CLASSES)]
    chars = np.bincount(document[(data & 0xC0) != 0x80], minlength=n)
    out[:, : len(CLASSES)] = np.sqrt(counts / np.maximum(chars, 1)[:, None])
    words, first = T.word_hashes(data, offsets)
    n_words = np.diff(first)
    out[:, 10] = np.log1p(chars)
    out[:, 11] = np.log1p(n_words)
    out[:, 12] = np.log1p((chars - counts[:, 3] - counts[:, 4]) / np.maximum(n_words, 1))
    out[:, 15] = np.log1p(n_words / (counts[:, 4] + 1))
    for i in range(n):
        own = words[first[i] : first[i + 1]]
        if len(own):
            out[i, 13] = len(np.unique(own)) / len(own)
            windows = T.shingle_hashes(own, WINDOW)
            out[i, 14] = np.sqrt(1 - len(np.unique(windows)) / len(windows))
    return out


@dataclass(frozen=True)
class Discriminant:
    """For each class: mean, inverse of the Cholesky factor of its covariance, and log-density at the mean plus log prior."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = 0.3, identity: float = 0.01) -> Discriminant:
    """From the classes' row counts, sums and sums of outer products. A class without rows takes the pooled moments; without any row both score 0.5."""
    d = sums.shape[1]
    total = max(counts.sum(), 1)
    mean_all = sums.sum(axis=0) / total
    means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], mean_all)
    scatter = [p - n * np.outer(m, m) for p, n, m in zip(products, counts, means, strict=True)]
    within = sum(scatter) / total
    factors, constants = [], []
    for n, s in zip(counts, scatter, strict=True):
        cov = (1 - pooled) * (s / n if n > d else within) + pooled * within
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(np.log((n + 1) / (total + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def moments(labelled: DataFrame, dims: int = len(NAMES)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and outer products of the statistics of labelled(_n0, _n1, _text) by class. Tasks sum their rows; what reaches the driver has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + dims + dims * dims))
        for batch in batches:
            for row, end, data, offsets in T.text_blocks(batch.column(2)):
                x = statistics(data, offsets)
                for k in (0, 1):
                    n = batch.column(k).to_numpy()[row:end].astype(float)
                    total[k] += np.concatenate(([n.sum()], n @ x, ((x * n[:, None]).T @ x).ravel()))
        k, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int32)), pa.array(place.ravel().astype(np.int32)), pa.array(total.ravel())], names=["k", "place", "v"])

    total = np.zeros((2, 1 + dims + dims * dims))
    for k, place, v in labelled.mapInArrow(run, "k int, place int, v double").groupBy("k", "place").agg(F.sum("v")).collect():
        total[k, place] = v
    return total[:, 0], total[:, 1 : 1 + dims], total[:, 1 + dims :].reshape(2, dims, dims)


def learn_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Discriminant:
    """The discriminant of docs where train holds and labels(doc_id, quality) has a label of 0 or 1.

    At most about fit_rows labelled ids, drawn by hash, are used. A document with several labels counts
    once for each, as does a repeated row. A null id has no label.
    """
    drawn = drawn_labels(labels, "quality", fit_rows)
    return fit(*moments(labelled_rows(docs, drawn, train, id_col, F.col(text_col).cast("string").alias("_text"))))


def score_quality(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, score double, predicted int) for every row; id_col may be of any type, whole rows too."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in T.text_blocks(batch.column(1)):
                s = model.scores(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return rows.mapInArrow(run, extended(rows.drop("_text").schema, "score double, predicted int"))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, score double, predicted int) for every row; labels(doc_id, quality) teach it where train holds.

    Null labels and labels other than 0 and 1 are left out; a document with several labels counts once
    for each. A null text is empty. Repeated rows each get a row, and a null id is scored like any
    other. Rows with equal scores are on the same side of the threshold. Other columns are not read. An
    empty table gives no rows; without labels all score 0.5. A text is held whole by its task, at some
    40 bytes a byte, however long it is.
    """
    return score_quality(docs, learn_quality(docs, labels, train, id_col, text_col), id_col, text_col, threshold)
