"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of words with their boundaries. Their log-count ratios come
from document counts over the labelled rows, at most about FIT_ROWS ids drawn by hash. All
features that more than one labelled document has get logistic weights on their scaled values, fitted
on the SAMPLE_ROWS labelled rows with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._labels import FIT_ROWS, drawn_labels, labelled_rows
from ._session import extended

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (4, 5, 6)
SAMPLE_ROWS = 4000
_U = np.uint64


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block and the text that each belongs to. A-Z count as a-z and white space as a boundary; no n-gram spans two words."""
    points, at = T.code_points(data, offsets)
    n = len(at) - 1
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    points[blank] = 32
    # a boundary before each text, and one at the end
    spaced = np.insert(points, at[:-1], 32).astype(_U)
    spaced = np.append(spaced, _U(32))
    shifted = at + np.arange(n + 1)
    owner = np.append(np.repeat(np.arange(n), np.diff(shifted)), max(n - 1, 0))
    space = spaced == 32
    found, owners = [], []
    for k in ORDERS:
        m = len(spaced) - k + 1
        if m <= 0:
            continue
        code = np.full(m, _U(k))
        inner = np.zeros(m, bool)
        for j in range(k):
            code = code * _U(0x9E3779B97F4A7C15) + spaced[j : m + j]
            if 0 < j < k - 1:
                inner |= space[j : m + j]
        code ^= code >> _U(29)
        code *= _U(0xBF58476D1CE4E5B9)
        keep = ~inner & ~(space[:m] & space[k - 1 :])
        found.append((code[keep] >> _U(64 - BITS)).astype(np.int64))
        owners.append(owner[:m][keep])
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def presence(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, by text."""
    pair = np.unique((owner << BITS) | code)
    return pair >> BITS, pair & (BUCKETS - 1)


def log_count_ratio(positive: np.ndarray, negative: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """Of smoothed shares of documents with the feature; 0 for features never seen."""
    p, q = positive[:-1], negative[:-1]
    ratio = np.log((p + alpha) / (positive[-1] + 2 * alpha)) - np.log((q + alpha) / (negative[-1] + 2 * alpha))
    ratio[(p + q) < 2] = 0
    return ratio


def fit_weights(features: list[np.ndarray], counts: np.ndarray, scale: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and an intercept, by accelerated gradient steps on the class-balanced logistic loss.

    features: each row's; counts (rows, 2): how often it is labelled 0 and 1; scale: each feature's. Rows
    have length 1. With rows of one class only, the weights are 0.
    """
    w, bias, total = np.zeros(len(scale)), 0.0, counts.sum(axis=0) if len(counts) else np.zeros(2)
    if not total.all():
        return w, float(np.log((total[1] + 1) / (total[0] + 1))) if total.any() else 0.0
    weight = counts * (0.5 / total)
    size = np.array([len(f) for f in features])
    full = np.flatnonzero(size)
    cols = np.concatenate(features) if len(full) else np.zeros(0, np.int32)
    starts = np.concatenate(([0], np.cumsum(size[full])[:-1])) if len(full) else np.zeros(0, np.int64)
    norm = np.ones(len(features))
    norm[full] = np.sqrt(np.maximum(np.add.reduceat((scale * scale)[cols], starts), 1e-9)) if len(full) else 1
    v, vb, step = w.copy(), bias, 4.0
    for i in range(rounds):
        z = np.full(len(features), vb)
        if len(full):
            z[full] += np.add.reduceat((v * scale)[cols], starts) / norm[full]
        p = 1 / (1 + np.exp(-z))
        g = weight.sum(axis=1) * p - weight[:, 1]
        grad = np.bincount(cols, np.repeat(g[full] / norm[full], size[full]), len(scale)) * scale + l2 * v
        new, new_bias = v - step * grad, vb - step * g.sum()
        v, vb = new + i / (i + 3) * (new - w), new_bias + i / (i + 3) * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def _features(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row, end, data, offsets in T.text_blocks(batch.column(text_at), 1 << 19):
                yield batch.slice(row, end - row), *codes(data, offsets)

    return run


def document_counts(labelled: DataFrame) -> np.ndarray:
    """By class: in how many of labelled(_n0, _n1, _text) each bucket occurs, and their number at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1))
        for part, code, owner in _features(2)(batches):
            owner, code = presence(code, owner)
            for k in (0, 1):
                n = part.column(k).to_numpy()
                total[k, :-1] += np.bincount(code, n[owner], BUCKETS)
                total[k, -1] += n.sum()
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at].astype(np.int64)), pa.array(total[1, at].astype(np.int64))], names=["bucket", "n0", "n1"])

    found = labelled.mapInArrow(run, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # BUCKETS + 1 rows at most
    total = np.zeros((2, BUCKETS + 1))
    total[:, found["bucket"].to_numpy(int)] = found[["n0", "n1"]].to_numpy().T
    return total


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, score double, predicted int) for every row; labels(doc_id, toxic) teach it where train holds.

    Null labels and labels other than 0 and 1 are left out; a document with several labels counts once
    for each. Null and empty texts get the score of a text without features, and a null id is scored
    like any other and teaches nothing. Repeated rows each get a row. Of labelled rows with the same
    hash the smaller id goes first into the sample. Other columns are not read. An empty table gives no
    rows. A text is held whole by its task, at some 150 bytes a byte, however long it is.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    drawn = drawn_labels(labels, "toxic", fit_rows).persist()  # at most about fit_rows rows
    total = document_counts(labelled_rows(rows, drawn, train, id_col, F.col("_text")))
    ratio = log_count_ratio(total[1], total[0])
    strong = np.flatnonzero(ratio)
    index = np.full(BUCKETS, -1, np.int32)
    index[strong] = np.arange(len(strong))
    scale = ratio[strong]

    # drawn before the texts are read: rows enough for the sample, and few more
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    few = drawn.where(draw < int(min(1.0, 1.5 * SAMPLE_ROWS / max(1, total[:, -1].sum())) * (1 << 30)))
    some = labelled_rows(rows, few, train, id_col, F.col(id_col).alias("_doc"), F.col("_text"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, owner in _features(3)(batches):
            at = index[code]
            owner, code = presence(at[at >= 0].astype(np.int64), owner[at >= 0])
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(bounds), pa.array(code.astype(np.int32)))], names=["n0", "n1", "id", "f"])

    kind = rows.schema[0].dataType.simpleString()
    sample = some.mapInArrow(chosen, f"n0 long, n1 long, id {kind}, f array<int>").orderBy(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)), "id", "n0", "f").limit(SAMPLE_ROWS).select("n0", "n1", "f").toArrow()  # SAMPLE_ROWS rows, of BUCKETS numbers each at most
    features = [f.values.to_numpy() for f in sample.column("f")]
    weights, bias = fit_weights(features, np.stack([sample.column(c).to_numpy() for c in ("n0", "n1")], axis=1).astype(float), scale)
    drawn.unpersist()
    linear, square = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    linear[strong], square[strong] = weights * scale, scale * scale
    model = docs.sparkSession.sparkContext.broadcast((np.stack([linear, square]), bias))  # 2 * BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (linear, square), intercept = model.value
        for part, code, owner in _features(1)(batches):
            live = square[code] > 0
            owner, code = presence(code[live], owner[live])
            n = part.num_rows
            z = np.bincount(owner, linear[code], n) / np.sqrt(np.maximum(np.bincount(owner, square[code], n), 1e-9)) + intercept
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return rows.mapInArrow(score, extended(rows.drop("_text").schema, "score double, predicted int"))
