"""Hard negatives by bit-sliced integer products.

A component is its bit planes: with B planes under the sign plane, x = -2^B s + sum of 2^p b_p. An
anchor's product with a row is summed plane by plane, the sign and the highest planes first. What the p
planes still to come add is a sum of 2^p - 1 at most times components of the anchor, so it lies between
(2^p - 1) times the sum of its negative ones and the same of its positive ones, and within
|anchor| |rest of the row|, whichever is less. Every plane tightens a pair's score interval, and a pair
is dropped once its interval can't qualify: for positives, when it lies under the k-th best score that
is certain already; for negatives, when it misses every positive's window, or lies under the k-th best
score that is certain in each window that it could be in. What is left after the last plane has its
exact score.

Anchors are sent in blocks of ANCHORS to all rows, which stay where they are; a task returns a few hits
for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut
from .lexical_topk import places_in_runs
from .mtree_topk import integer_vectors

ANCHORS = 8192  # anchors that are sent at a time
ROWS, BESIDE = 1024, 512  # rows and anchors whose pairs are handled together
SPARSE = 16  # pairs are handled one by one where fewer than a SPARSE-th are left
_FAR = np.int64(1) << 62


def planes(rows: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """The number of planes under the sign plane, and all planes (0 and 1, as doubles), the sign plane first."""
    width = max(int(np.max(np.where(rows < 0, ~rows, rows), initial=0)).bit_length(), 1)
    return width, [(rows < 0).astype(float), *(((rows >> p) & 1).astype(float) for p in range(width - 1, -1, -1))]


@dataclass
class Progress:
    """How many pairs there were, and how many were still alive after each plane."""

    pairs: int = 0
    alive: list[int] = field(default_factory=list)

    def note(self, plane: int, n: int) -> None:
        self.alive += [0] * (plane + 1 - len(self.alive))
        self.alive[plane] += n


def products(rows: np.ndarray, anchors: np.ndarray, alive: np.ndarray, drop, progress: Progress | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that stay alive through all planes.

    alive: rows x anchors. drop(row, anchor, low, high) gets the pairs left and their score intervals,
    and says which of them can't qualify any more.
    """
    width, bits = planes(rows)
    wide = anchors.astype(float)
    low_sum, high_sum, norm = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1), np.sqrt((wide**2).sum(1))
    bounded = 4.0 * 2.0**width * np.sqrt(rows.shape[1]) * norm.max(initial=0) < 2.0**62  # else sums may wrap on the way, and only the last one says something
    r, a = np.nonzero(alive)
    score = np.zeros(len(r), np.int64)
    if progress is not None:
        progress.pairs += len(r)
    for i, plane in enumerate(bits):
        if not len(r):
            break
        weight = -(np.int64(1) << np.int64(width)) if i == 0 else np.int64(1) << np.int64(width - i)
        if len(r) * SPARSE < alive.size:
            for k in range(0, len(r), 1 << 16):
                s = slice(k, k + (1 << 16))
                score[s] += weight * np.einsum("ij,ij->i", plane[r[s]], wide[a[s]]).astype(np.int64)  # sums of integers under 2^53: exact
        else:
            score += weight * (plane @ wide.T)[r, a].astype(np.int64)
        left = width - i
        if left and not bounded:
            continue
        most = (np.int64(1) << np.int64(left)) - 1
        rest = np.sqrt(((rows & most).astype(float) ** 2).sum(1)) if left else np.zeros(len(rows))
        round_ = np.ceil(norm[a] * rest[r] * (1 + 1e-9)).astype(np.int64)
        low, high = score + np.maximum(most * low_sum[a], -round_), score + np.minimum(most * high_sum[a], round_)
        keep = ~drop(r, a, low, high)
        r, a, score = r[keep], a[keep], score[keep]
        if progress is not None:
            progress.note(i, len(r))
    return r, a, score


def kth_largest(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """Of each group the k-th largest value; where it has fewer, a number under all."""
    out = np.full(groups, -_FAR)
    order = np.lexsort((-value, group))
    at = order[places_in_runs(group[order]) == k - 1]
    out[group[at]] = value[at]
    return out


class Best:
    """The k best (score, then smaller id) of each group so far. Rows that share an id all count."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.bound = np.full(groups, -_FAR)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        self.group, self.score, self.id = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((self.id, -self.score, self.group))
        place = places_in_runs(self.group[order])
        best = order[place < self.k]
        self.bound[self.group[order[place == self.k - 1]]] = self.score[order[place == self.k - 1]]
        self.group, self.score, self.id = self.group[best], self.score[best], self.id[best]


def certain_bound(best: Best, groups: np.ndarray, a: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a score has to reach in each group: the k-th best so far, or while there are fewer, the k-th of the scores that are certain."""
    bound = best.bound[groups]
    new = bound[a] == -_FAR
    return np.maximum(bound, kth_largest(a[new], low[new], best.k, len(groups))) if new.any() else bound


def _batches(batches: Iterator[pa.RecordBatch], dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(dim, ids, labels, vectors) of at most ROWS rows of the wanted vector lengths."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for dim in np.intersect1d(np.unique(sizes), dims).tolist():
            own = batch.filter(pa.array(sizes == dim))
            for at in range(0, own.num_rows, ROWS):
                part = own.slice(at, ROWS)
                yield dim, part.column(0).to_numpy(), part.column(1), part.column(2).flatten().to_numpy().reshape(-1, dim)


@dataclass
class Block:
    """Anchors of one vector length: places in the whole block, ids, label numbers, vectors; for negatives also each positive's window, by anchor and place."""

    place: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def nearest_of_label(ids: np.ndarray, label: np.ndarray, rows: np.ndarray, block: Block, best: Best, progress: Progress | None = None) -> None:
    """Brings rows of the anchors' labels into best, by anchor."""
    for name in np.unique(label[label >= 0]).tolist():
        mine, theirs = np.flatnonzero(label == name), np.flatnonzero(block.label == name)
        for k in range(0, len(theirs), BESIDE):
            some = theirs[k : k + BESIDE]
            group = block.place[some]

            def drop(r, a, low, high, group=group):
                return high < certain_bound(best, group, a, low)[a]

            r, a, score = products(rows[mine], block.vectors[some], ids[mine][:, None] != block.ids[some][None], drop, progress)
            best.add(group[a], score, ids[mine][r])


def negatives_in_windows(ids: np.ndarray, label: np.ndarray, rows: np.ndarray, block: Block, best: Best, progress: Progress | None = None) -> None:
    """Brings rows of other labels whose score lies in a positive's window into best, by anchor and positive."""
    slots = block.low.shape[1]
    for k in range(0, len(block.ids), BESIDE):
        some = slice(k, k + BESIDE)
        low_of, high_of, place = block.low[some], block.high[some], block.place[some]
        least, most = low_of.min(1), np.where(high_of >= low_of, high_of, -_FAR).max(1)

        def drop(r, a, low, high, low_of=low_of, high_of=high_of, place=place, least=least, most=most):
            out = (high < least[a]) | (low > most[a])
            left = np.flatnonzero(~out)
            useless = np.ones(len(left), bool)
            for j in range(slots):
                la, lo, hi = a[left], low_of[a[left], j], high_of[a[left], j]
                inside = (low[left] >= lo) & (high[left] <= hi)
                certain = certain_bound(best, place * slots + j, la[inside], low[left][inside])
                useless &= (high[left] < np.maximum(lo, certain[la])) | (low[left] > hi)
            out[left[useless]] = True
            return out

        alive = (label[:, None] != block.label[some][None]) & (ids[:, None] != block.ids[some][None]) & (most >= least)[None]
        r, a, score = products(rows, block.vectors[some], alive, drop, progress)
        for j in range(slots):
            fits = (score >= low_of[a, j]) & (score <= high_of[a, j])
            best.add(place[a[fits]] * slots + j, score[fits], ids[r[fits]])


def _searched(rows: DataFrame, anchors: pa.Table, step, groups: int, k: int, windows: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(group, score, vec_id): the k best of each group from each task, by one of the two steps above."""
    size = pc.list_value_length(anchors.column("v").combine_chunks()).to_numpy(zero_copy_only=False)
    names = pc.unique(anchors.column("label").combine_chunks())
    label = pc.index_in(anchors.column("label").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks = {}
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        vectors = anchors.column("v").combine_chunks().take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
        blocks[dim] = Block(at, anchors.column("vec_id").to_numpy()[at], label[at], vectors, *(w[at] for w in windows or ()))
    shared = rows.sparkSession.sparkContext.broadcast((blocks, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, names = shared.value
        best = Best(groups, k)
        for dim, ids, labels, vectors in _batches(batches, np.array(list(blocks))):
            number = pc.fill_null(pc.index_in(labels, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            step(ids, number, vectors, blocks[dim], best)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.group, best.score, best.id)], names=["group", "score", "vec_id"])

    return rows.mapInArrow(run, "group long, score long, vec_id long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's nearest rows of its label, and for each of these the
    first rows of other labels with window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score.

    Scores are integer products of the components' floor(scale * x); higher ones come first, equal ones by
    smaller id. Rows with a null id, label or vector, or a null or non-finite component, take no part, and
    neither do those whose squared norm is over 2**62 after scaling. Only vectors of one length are
    compared. Rows that repeat an id are rows of their own, but none is a partner of an anchor with its
    id; an anchor given twice counts once, with the smaller label and vector. An anchor without
    positives, and a positive without negatives, have no rows; an empty table gives none. Other columns
    are not read.
    """
    spark = table.sparkSession
    kept = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked"), F.col(vector_col).alias("embedding")).where("label is not null")
    rows = cut(integer_vectors(kept, "vec_id", "embedding", scale, "label", "asked").where(F.size("v") > 0))
    asked = cut(rows.where("asked").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v"))
    blocks = max(1, -(-asked.count() // ANCHORS))
    searched = rows.select("vec_id", "label", "v")
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)) == b).toArrow()  # about ANCHORS rows
        if not block.num_rows:
            continue
        near = _ranked(_searched(searched, block, nearest_of_label, block.num_rows, positives), positives).toArrow()  # `positives` rows for each of them
        low, high = np.full((block.num_rows, positives), _FAR), np.full((block.num_rows, positives), -_FAR)
        group, place, score = (near.column(c).to_numpy() for c in ("group", "rank", "score"))
        hundreds, rest = score // 100, score % 100  # as window * score may not fit a long
        low[group, place - 1] = window[0] * hundreds - (-window[0] * rest) // 100
        high[group, place - 1] = window[1] * hundreds + window[1] * rest // 100
        hits = _ranked(_searched(searched, block, negatives_in_windows, block.num_rows * positives, negatives, (low, high)), negatives)
        pairs = pa.table({"group": pa.array(group * positives + place - 1, pa.int64()), "anchor_id": block.column("vec_id").take(pa.array(group)), "positive_id": near.column("vec_id"), "positive_score": near.column("score")})
        out = hits.join(F.broadcast(spark.createDataFrame(pairs)), "group")
        out = cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        found = out if found is None else found.unionByName(out)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if found is None else found
