"""Exact classification trees and forests, grown level by level.

At each level the class counts of every (tree, node, feature, value) are summed by task; the values are
dealt into range-sorted pieces of arrays, and prefix sums over the pieces and inside them give both sides
of every possible split. All nodes of a level, of all trees, are split in the same pass. Thresholds are the
midpoints between neighbouring values, and a node takes the split that lowers its impurity most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

GAP = 1e-7  # values that are nearer to each other are not split
NODE = ["tree", "node"]
PIECE = 1 << 17  # rows of a piece


def impurity(counts: list[Column], criterion: str) -> Column:
    n = sum(counts[1:], counts[0])
    parts = [F.try_divide(c, n) for c in counts]
    if criterion == "gini":
        return 1 - sum((p * p for p in parts), F.lit(0.0))
    return sum((F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0)) for p in parts), F.lit(0.0))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) if len(columns[0]) else np.zeros(0, bool)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, node, feature, value, y, w) of batches of rows: the weights of a batch's equal values and classes, summed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, node, y, w = (batch.column(c).to_numpy() for c in ("tree", "node", "y", "w"))
        f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + 0.0  # no -0.0
        kinds, code = np.unique(np.stack([tree, node, y], 1).astype(np.int64), axis=0, return_inverse=True)
        code = code.ravel()
        allowed = None
        if "_some" in batch.schema.names:
            some = batch.column("_some")
            allowed = np.zeros(f.shape, bool)
            allowed[np.repeat(np.arange(batch.num_rows), some.value_lengths().to_numpy()), some.flatten().to_numpy()] = True
        for j in range(f.shape[1]):
            rows = np.arange(len(f)) if allowed is None else np.flatnonzero(allowed[:, j])
            if not len(rows):
                continue
            rows = rows[np.lexsort((code[rows], f[rows, j]))]
            first = np.flatnonzero(_changes(f[rows, j], code[rows]))
            kind = kinds[code[rows[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(kind[:, 0].astype(np.int32)), pa.array(kind[:, 1]), pa.array(np.full(len(first), j, np.int32)), pa.array(f[rows[first], j]), pa.array(kind[:, 2].astype(np.int32)), pa.array(np.add.reduceat(w[rows].astype(np.int64), first))], names=["tree", "node", "feature", "value", "y", "w"])


def _packed(classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of _counted as pieces: a row for each run of a node's feature, of about PIECE rows at most, with its first value, its class counts and its rows as arrays. Equal values lie in one piece."""

    def packed(t: pa.Table) -> pa.RecordBatch:
        tree, node, feature, value, y, w = (t.column(c).to_numpy() for c in ("tree", "node", "feature", "value", "y", "w"))
        first = np.flatnonzero(_changes(tree, node, feature))
        sums = np.zeros((len(first), classes), np.int64)
        np.add.at(sums, (np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w)))), y), w)
        ends = pa.array(np.append(first, len(w)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (value, y, w)]
        return pa.RecordBatch.from_arrays([pa.array(tree[first]), pa.array(node[first]), pa.array(feature[first]), pa.array(value[first]), *[pa.array(c) for c in sums.T.copy()], *arrays], names=[*NODE, "feature", "first", *[f"c{k}" for k in range(classes)], "v", "y", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PIECE:
                t = pa.Table.from_batches(held)
                new = np.flatnonzero(_changes(*[t.column(c).to_numpy() for c in (*NODE, "feature", "value")]))
                if new[-1]:
                    yield packed(t.slice(0, int(new[-1])))
                    t = t.slice(int(new[-1]))
                held = t.to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held))

    return run


def _best(classes: int, criterion: str, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best split of each piece, by the counts before it (o0..) and of its node (t0..)."""

    def impure(counts: np.ndarray) -> np.ndarray:
        n, out = counts.sum(1), np.zeros(len(counts))
        for c in counts.T:
            p = c / np.maximum(n, 1)
            out += p * p if criterion == "gini" else np.where(p > 0, -p * np.log2(np.where(p > 0, p, 1)), 0)
        return 1 - out if criterion == "gini" else out

    def split(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column("v")
        length = lists.value_lengths().to_numpy()
        run = np.repeat(np.arange(part.num_rows), length)
        value, y, w = lists.flatten().to_numpy(), part.column("y").flatten().to_numpy(), part.column("w").flatten().to_numpy()
        cells = np.zeros((len(value) + 1, classes), np.int64)
        cells[np.arange(1, len(value) + 1), y] = w
        upto = np.cumsum(cells, axis=0)
        before, whole = (np.stack([part.column(f"{s}{k}").to_numpy() for k in range(classes)], 1) for s in ("o", "t"))
        last = np.flatnonzero(np.append(_changes(run, value)[1:], True))
        r = run[last]
        left = upto[last + 1] - upto[(np.cumsum(length) - length)[r]] + before[r]
        right = whole[r] - left
        beyond = part.column("beyond").to_numpy(zero_copy_only=False).astype(float)  # nan: no value follows
        after = np.append(value, np.nan)[last + 1]
        after = np.where(np.append(r[1:] != r[:-1], True), beyond[r], after)
        n, n_left, n_right = whole[r].sum(1), left.sum(1), right.sum(1)
        drop = np.round(part.column("impurity").to_numpy()[r] - n_left / n * impure(left) - n_right / n * impure(right), 11)
        at = np.flatnonzero((after - value[last] > GAP) & (n_left >= least) & (n_right >= least) & (drop > 0))
        threshold = (value[last[at]] + after[at]) / 2
        at_first = np.lexsort((threshold, -drop[at], r[at]))
        at_first = at_first[_changes(r[at][at_first])]
        own = pa.array(r[at][at_first])
        return pa.RecordBatch.from_arrays([*[part.column(c).take(own) for c in (*NODE, "feature")], pa.array(threshold[at_first]), pa.array(drop[at][at_first])], names=[*NODE, "feature", "threshold", "decrease"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(batch.column("v").value_lengths().to_numpy())
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE, side="right")))
                yield split(batch.slice(a, b - a))
                a = b

    return run


def _splits(scratch: Scratch, rows: DataFrame, nodes: DataFrame, classes: int, features: int, tried: int, criterion: str, least: int, seed: int) -> DataFrame:
    """(tree, node, feature, threshold, decrease): the best split of each node that has one."""
    names = [f"c{k}" for k in range(classes)]
    key = [*NODE, "feature"]
    some = []
    if tried < features:
        drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda j: F.struct(F.xxhash64("tree", "node", j, F.lit(seed)).alias("h"), j.alias("j"))))
        some = [F.transform(F.slice(drawn, 1, tried), lambda s: s["j"]).alias("_some")]
    asked = rows.join(nodes.select(*NODE, *some), NODE).select(*NODE, F.col("w").cast("long").alias("w"), F.col("y").cast("int").alias("y"), "f", *(["_some"] if some else []))
    counts = asked.mapInArrow(_counted, "tree int, node long, feature int, value double, y int, w long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_counts = counts.repartitionByRange(parts, *key, "value").sortWithinPartitions(*key, "value")
    pieces = scratch.put("pieces", sorted_counts.mapInArrow(_packed(classes), f"tree int, node long, feature int, first double, {', '.join(f'{c} long' for c in names)}, v array<double>, y array<int>, w array<long>"))
    across = Window.partitionBy(*key).orderBy("first")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.select(*key, "first", F.lead("first").over(across).alias("beyond"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o{i}") for i, c in enumerate(names)])
    sums = sums.join(nodes.select(*NODE, "impurity", *[F.col(c).alias(f"t{i}") for i, c in enumerate(names)]), NODE)
    good = pieces.select(*key, "first", "v", "y", "w").join(sums, [*key, "first"]).mapInArrow(_best(classes, criterion, least), "tree int, node long, feature int, threshold double, decrease double")
    best = good.groupBy(*NODE).agg(F.max_by(F.struct("feature", "threshold", "decrease"), F.struct("decrease", -F.col("feature"), -F.col("threshold"))).alias("s"))
    return best.select(*NODE, "s.*")


def grow(rows: DataFrame, classes: int, features: int, tried: int, criterion: str = "gini", max_depth: int = 5, min_split: int = 2, min_leaf: int = 1, seed: int = 42) -> DataFrame:
    """(tree, node, n, prediction, c0.., feature, threshold, decrease) of rows(tree, w, y, f): node 1 is the root, 2i and 2i + 1 are i's sides (value <= threshold goes left); leaves have no feature.

    y is the class's number, w a whole weight; tried features of each node are drawn by hash. Of equally
    good splits the smaller feature and threshold is taken, of equally frequent classes the smaller one.
    """
    scratch = Scratch(rows.sparkSession)
    names = [f"c{k}" for k in range(classes)]
    live = scratch.put("rows", rows.select("tree", F.lit(1).cast("long").alias("node"), "w", "y", "f").where("w > 0"))
    done = None
    for depth in range(min(max_depth, 60) + 1):
        sums = live.groupBy(*NODE).agg(*[F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0)).alias(c) for k, c in enumerate(names)])
        counts = [F.col(c) for c in names]
        n = sum(counts[1:], counts[0])
        most = F.array_max(F.array(*[F.struct(c.alias("c"), F.lit(-k).alias("k")) for k, c in enumerate(counts)]))
        nodes = scratch.put("nodes", sums.select(*NODE, *names, n.alias("n"), impurity(counts, criterion).alias("impurity"), (-most["k"]).alias("prediction")))
        parts = nodes.where((F.col("impurity") > 0) & (F.col("n") >= max(2, min_split))) if depth < max_depth else nodes.limit(0)
        best = scratch.put("splits", _splits(scratch, live, parts, classes, features, tried, criterion, min_leaf, seed))
        level = nodes.join(best, NODE, "left").drop("impurity")
        done = scratch.put("done", level if done is None else done.unionByName(level))
        if best.isEmpty():
            break
        side = F.when(F.get("f", F.col("feature")) <= F.col("threshold"), 0).otherwise(1)
        live = scratch.put("rows", live.join(best.drop("decrease"), NODE).select("tree", (2 * F.col("node") + side).alias("node"), "w", "y", "f"))
        scratch.drop_older("rows", "done", "nodes", "pieces", "splits")
    return done


def leaves_of(rows: DataFrame, trees: DataFrame, max_depth: int) -> DataFrame:
    """rows(tree, f, ...) with the columns of their leaves: a join a level, by which the rows that are not at a leaf yet go down."""
    kept = [c for c in rows.columns if c not in ("tree", "node")]
    live = rows.withColumn("node", F.lit(1).cast("long"))
    steps = trees.select(*NODE, "feature", "threshold")
    for _ in range(max_depth):
        side = F.when(F.get("f", F.col("feature")) <= F.col("threshold"), 0).otherwise(1)
        live = live.join(steps, NODE, "left").select("tree", *kept, F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + side).alias("node"))
    return live.join(trees.drop("feature", "threshold", "decrease"), NODE)


def importances(trees: DataFrame, features: list[str]) -> dict[str, float]:
    """Each feature's share of its tree's decreases, weighted by rows, as a mean over trees."""
    by = trees.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("n") * F.col("decrease")).alias("s"))
    share = by.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy("tree")))
    found = {r["feature"]: r["s"] for r in share.groupBy("feature").agg(F.sum("share").alias("s")).collect()}  # a row for each feature
    count = max(1, trees.select("tree").distinct().count())
    return {f: found.get(j, 0.0) / count for j, f in enumerate(features)}


def poisson(u: Column) -> Column:
    """A whole number with mean 1, by a uniform one: how often a row is in a bag."""
    out, upto, p = F.lit(8), 1.0, math.exp(-1)
    sums, total = [], 0.0
    for k in range(8):
        total += p
        sums.append((k, total))
        p /= k + 1
    for k, upto in reversed(sums):
        out = F.when(u < upto, F.lit(k)).otherwise(out)
    return out
