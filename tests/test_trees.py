"""Exact trees against a plain recursive one, and forests by their out-of-bag score."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meristem.operators import learning as M
from meristem.operators import trees as T


def plain_impurity(counts, criterion):
    n = sum(counts)
    p = [c / n for c in counts if c]
    return 1 - sum(x * x for x in p) if criterion == "gini" else -sum(x * math.log2(x) for x in p)


def plain_tree(x, y, k, criterion, depth, least, node=1):
    """{node: (feature, threshold) or class}"""
    counts = [int((y == c).sum()) for c in range(k)]
    top = int(np.argmax(counts))
    here = plain_impurity(counts, criterion)
    best = None
    if depth and here > 0 and len(y) >= 2:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for a, b in zip(values, values[1:]):
                left = x[:, j] <= a
                if b - a <= 1e-7 or min(left.sum(), (~left).sum()) < least:
                    continue
                sides = [[int((y[s] == c).sum()) for c in range(k)] for s in (left, ~left)]
                drop = round(here - sum(sum(s) / len(y) * plain_impurity(s, criterion) for s in sides), 11)
                if drop > 0 and (best is None or drop > best[0]):
                    best = (drop, j, (a + b) / 2)
    if best is None:
        return {node: top}
    _, j, t = best
    left = x[:, j] <= t
    return {node: (j, t)} | plain_tree(x[left], y[left], k, criterion, depth - 1, least, 2 * node) | plain_tree(x[~left], y[~left], k, criterion, depth - 1, least, 2 * node + 1)


@pytest.mark.parametrize(("criterion", "least"), [("gini", 1), ("entropy", 4)])
def test_trees_are_the_plain_ones(spark, criterion, least):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = ((x[:, 0] + x[:, 1] ** 2 > 0.6).astype(int) + (rng.random(160) < 0.2)) % 3
    rows = spark.createDataFrame([(0, 1, int(c), [float(v) for v in r]) for r, c in zip(x, y, strict=True)], "tree int, w int, y int, f array<double>").repartition(5)
    got = {r["node"]: (r["feature"], r["threshold"]) if r["feature"] is not None else r["prediction"] for r in T.grow(rows, 3, 3, 3, criterion, 4, min_leaf=least).collect()}
    want = plain_tree(x, y, 3, criterion, 4, least)
    assert set(got) == set(want)
    assert all(got[n] == w if isinstance(w, int) else got[n][0] == w[0] and abs(got[n][1] - w[1]) < 1e-12 for n, w in want.items())


def test_tree_predictions_and_importances(spark):
    rows = [(i, float(i % 10), float(i // 10), "a" if i % 10 < 5 else "b" if i // 10 < 5 else "c") for i in range(100)]
    df = spark.createDataFrame([*rows, (200, None, 1.0, "a"), (201, 1.0, 1.0, None)], "id long, x double, z double, y string")
    out, weights = M.decision_tree(df, df, ["x", "z"], "y")
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert all(got[r[0]] == r[3] for r in rows) and len(got) == 102
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights["x"] > weights["z"] > 0


def test_forests_have_an_out_of_bag_score(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] + x[:, 1] > 0, "up", "down")
    df = spark.createDataFrame([(i, *map(float, r), str(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y string")
    out, weights, score = M.random_forest(df, df, ["a", "b", "c", "d"], "y", 8, 4)
    right = np.mean([r["prediction"] == r["y"] for r in out.collect()])
    assert right > 0.9 and 0.75 < score <= right and weights["a"] + weights["b"] > 0.7
    noise = M.random_forest(df.withColumn("y", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "u").otherwise("v")), df, ["a", "b", "c", "d"], "y", 8, 4)
    assert noise[2] < 0.65
    counts = spark.range(20000).select(T.poisson(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20000 for r in counts}
    assert all(abs(share.get(k, 0) - math.exp(-1) / math.factorial(k)) < 0.015 for k in range(6))


def test_pieces_of_few_rows_give_the_same_tree(spark, monkeypatch):
    """A piece ends between two values, however often the last one comes."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(200, 3)), 1)
    x[:, 2] = 1.0  # one value
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (rng.random(200) < 0.2)
    rows = spark.createDataFrame([(0, 1, int(c), [float(v) for v in r]) for r, c in zip(x, y, strict=True)], "tree int, w int, y int, f array<double>").repartition(3)
    monkeypatch.setattr(T, "PIECE", 7)
    got = {r["node"]: (r["feature"], r["threshold"]) if r["feature"] is not None else r["prediction"] for r in T.grow(rows, 3, 3, 3, "gini", 3).collect()}
    want = plain_tree(x, y, 3, "gini", 3, 1)
    assert {n: w if isinstance(w, int) else (w[0], round(w[1], 9)) for n, w in want.items()} == {n: g if isinstance(g, int) else (g[0], round(g[1], 9)) for n, g in got.items()}
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0], pa.int32()), pa.array([1, 1, 1]), pa.array([2, 3, 4]), pa.array([1, 1, 0], pa.int32()), pa.array([[-0.0, 5.0], [0.0, 6.0], [0.0, 5.0]])], names=["tree", "node", "w", "y", "f"])
    counted = [tuple(r.values()) for b in T._counted(iter([batch])) for r in b.to_pylist()]
    assert sorted(counted) == [(0, 1, 0, 0.0, 0, 4), (0, 1, 0, 0.0, 1, 5), (0, 1, 1, 5.0, 0, 4), (0, 1, 1, 5.0, 1, 2), (0, 1, 1, 6.0, 1, 3)]
