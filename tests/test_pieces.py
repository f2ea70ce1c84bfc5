"""Work in one order over pieces, counting of inversions and silhouettes, against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem.operators import concordance as C
from meristem.operators import learning as M
from meristem.operators import pieces as P
from meristem.operators import relational as R
from meristem.operators import signals as S
from meristem.operators.silhouettes import _distances, silhouette


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def plain(rows, step, first, out):
    found, state, key = [], None, object()
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1], r[2] is not None, r[2] or 0)):
        if k != key:
            key, state = k, None
        if v is not None:
            state = first(v) if state is None else step(state, v)
        found.append((k, i, v, None if state is None else out(state)))
    return found


FILTERS = {
    "ema": (S.exponential_average, lambda s, v: 0.2 * v + 0.8 * s, lambda v: v, lambda s: s),
    "holt": (S.holt, lambda s, v: (lambda n: (n, 0.1 * (n - s[0]) + 0.9 * s[1]))(0.3 * v + 0.7 * (s[0] + s[1])), lambda v: (v, 0.0), lambda s: s[0]),
}


@pytest.mark.parametrize("name", list(FILTERS))
def test_a_stream_over_many_pieces_is_filtered_as_one(spark, many, monkeypatch, name):
    monkeypatch.setattr(P, "BLOCK", 16)
    rng = np.random.default_rng(1)
    f, step, first, out = FILTERS[name]
    rows = [("long", i, None if i < 120 or rng.random() < 0.1 else float(rng.normal())) for i in range(900)]
    rows += [(k, i, float(rng.normal())) for k in ("a", "z", None) for i in range(5)] + [("none", 1, None), ("twice", 1, 2.0), ("twice", 1, 2.0)]
    got = f(spark.createDataFrame(rows, "k string, i long, v double").repartition(3), "v", "i", ["k"])
    assert got.rdd.getNumPartitions() == 7
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    got, want = sorted(((r["k"], r["i"], r["v"], r["filtered"]) for r in got.collect()), key=key), sorted(plain(rows, step, first, out), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all((g[3] is None) == (w[3] is None) and (g[3] is None or abs(g[3] - w[3]) < 1e-9) for g, w in zip(got, want, strict=True))
    assert f(spark.createDataFrame([], "k string, i long, v double"), "v", "i", ["k"]).count() == 0


@pytest.mark.parametrize("strategy", ["ffill", "bfill"])
def test_missing_values_are_filled_over_pieces(spark, many, strategy):
    rng = np.random.default_rng(2)
    rows = [(i, None if rng.random() < 0.7 or 200 < i < 420 else float(i), None if i > 30 else f"s{i}") for i in range(500)]
    got = {r["i"]: (r["v"], r["s"]) for r in R.fill_missing(spark.createDataFrame(rows, "i long, v double, s string").repartition(4), strategy, columns=["v", "s"], order=["i"]).collect()}
    last, want = (None, None), {}
    for i, v, s in rows if strategy == "ffill" else rows[::-1]:
        last = (v if v is not None else last[0], s if s is not None else last[1])
        want[i] = last
    assert got == want


def test_rows_are_numbered_over_pieces(spark, many):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert all(r["k"] == r["n"] for r in P.numbered(df, [F.col("k")], "n").collect())


def plain_tau(x, y):
    s = nx = ny = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[j] - x[i]), np.sign(y[j] - y[i])
        s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
    return s / np.sqrt(float(nx) * float(ny)) if nx and ny else None


def test_concordance_inside_a_range():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 60):
        key, y, w = rng.integers(0, 9, n), rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
        want = sum(int(np.sign(y[j] - y[i])) * int(w[i] * w[j]) for i in range(n) for j in range(n) if key[i] < key[j])
        assert C.concordance(key, y, w) == want


@pytest.mark.parametrize("values", [4, 60, 1000])
def test_kendall_over_ranges_is_that_of_all_pairs(spark, monkeypatch, values):
    monkeypatch.setattr(C, "PIECE", 25)
    rng = np.random.default_rng(4)
    x = rng.integers(0, values, 300)
    y = (x + rng.integers(0, values, 300)) // 2
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y, strict=True)], "a double, b double, c double").repartition(3)
    assert C.kendall(df, "a", "b") == pytest.approx(plain_tau(x, y), abs=1e-12)
    got = {(r["a"], r["b"]): r["r"] for r in R.correlation(df, ["a", "b", "c"], "kendall").collect()}
    assert got[("a", "c")] is None and got[("a", "b")] == round(plain_tau(x, y), 4)


def test_silhouettes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) + np.repeat([[0, 0], [3, 1], [9, 9]], 20, axis=0)
    c = np.repeat(["a", "b", "c"], 20)
    c[59] = "alone"
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(60):
        own = (c == c[i]) & (np.arange(60) != i)
        if own.any():
            a, b = far[i][own].mean(), min(far[i][c == o].mean() for o in set(c) - {c[i]})
            want.append((b - a) / max(a, b))
        else:
            want.append(0.0)
    monkeypatch.setattr("meristem.operators.silhouettes.BLOCK", 16)
    df = spark.createDataFrame([(float(p), float(q), str(k)) for (p, q), k in zip(x, c, strict=True)] + [(None, 1.0, "a"), (1.0, 1.0, None)], "p double, q double, k string")
    assert silhouette(df, ["p", "q"], "k").first()["silhouette"] == pytest.approx(np.mean(want), abs=1e-9)
    assert silhouette(df.limit(0), ["p", "q"], "k").first()["silhouette"] == 0.0
    curve = [r["inertia"] for r in M.elbow(df.na.drop(), ["p", "q"], 4, False).orderBy("k").collect()]
    assert curve[0] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and curve == sorted(curve, reverse=True)


def test_distances_of_copies_far_off_are_zero():
    x = np.random.default_rng(9).normal(size=(20, 3)) + 1e5
    d = _distances(x, np.concatenate([x, x + 2]))
    plain = np.sqrt(((x[:, None] - np.concatenate([x, x + 2])[None]) ** 2).sum(2))
    assert (np.diag(d) == 0).all() and np.abs(d - plain).max() < 1e-9


def test_silhouettes_measure_a_pair_once(spark, monkeypatch):
    """Blocks meet once and not from both sides, and a row moves once for each block; clusters of one tile are many, or larger than a block."""
    monkeypatch.setattr("meristem.operators.silhouettes.BLOCK", 64)
    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(300, 3)), np.where(np.arange(300) < 160, 0, rng.integers(1, 50, 300))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(300):
        own = (c == c[i]) & (np.arange(300) != i)
        a, b = far[i][own].mean() if own.any() else 0, min(far[i][c == o].mean() for o in set(c) - {c[i]})
        want.append((b - a) / max(a, b) if own.any() else 0)
    df = spark.createDataFrame([(*map(float, p), str(k)) for p, k in zip(x, c, strict=True)], "p double, q double, r double, k string").repartition(3)
    out = silhouette(df, ["p", "q", "r"], "k")
    assert out.first()["silhouette"] == pytest.approx(np.mean(want), abs=1e-9) and out.first()["n"] == 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ", 36), REPARTITION" in plan and "CoGroup" not in plan
