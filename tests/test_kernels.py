"""Kernel machines: optimal in one block, near it over a cascade."""

import numpy as np
import pytest

from meristem.operators import kernels as K
from meristem.operators import learning as M

SHAPES = [("linear", 1.0, 3, 0.0), ("rbf", 0.7, 3, 0.0), ("poly", 0.5, 2, 1.0), ("sigmoid", 0.1, 3, 0.0)]


def plain_kernel(shape, a, b):
    dot = sum(p * q for p, q in zip(a, b, strict=True))
    name, gamma, degree, coef0 = shape
    return {"linear": dot, "rbf": np.exp(-gamma * sum((p - q) ** 2 for p, q in zip(a, b, strict=True))), "poly": (gamma * dot + coef0) ** degree, "sigmoid": np.tanh(gamma * dot + coef0)}[name]


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, np.where((x**2).sum(1) + rng.normal(0, 0.3, n) > 1.4, 1.0, -1.0)


@pytest.mark.parametrize("shape", SHAPES)
def test_solutions_are_optimal(shape):
    """The conditions that only a solution of the dual problem meets, from kernels by hand."""
    x, y = data(60)
    c = 2.0
    alpha, rho = K.solve(x, y, c, shape, 1e-6)
    gram = np.array([[plain_kernel(shape, a, b) for b in x] for a in x])
    assert abs(alpha @ y) < 1e-9 and (alpha >= 0).all() and (alpha <= c).all()
    margin = y * (gram @ (alpha * y) - rho)
    assert (margin[alpha < 1e-12] > 1 - 1e-4).all() and (margin[alpha > c - 1e-12] < 1 + 1e-4).all()
    assert np.abs(margin[(alpha > 1e-9) & (alpha < c - 1e-9)] - 1).max(initial=0) < 1e-4
    if shape[0] != "sigmoid":  # the others' problems have one value
        value = lambda a: a.sum() - 0.5 * (a * y) @ gram @ (a * y)
        rng = np.random.default_rng(2)
        for _ in range(200):
            i, j = rng.integers(0, 60, 2)
            move = alpha.copy()
            step = rng.normal() * 0.1
            move[i] += y[i] * step
            move[j] -= y[j] * step
            assert not ((move >= 0).all() and (move <= c).all()) or value(move) <= value(alpha) + 1e-6


@pytest.mark.parametrize("name", ["linear", "rbf", "poly", "sigmoid"])
def test_predictions_are_those_of_the_pairs(spark, name):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.6, (40, 2)) for m in ((0, 0), (3, 0), (0, 3))])
    y = np.repeat(["a", "b", "c"], 40)
    rows = [(i, float(p), float(q), str(k)) for i, ((p, q), k) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, "a"), (901, 1.0, 1.0, None)], "id long, p double, q double, y string").repartition(3)
    got = {r["id"]: r["prediction"] for r in M.svm(df, df, ["p", "q"], "y", name, 1.0, tolerance=1e-6).collect()}
    shape = (name, 1 / (2 * np.concatenate([x.ravel()]).var()), 3, 0.0)
    votes, sums = np.zeros((120, 3)), np.zeros((120, 3))
    for a, b in ((0, 1), (0, 2), (1, 2)):
        own = np.flatnonzero((y == "abc"[a]) | (y == "abc"[b]))
        s = np.where(y[own] == "abc"[a], 1.0, -1.0)
        alpha, rho = K.solve(x[own], s, 1.0, shape, 1e-6)
        value = np.array([[plain_kernel(shape, p, r) for r in x[own]] for p in x]) @ (alpha * s) - rho
        votes[:, a] += value > 0
        votes[:, b] += value <= 0
        sums[:, a] += value
        sums[:, b] -= value
    want = ["abc"[max(range(3), key=lambda k: (votes[i, k], sums[i, k], -k))] for i in range(120)]
    assert sum(got[i] != w for i, w in enumerate(want)) <= (2 if name == "sigmoid" else 0) and got[900] is None and len(got) == 122
    assert name == "sigmoid" or np.mean([got[i] == y[i] for i in range(120)]) > 0.9


def test_a_cascade_comes_near_the_whole(spark, monkeypatch):
    x, y = data(600, 4)
    rows = [(i, float(p), float(q), "in" if s < 0 else "out") for i, ((p, q), s) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, p double, q double, y string").repartition(4)
    one = {r["id"]: r["prediction"] for r in M.svm(df, df, ["p", "q"], "y").collect()}
    monkeypatch.setattr(K, "BLOCK", 150)
    many = {r["id"]: r["prediction"] for r in M.svm(df, df, ["p", "q"], "y").collect()}
    assert np.mean([one[i] == many[i] for i in one]) > 0.98 and np.mean([many[r[0]] == r[3] for r in rows]) > 0.85
    same = M.svm(df.where("y = 'in'"), df, ["p", "q"], "y")
    assert {r["prediction"] for r in same.collect()} == {"in"}


def test_machines_are_solved_whole_and_asked_in_blocks(spark, monkeypatch):
    """A pair of 5,000 rows is one block, solved in working sets; support vectors stay with the executors, and each is met once for all its machines."""
    x, y = data(5000, 5)
    alpha, rho = K.solve(x, y, 1.0, ("rbf", 0.5, 3, 0.0), 1e-3)
    margin = y * (np.concatenate([K.kernel("rbf", x[k : k + 500], x, 0.5, 3, 0.0) @ (alpha * y) for k in range(0, 5000, 500)]) - rho)
    assert abs(alpha @ y) < 1e-6 and (margin[alpha <= 0] > 1 - 2e-3).all() and (margin[alpha >= 1] < 1 + 2e-3).all()
    assert 5000 <= K.BLOCK
    rows = [(i, float(p), float(q), "abc"[int(p > 0) + int(q > 0)]) for i, (p, q) in enumerate(x[:300])]
    df = spark.createDataFrame([*rows, (900, None, 1.0, "a")], "id long, p double, q double, y string").repartition(4)
    one = {r["id"]: r["prediction"] for r in M.svm(df, df, ["p", "q"], "y").collect()}
    monkeypatch.setattr(K, "ASKED", 20)
    many = {r["id"]: r["prediction"] for r in M.svm(df, df, ["p", "q"], "y").collect()}
    assert one == many and one[900] is None and np.mean([one[r[0]] == r[3] for r in rows]) > 0.95


def test_rows_that_rest_are_brought_up_to_date(monkeypatch):
    """Far more rows than a working set, most at a bound, that rest in several turns: the conditions hold for all, by kernels in double precision. A pair of 90,000 rows is one block."""
    monkeypatch.setattr(K, "WORK", 64)
    monkeypatch.setattr(K, "REST", 3)
    x, y = data(3000, 6)
    flip = np.random.default_rng(7).random(3000) < 0.3
    y, asked = np.where(flip, -y, y), []
    products = K._products
    monkeypatch.setattr(K, "_products", lambda *a: (lambda f: lambda rows, others, w: asked.append(len(rows)) or f(rows, others, w))(products(*a)))
    alpha, rho = K.solve(x, y, 1.0, ("rbf", 0.5, 3, 0.0), 1e-3)
    margin = y * (K.kernel("rbf", x, x, 0.5, 3, 0.0) @ (alpha * y) - rho)
    assert abs(alpha @ y) < 1e-6 and (margin[alpha <= 0] > 1 - 2e-3).all() and (margin[alpha >= 1] < 1 + 2e-3).all()
    assert np.abs(margin[(alpha > 0) & (alpha < 1)] - 1).max() < 2e-3
    assert min(asked) < 3000 and K.BLOCK >= 90_000
