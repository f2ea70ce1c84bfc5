"""Kernel machines, one for each pair of classes, by sequential minimal optimisation in a cascade of blocks.

The rows of a pair of classes are dealt into blocks of BLOCK rows; each is solved by a task, and only its
support vectors go on, until the pair is one block, whose solution is the pair's machine. A pair that is
one block from the start is solved to the tolerance; of a larger one, rows that no block needs are left out, which
is close to, but not always, the optimum over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK, ROUNDS = 100_000, 6  # rows of a block; of a cascade, after which what is left is one block
WORK, ROWS = 1024, 1024  # rows that are solved among themselves; rows of a product of matrices
REST = 10  # turns after which rows that promise nothing rest
ASKED = 16_384  # rows asked, and support vectors, of a task


def kernel(name: str, x: np.ndarray, y: np.ndarray, gamma: float, degree: int, coef0: float) -> np.ndarray:
    dot = x @ y.T
    if name == "linear":
        return dot
    if name == "poly":
        return (gamma * dot + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    dot *= 2 * gamma
    dot -= gamma * (x * x).sum(1)[:, None]
    dot -= gamma * (y * y).sum(1)[None]
    return np.exp(np.minimum(dot, 0, out=dot), out=dot)


def _pairwise(gram: np.ndarray, y: np.ndarray, alpha: np.ndarray, gradient: np.ndarray, c: float, tolerance: float, most: int) -> int:
    """Moves alpha and its gradient, in place, until no pair of rows promises more than the tolerance; how many steps that took. In each step the pair that promises the largest gain moves along the constraint."""
    diagonal = gram.diagonal().copy()
    for n in range(most):
        rise = -y * gradient
        up, down = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
        if not up.any() or not down.any():
            return n
        i = int(np.where(up, rise, -np.inf).argmax())
        behind = rise[i] - rise
        if np.where(down, behind, -np.inf).max() < tolerance:
            return n
        bend = np.maximum(diagonal[i] + diagonal - 2 * gram[i], 1e-12)
        j = int(np.where(down & (behind > 0), behind * behind / bend, -np.inf).argmax())
        step = min(behind[j] / bend[j], c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i], alpha[j] = np.clip(alpha[i] + y[i] * step, 0, c), np.clip(alpha[j] - y[j] * step, 0, c)
        gradient += y * step * (gram[i] - gram[j])
    return most


def _products(x: np.ndarray, shape: tuple, tolerance: float):
    """f(rows, others, weights): the kernel of these rows of x by the others, times weights; block by block.

    The exponents of rbf come from one product of single-precision matrices where what that rounds is far
    under the tolerance.
    """
    name, gamma = shape[:2]
    if name == "rbf" and tolerance >= 1e-4:
        v = x - x.mean(axis=0)
        long = gamma * np.einsum("ij,ij->i", v, v)[:, None]
        if long.max(initial=0) < 10:
            left, right = (np.concatenate(c, 1).astype(np.float32) for c in ((2 * gamma * v, -long, np.ones_like(long)), (v, np.ones_like(long), -long)))

            def quick(rows: np.ndarray, others: np.ndarray, weights: np.ndarray) -> np.ndarray:
                out, other, weights = np.empty(len(rows)), right[others].T, weights.astype(np.float32)
                for k in range(0, len(rows), ROWS):
                    d = left[rows[k : k + ROWS]] @ other
                    out[k : k + ROWS] = np.exp(np.minimum(d, 0, out=d), out=d) @ weights
                return out

            return quick
    return lambda rows, others, weights: np.concatenate([np.zeros(0), *[kernel(name, x[rows[k : k + ROWS]], x[others], *shape[1:]) @ weights for k in range(0, len(rows), ROWS)]])


def solve(x: np.ndarray, y: np.ndarray, c: float, shape: tuple, tolerance: float = 1e-3, most: int = 10_000_000) -> tuple[np.ndarray, float]:
    """(alpha, rho) for classes y of 1 and -1. The WORK rows that break the conditions most, half of them new, are solved among themselves, and what they moved is carried to all rows by products of matrices, until no two rows promise more than the tolerance.

    Rows at a bound that promise nothing with any other rest, from time to time; what moved in the
    meantime is carried to them when the others are solved, and then all are looked at again.
    """
    n = len(y)
    alpha, gradient, work, live = np.zeros(n), -np.ones(n), np.zeros(0, int), np.arange(n)
    product, turn, stuck, asleep = _products(x, shape, tolerance), 0, False, []  # asleep: rows, and what has moved since they rest
    while most > 0:
        rise = -y[live] * gradient[live]
        up, down = np.where(y[live] > 0, alpha[live] < c, alpha[live] > 0), np.where(y[live] > 0, alpha[live] > 0, alpha[live] < c)
        high, low = rise[up].max(initial=-np.inf), rise[down].min(initial=np.inf)
        gap = high - low
        if gap < tolerance or stuck:
            if not asleep:
                break
            for rows, unseen in asleep:
                moved = np.flatnonzero(unseen)
                for k in range(0, len(moved), WORK):
                    gradient[rows] += y[rows] * product(rows, moved[k : k + WORK], unseen[moved[k : k + WORK]])
            live, asleep, turn, stuck = np.arange(n), [], 0, False
            continue
        turn += 1
        if n > WORK and turn % REST == 0:
            idle = down & ~up & (rise > high) | up & ~down & (rise < low)
            if idle.any():
                asleep.append((live[idle], np.zeros(n)))
                live = live[~idle]
                continue
        order = np.argsort(rise, kind="stable")
        new = WORK if n <= WORK or not len(work) else WORK // 2
        top, bottom = order[::-1][up[order[::-1]]][: -(-new // 2)], order[down[order]][: -(-new // 2)]
        chosen = live[np.unique(np.concatenate([top, bottom]))]
        kept = work[~np.isin(work, chosen) & np.isin(work, live)]
        kept = kept[np.argsort((alpha[kept] <= 0) | (alpha[kept] >= c), kind="stable")]  # those that can move both ways first
        work = np.arange(n) if n <= WORK else np.concatenate([chosen, kept[: max(0, WORK - len(chosen))]])
        near, was = x[work], alpha[work].copy()
        own, slope = was.copy(), gradient[work].copy()
        most -= max(1, _pairwise(kernel(shape[0], near, near, *shape[1:]), y[work], own, slope, c, max(tolerance / 2, gap / 10) if n > WORK else tolerance, most))
        alpha[work] = own
        moved = np.flatnonzero(own != was)
        stuck = not len(moved)
        change = (own - was)[moved] * y[work[moved]]
        gradient[live] += y[live] * product(live, work[moved], change)
        for _, unseen in asleep:
            unseen[work[moved]] += change
    rise = -y * gradient
    free = (alpha > 0) & (alpha < c)
    if free.any():
        return alpha, float(-rise[free].mean())
    up, down = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
    return alpha, float(-(rise[up].max(initial=-np.inf) + rise[down].min(initial=np.inf)) / 2) if up.any() and down.any() else 0.0


def machines(rows: DataFrame, c: float, shape: tuple, tolerance: float) -> DataFrame:
    """(a, b, id, v, weight, rho): the support vectors of each pair a < b of classes, from rows(y string, v); id is the row's."""
    names = rows.select("y").distinct()
    pairs = names.select(F.col("y").alias("a")).join(names.select(F.col("y").alias("b")), F.col("a") < F.col("b"))  # classes, not rows
    d = rows.withColumn("id", F.monotonically_increasing_id()).join(F.broadcast(pairs), (F.col("y") == F.col("a")) | (F.col("y") == F.col("b")))
    d = d.select("a", "b", F.when(F.col("y") == F.col("a"), 1.0).otherwise(-1.0).alias("s"), "v", "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, s = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), table.column("s").to_numpy()
        alpha, rho = solve(x, s, c, shape, tolerance) if len(np.unique(s)) == 2 else (np.full(len(s), 1e-12), -float(s[0]))
        at = pa.array(np.flatnonzero(alpha > 0))
        out = table.select(["a", "b", "s", "v", "id"]).take(at)
        return out.append_column("weight", pa.array((alpha * s)[at.to_numpy()])).append_column("rho", pa.array(np.full(len(at), rho)))

    schema = "a string, b string, s double, v array<double>, id long, weight double, rho double"
    for r in range(ROUNDS):
        sizes = d.groupBy("a", "b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        n, most = sizes.agg(F.count("*"), F.max("parts")).first()
        if r + 1 == ROUNDS or most in (None, 1):
            d = d.repartition(max(1, min(16 * n, 1024)), "a", "b")  # so many that few pairs share a task
            return cut(d.groupBy("a", "b").applyInArrow(run, schema)).select("a", "b", "id", "v", "weight", "rho")
        dealt = d.join(F.broadcast(sizes), ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(r)), F.col("parts")))
        d = cut(dealt.groupBy("a", "b", "part").applyInArrow(run, schema)).select("a", "b", "s", "v", "id")


def classified(test: DataFrame, v, found: DataFrame, shape: tuple) -> DataFrame:
    """test rows with prediction: the class with most votes of its pairs' machines, of equal ones that with the larger sum of their values, then the smaller name. v: the features' array; rows with a null feature get null.

    A row that supports several machines is met once, with a weight for each. Rows asked and support
    vectors are dealt into blocks of about ASKED; a task meets one of each, and the sums of a block of rows
    asked come together in one task.
    """
    pairs = sorted(tuple(r) for r in found.select("a", "b", "rho").distinct().collect())  # of classes, not rows
    names = sorted({n for a, b, _ in pairs for n in (a, b)})
    left, right = (np.array([names.index(p[k]) for p in pairs], int) for k in (0, 1))
    rho = np.array([r for *_, r in pairs])
    number = test.sparkSession.createDataFrame([(a, b, i) for i, (a, b, _) in enumerate(pairs)], "a string, b string, pair int")
    support = cut(found.join(F.broadcast(number), ["a", "b"]).groupBy("id").agg(F.first("v").alias("v"), F.collect_list(F.struct("pair", "weight")).alias("own")))
    asked = cut(test.select(F.struct("*").alias("_row"), v.alias("_v"), F.monotonically_increasing_id().alias("_q")))
    whole = asked.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull()))
    n_q, n_t = (max(1, -(-d.count() // ASKED)) for d in (whole, support))
    q = whole.select(F.pmod(F.xxhash64("_q"), F.lit(n_q)).cast("int").alias("a"), F.explode(F.expr(f"sequence(0, {n_t - 1})")).alias("b"), F.col("_q").alias("q"), F.col("_v").alias("v"))
    t = support.select(F.explode(F.expr(f"sequence(0, {n_q - 1})")).alias("_a"), F.pmod(F.xxhash64("id"), F.lit(n_t)).cast("int").alias("_b"), "id", "v", "own")

    def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)

    def run(ask: pa.Table, own: pa.Table) -> pa.Table:
        out = pa.array([], pa.list_(pa.float64()))
        if ask.num_rows:
            sums = np.zeros((ask.num_rows, len(pairs)))
            if own.num_rows:
                own = own.sort_by("id")
                x, y, lists = matrix(ask.column("v"), ask.num_rows), matrix(own.column("v"), own.num_rows), own.column("own").combine_chunks()
                weight, cells = np.zeros((own.num_rows, len(pairs))), lists.flatten()
                weight[np.repeat(np.arange(own.num_rows), lists.value_lengths().to_numpy()), cells.field("pair").to_numpy()] = cells.field("weight").to_numpy()
                step = max(1, (1 << 22) // own.num_rows)
                for k in range(0, len(x), step):
                    sums[k : k + step] = kernel(shape[0], x[k : k + step], y, *shape[1:]) @ weight
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, len(pairs), dtype=np.int32)), pa.array(sums.ravel()))
        return pa.table([pa.array([], pa.int32()) if not ask.num_rows else ask.column("a"), pa.array([], pa.int32()) if not ask.num_rows else ask.column("b"), ask.column("q"), out], names=["a", "b", "q", "sums"])

    def vote(part: pa.Table) -> pa.Table:
        part = part.sort_by([("q", "ascending"), ("b", "ascending")])
        q = part.column("q").to_numpy()
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        value = np.add.reduceat(matrix(part.column("sums"), part.num_rows), first) - rho
        votes, sums = np.zeros((len(first), len(names))), np.zeros((len(first), len(names)))
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            votes[:, i] += value[:, k] > 0
            votes[:, j] += value[:, k] <= 0
            sums[:, i] += value[:, k]
            sums[:, j] -= value[:, k]
        tied = np.where(votes == votes.max(1, keepdims=True), sums, -np.inf)
        return pa.table({"_q": pa.array(q[first]), "prediction": pa.array(names).take(pa.array(tied.argmax(1)))})

    sums = q.groupBy("a", "b").cogroup(t.groupBy("_a", "_b")).applyInArrow(run, "a int, b int, q long, sums array<double>")
    won = sums.groupBy("a").applyInArrow(vote, "_q long, prediction string")
    return asked.join(won, "_q", "left").select("_row.*", "prediction")
