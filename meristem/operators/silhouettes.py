"""The mean silhouette of clusters, by sums of distances to each cluster; pairs are summed where they meet and not kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK, SPREAD = 32_768, 8  # rows of a block; blocks, at least, of a table that has an eighth of that for each
TILE = 1024  # rows of a product of matrices


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all rows to all others by a product of matrices; pairs so near that its rounding would show are measured one by one."""
    long = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", y, y)[:, None]
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.concatenate([-2 * x, long[0], np.ones_like(long[0])], 1) @ np.concatenate([y, np.ones_like(long[1]), long[1]], 1).T
        a, b = np.divmod(np.flatnonzero(~(d > 1e-5 * (long[0] + long[1].max(initial=0)))), d.shape[1])
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    step = max(1, (1 << 22) // x.shape[1])
    for s in range(0, len(a), step):
        d[a[s : s + step], b[s : s + step]] = np.sqrt(((x[a[s : s + step]] - y[b[s : s + step]]) ** 2).sum(axis=1))
    return d


def _sums(d: np.ndarray, code: np.ndarray, out: np.ndarray) -> None:
    """Adds each row's sum over the columns of each code, which rise, to its place in out(row, code)."""
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    if len(starts) > 16:
        out[:, code[starts]] += np.add.reduceat(d, starts, axis=1)
    else:
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
            out[:, code[a]] += d[:, a:b].sum(axis=1)


def silhouette(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """One row: the mean over rows of (b - a) / max(a, b), a being the mean distance to the row's own cluster's others and b the least mean distance to another cluster.

    A row alone in its cluster counts 0, as do all rows where there are fewer than two clusters or two
    rows. Rows with a null feature or cluster are left out. Rows are dealt into blocks by their clusters,
    so a block holds few of these; a task meets two blocks, or one with itself, and measures each pair of
    rows once for both. Rows move once for each block, and pass on a sum for each cluster of it; time
    grows with the square of the table.
    """
    d = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("v"), F.col(cluster).cast("string").alias("c")).where(F.forall("v", lambda x: x.isNotNull()) & F.col("c").isNotNull())
    rows = cut(d.withColumn("id", F.monotonically_increasing_id()))
    sizes = cut(rows.groupBy("c").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("c")) - F.col("n")))  # a row for each cluster
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(SPREAD, -(-n // max(1, BLOCK // 8))))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)  # of its cluster, where a row lies
    own = F.floor((F.col("before") + share * F.col("n")) * blocks / max(n, 1)).cast("int")
    own = rows.join(F.broadcast(sizes), "c").select("id", "c", "v", F.least(own, F.lit(blocks - 1)).alias("own"), F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("other"))
    met = own.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "c", "v").repartition(blocks * (blocks + 1) // 2, "a", "b")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        parts = [table.filter(pc.equal(table.column("own"), k)).sort_by("c") for k in dict.fromkeys(k.as_py() for k in key)]
        if all(p.num_rows for p in parts):
            x, y = parts[0], parts[-1]
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            names, codes = zip(*(np.unique(np.array(p.column("c").to_pylist(), object), return_inverse=True) for p in (x, y)), strict=True)
            v, w = matrix(x), matrix(y)
            there, back = np.zeros((len(v), len(names[1]))), np.zeros((len(w), len(names[0])))
            for s in range(0, len(v), TILE):
                for u in range(0, len(w), TILE):
                    far = _distances(v[s : s + TILE], w[u : u + TILE])
                    _sums(far, codes[1][u : u + TILE], there[s : s + TILE])
                    if x is not y:
                        _sums(far.T, codes[0][s : s + TILE], back[u : u + TILE])
            out = [(x, names[1], there)] + ([(y, names[0], back)] if x is not y else [])
        columns = [[np.repeat(t.column("id").to_numpy(), len(m)), np.repeat(np.array(t.column("c").to_pylist(), object), len(m)), np.tile(m, t.num_rows), s.ravel()] for t, m, s in out]
        columns = [np.concatenate(c) for c in zip(*columns, strict=True)] or [[], [], [], []]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("id", "c", "other", "s"), columns, (pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)})

    near = met.groupBy("a", "b").applyInArrow(run, "id long, c string, other string, s double")
    mean = near.groupBy("id", "c", "other").agg(F.sum("s").alias("s")).join(F.broadcast(sizes.select(F.col("c").alias("other"), "n")), "other")
    same = F.col("c") == F.col("other")
    per = mean.groupBy("id").agg(F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"), F.count("*").alias("n"))
