"""Kendall's tau-b by counting inversions: pairs are never formed.

Distinct (x, y) with their counts are dealt into ranges of x and into ranges of y. Of two cells in one
range of x, or in one of y, the order is counted inside that range, by halving; for two that differ in
both, the counts by (range of x, range of y) tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

PIECE, MOST = 20_000, 256  # cells of a range, and ranges at most (their counts by two ranges go to the driver)


def signs(y: np.ndarray, n: np.ndarray) -> int:
    """Sum over i < j of sign(y[j] - y[i]) n[i] n[j], level by level: right halves against left halves, all of a level in one sort."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    place, total, width = np.arange(len(y)), 0, 1
    while width < len(y):
        block = place // (2 * width)
        left = place % (2 * width) < width
        order = np.lexsort((rank, block))
        b, r, w, own = block[order], rank[order], n[order], left[order]
        upto = np.concatenate(([0], np.cumsum(np.where(own, w, 0))))
        new_block = np.concatenate(([True], b[1:] != b[:-1]))
        new = new_block | np.concatenate(([True], r[1:] != r[:-1]))
        starts = np.flatnonzero(new)
        first = np.repeat(starts, np.diff(np.append(starts, len(b))))
        end = np.repeat(np.append(starts[1:], len(b)), np.diff(np.append(starts, len(b))))
        blocks = np.flatnonzero(new_block)
        size = np.diff(np.append(blocks, len(b)))
        base, stop = upto[np.repeat(blocks, size)], upto[np.repeat(np.append(blocks[1:], len(b)), size)]
        less, more = upto[first] - base, stop - upto[end]
        total += int((np.where(own, 0, w) * (less - more)).sum())
        width *= 2
    return total


def concordance(key: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Sum of sign(y[j] - y[i]) n[i] n[j] over pairs with key[i] < key[j]."""
    order = np.lexsort((y, key))
    key, y, n = key[order], y[order], n[order]

    def squares(*columns: np.ndarray) -> int:
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
        return int((np.add.reduceat(n, np.flatnonzero(new)) ** 2).sum())

    # within one key y rises, so each of its pairs with two values of y has been counted as +1
    return signs(y, n) - (squares(key) - squares(key, y)) // 2 if len(n) else 0


def kendall(rows: DataFrame, a: str, b: str) -> float | None:
    """tau-b of two columns without nulls; null if one of them is constant."""
    cells = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    cells = cut(cells)
    pieces = max(1, min(MOST, -(-cells.count() // PIECE)))
    by_x = cut(cells.repartitionByRange(pieces, "x").withColumn("p", F.spark_partition_id()))
    both = cut(by_x.repartitionByRange(pieces, "y").withColumn("q", F.spark_partition_id()))

    def inside(key: str):
        def run(table: pa.Table) -> pa.Table:
            k, y, n = (table.column(c).to_numpy() for c in (key, "y", "n"))
            return pa.table({"s": pa.array([concordance(k, y, n)], pa.int64())})

        return run

    one = both.groupBy("p").applyInArrow(inside("x"), "s long").agg(F.sum("s")).first()[0] or 0
    two = both.groupBy("q").applyInArrow(inside("p"), "s long").agg(F.sum("s")).first()[0] or 0
    grid = np.zeros((pieces, pieces), object)
    for r in both.groupBy("p", "q").agg(F.sum("n").alias("n")).collect():  # MOST * MOST rows at most
        grid[r["p"], r["q"]] = r["n"]
    earlier = np.zeros(pieces, object)
    three = 0
    for row in grid:
        less = np.concatenate(([0], np.cumsum(earlier)[:-1]))
        three += int((row * (less - (earlier.sum() - less - earlier))).sum())
        earlier = earlier + row
    total = sum(grid.ravel().tolist())
    ties = lambda c: cells.groupBy(c).agg(F.sum("n").cast("decimal(38,0)").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    apart = [total * total - int(ties(c)) for c in ("x", "y")]
    return 2 * (one + two + three) / (float(apart[0]) ** 0.5 * float(apart[1]) ** 0.5) if all(apart) else None
