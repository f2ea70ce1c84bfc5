"""Values at the places around a pixel, and points kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pixels import KEY

#: Places around a pixel, clockwise from above.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def around(df: DataFrame, value: str, places: tuple, keys: list[str] = KEY) -> DataFrame:
    """df with n0, n1, ...: the value at each of the places around a pixel, null where there is none. One shuffle."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(places)])).alias("o")
    other = [k for k in keys if k not in ("y", "x")]
    sent = df.select(*other, "y", "x", F.col(value).alias("_v"), o).select(*other, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "_v", "o.i")
    near = sent.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(f"n{i}") for i in range(len(places))])
    return df.join(near, keys, "left")


def spaced(points: DataFrame, distance: float) -> DataFrame:
    """points(raster_id, id, y, x, strength) of which the strongest stays, those nearer than distance to it go, and so on among the rest (equal strengths: smaller id).

    A grid of that size bounds what is compared; in a round each point with no stronger one left nearby
    stays, and its neighbours go. Lineage is cut each round.
    """
    p = cut(points.select("raster_id", "id", "y", "x", "strength"))
    cell = lambda c: F.floor(F.col(c) / distance)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    q = p.select("raster_id", *[F.col(c).alias(f"_{c}") for c in ("id", "y", "x", "strength")], (cell("y")).alias("_cy"), cell("x").alias("_cx"), near)
    q = q.select("raster_id", "_id", "_y", "_x", "_strength", (F.col("_cy") + F.col("o.i")).alias("_cy"), (F.col("_cx") + F.col("o.j")).alias("_cx"))
    stronger = (F.col("_strength") > F.col("strength")) | ((F.col("_strength") == F.col("strength")) & (F.col("_id") < F.col("id")))
    pairs = p.withColumn("_cy", cell("y")).withColumn("_cx", cell("x")).join(q, ["raster_id", "_cy", "_cx"]).where(stronger & (F.hypot(F.col("y") - F.col("_y"), F.col("x") - F.col("_x")) < distance))
    pairs = cut(pairs.select("raster_id", "id", "_id"))
    left, kept = p.select("raster_id", "id"), None
    while not left.isEmpty():
        stays = cut(left.join(pairs, ["raster_id", "id"], "leftanti"))
        kept = stays if kept is None else kept.unionByName(stays)
        near_kept = pairs.join(stays.withColumnRenamed("id", "_id"), ["raster_id", "_id"], "leftsemi").select("raster_id", "id").distinct()
        left = cut(left.join(stays, ["raster_id", "id"], "leftanti").join(near_kept, ["raster_id", "id"], "leftanti"))
        pairs = cut(pairs.join(left, ["raster_id", "id"], "leftsemi").join(left.withColumnRenamed("id", "_id"), ["raster_id", "_id"], "leftsemi"))
    return p.limit(0) if kept is None else p.join(kept, ["raster_id", "id"], "leftsemi")
