"""Exact Euclidean distances to the nearest pixel of a set, one axis after the other.

Down each column the nearest place of the set is found for every row that asks; along each row the
squared distances of its columns are parabolas, and their lower envelope gives the nearest of all. A
task holds one column's places, or one row's columns, so time and memory follow the raster's sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .pixels import KEY


def nearest_gaps(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of each of at to the nearest of rising places."""
    i = np.searchsorted(places, at)
    before, after = places[np.maximum(i - 1, 0)], places[np.minimum(i, len(places) - 1)]
    return np.minimum(np.abs(at - before), np.abs(after - at))


def envelope(x: np.ndarray, height: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over i of (at - x[i])^2 + height[i], for rising x, at each of at."""
    xs, tops = x.tolist(), (height + x * x).tolist()
    kept, starts = [0], [-np.inf]  # parabolas of the envelope, and from where on each is the lowest
    for i in range(1, len(xs)):
        while True:
            j = kept[-1]
            start = (tops[i] - tops[j]) / (2 * (xs[i] - xs[j]))
            if start > starts[-1]:
                break
            kept.pop(), starts.pop()
        kept.append(i), starts.append(start)
    best = np.array(kept)[np.searchsorted(starts, at, side="right") - 1]
    return (at - x[best]) ** 2 + height[best]


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(raster_id, y, x, distance): for each pixel of a the distance to the nearest pixel of b in its raster; pixels whose raster has none of b are left out."""
    kind = {f.name: f.dataType.simpleString() for f in a.select(*KEY).schema.fields}
    # down the columns of b, at the rows that a has
    wanted = a.select("raster_id", "y").distinct().groupBy("raster_id").agg(F.array_sort(F.collect_list(F.col("y").cast("long"))).alias("ys"))
    columns = b.groupBy("raster_id", F.col("x").cast("long").alias("x")).agg(F.array_sort(F.collect_set(F.col("y").cast("long"))).alias("places")).join(wanted, "raster_id")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ys = batch.column("ys")[i].values
                gap = nearest_gaps(batch.column("places")[i].values.to_numpy(), ys.to_numpy())
                same = pa.array(np.full(len(ys), i))
                yield pa.RecordBatch.from_arrays([batch.column("raster_id").take(same), ys, batch.column("x").take(same), pa.array(gap)], names=["raster_id", "y", "x", "gap"])

    near = columns.mapInArrow(down, f"raster_id {kind['raster_id']}, y long, x long, gap long")
    # along the rows
    rows = near.groupBy("raster_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "gap"))).alias("g"))
    asked = a.groupBy("raster_id", F.col("y").cast("long").alias("y")).agg(F.array_sort(F.collect_set(F.col("x").cast("long"))).alias("xs"))
    lines = rows.join(asked, ["raster_id", "y"]).select("raster_id", "y", "xs", F.transform("g", lambda s: s["x"]).alias("x"), F.transform("g", lambda s: s["gap"]).alias("gap"))
    out = StructType([*a.select(*KEY).schema.fields, *StructType.fromDDL("distance double").fields])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, gap, at = (batch.column(c)[i].values.to_numpy() for c in ("x", "gap", "xs"))
                far = np.sqrt(envelope(x, gap * gap, at).astype(float))
                same = pa.array(np.full(len(at), i))
                named = [batch.column("raster_id").take(same), batch.column("y").take(same), pa.array(at), pa.array(far)]
                yield pa.RecordBatch.from_arrays(named, names=["raster_id", "y", "x", "distance"])

    found = lines.mapInArrow(along, f"raster_id {kind['raster_id']}, y long, x long, distance double")
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out.fields])
