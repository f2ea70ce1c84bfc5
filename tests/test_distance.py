"""Distances, tiles and what stands on them, against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from meristem.operators import distance as D
from meristem.operators import labels as L


def raster(spark, arrays, first=0):
    rows = [(first + r, y, x, float(a[y, x])) for r, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "raster_id long, y int, x int, v double").repartition(3)


def test_envelope_is_the_least_parabola():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.sort(rng.choice(60, int(rng.integers(1, 30)), replace=False))
        height = rng.integers(0, 400, len(x))
        at = np.arange(-5, 65)
        assert (D.envelope(x, height, at) == ((at[:, None] - x[None]) ** 2 + height[None]).min(1)).all()
        assert (D.nearest_gaps(x, at) == np.abs(at[:, None] - x[None]).min(1)).all()


def test_distances_of_any_sets(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.random((17, 23)) < p for p in (0.02, 0.3, 0.9, 0.0)]
    a, b = raster(spark, [np.where(m, 255.0, 0.0) for m in arrays]), raster(spark, [np.where(m[::-1], 255.0, 0.0) for m in arrays])
    got = {(r["raster_id"], r["y"], r["x"]): r["distance"] for r in D.distances(a.where("v > 0").union(a.where("v > 0")), b.where("v > 0")).collect()}
    want = {}
    for r, m in enumerate(arrays):
        places = np.argwhere(m[::-1])
        for y, x in np.argwhere(m):
            if len(places):
                want[r, y, x] = math.sqrt(((places - (y, x)) ** 2).sum(1).min())
    assert got == want
    assert D.distances(a.limit(0), b).count() == 0 and D.distances(a, b.limit(0)).count() == 0


def test_distance_transform_of_a_large_raster(spark):
    """512 x 512 in seconds: checked at places drawn at random."""
    rng = np.random.default_rng(3)
    m = rng.random((512, 512)) < 0.999
    m[100:400, 100:400] = True
    y, x = np.divmod(np.arange(512 * 512), 512)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"raster_id": np.zeros(len(y), np.int64), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": np.where(m.ravel(), 255.0, 0.0)}))
    got = L.distance_transform(df).where(F.pmod(F.xxhash64("y", "x"), F.lit(500)) == 0).collect()
    off = np.argwhere(~m)
    assert len(got) > 300
    assert all(r["v"] == math.sqrt(((off - (r["y"], r["x"])) ** 2).sum(1).min()) for r in got)
