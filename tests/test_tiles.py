"""Work that tiles do where their pixels lie: small rasters need no rounds, and tiles give what the whole raster would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem.cases import base
from meristem.operators import features as X
from meristem.operators import geometry as G
from meristem.operators import labels as L

SHAPE = (23, 19)


def rasters(spark, level=0, n=2):
    rng = np.random.default_rng(8)
    v = np.round(rng.random((n, *SHAPE)) * 60)
    v[:, 3:12, 2:15] += 40  # something with an inside
    rows = [(r, y, x, float(v[r, y, x])) for r in range(n) for y in range(SHAPE[0]) for x in range(SHAPE[1])]
    return spark.createDataFrame(rows, "raster_id long, y int, x int, v double").withColumn("v", F.when(F.col("v") > level, F.col("v")).otherwise(0.0)).repartition(3), np.where(v > level, v, 0)


def refuse(*_, **__):
    raise AssertionError("not for rasters of one tile")


def told(df, *columns):
    return {(r["raster_id"], r["y"], r["x"]): tuple(r[c] for c in columns) for r in df.collect()}


def flooded(on, near):
    """Labels by flooding from pixels in row order."""
    out, label = {}, 0
    for start in zip(*np.nonzero(on), strict=True):
        if start not in out:
            label += 1
            out[start], todo = label, [start]
            while todo:
                y, x = todo.pop()
                for q in ((y + dy, x + dx) for dy, dx in near):
                    if 0 <= q[0] < SHAPE[0] and 0 <= q[1] < SHAPE[1] and on[q] and q not in out:
                        out[q] = label
                        todo.append(q)
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [4, 512])
def test_labels_are_those_of_a_flood(spark, monkeypatch, connectivity, tile):
    df, v = rasters(spark, 45)
    if tile == 512:
        monkeypatch.setattr(L, "connected_components", refuse)
        got = told(L.component_labels(df, connectivity), "label")
    else:
        got = told(L.component_labels(df, connectivity, tile), "label")
    near = X.RING if connectivity == 8 else X.RING[::2]
    assert got == {(r, int(y), int(x)): (k,) for r in range(2) for (y, x), k in flooded(v[r] > 0, near).items()}


def test_thinning_of_small_rasters_is_one_pass(spark, monkeypatch):
    df, _ = rasters(spark, 40)
    calls, real = [], X.cut
    monkeypatch.setattr(X, "cut", lambda d: (calls.append(1), real(d))[1])
    whole = told(X.thinned(df))
    assert len(calls) == 1
    assert told(X.thinned(df, 5, 2)) == whole and len(calls) > 2


def test_means_shift_within_tiles(spark, monkeypatch):
    df, v = rasters(spark)
    monkeypatch.setattr(X, "cut", refuse)
    got = told(X.mean_shift(df, 2, 15, 3), "v")
    assert got == told(X.mean_shift(df, 2, 15, 3, 7), "v")
    disc = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4]
    for r, y, x in [(0, 0, 0), (0, 11, 9), (1, 22, 18), (1, 5, 14)]:
        at = (y, x, v[r, y, x])
        for _ in range(3):
            by, bx = int(np.floor(at[0] + 0.5)), int(np.floor(at[1] + 0.5))
            met = [(q, p, v[r, q, p]) for q, p in ((by + dy, bx + dx) for dy, dx in disc) if 0 <= q < SHAPE[0] and 0 <= p < SHAPE[1] and abs(v[r, q, p] - at[2]) <= 15]
            at = tuple(round(sum(m[k] for m in met) / len(met), 6) for k in range(3)) if met else at
        assert got[r, y, x] == (at[2],)


def test_nulls_of_a_shift_stay_null(spark):
    df = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, 4.0), (1, 0, 2, 6.0)], "raster_id long, y int, x int, v double")
    assert told(X.mean_shift(df, 1, 5, 1), "v") == {(1, 0, 0): (None,), (1, 0, 1): (5.0,), (1, 0, 2): (5.0,)}


def test_lines_are_transformed_where_they_are(spark, capsys):
    df, v = rasters(spark)
    spectrum = G.dft(df)
    capsys.readouterr()
    spectrum.explain()
    assert "explode" not in capsys.readouterr().out
    got, want = told(spectrum, "re", "im"), np.fft.fft2(v)
    assert len(got) == v.size and all(abs(complex(*z) - want[k]) < 1e-9 for k, z in got.items())
    back = told(G.ifft(G.fft(df)), "v")
    assert all(abs(z[0] - v[k]) < 1e-9 for k, z in back.items())


def test_rasters_are_dealt_before_they_become_pixels(spark, capsys):
    d = base.gray(spark, "/root/testdata/sf0.001")
    d.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    d.groupBy("raster_id", "y", "x").agg(F.max("v")).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
