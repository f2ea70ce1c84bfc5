"""Plans that must not change their shape with the table: a side that is made of few rows isn't broadcast once it has become many."""

import numpy as np
from pyspark.sql import functions as F

from meristem.operators import features as X
from meristem.operators import geometry as G


def raster(spark, shape=(9, 7), n=3):
    rng = np.random.default_rng(5)
    rows = [(r, y, x, float(rng.integers(0, 256))) for r in range(n) for y in range(shape[0]) for x in range(shape[1])]
    return spark.createDataFrame(rows, "raster_id long, y int, x int, v double").repartition(3), rows


def ran(df, capsys):
    """Rows, and the plan as it ran."""
    rows = df.collect()
    capsys.readouterr()
    df.explain()
    return rows, capsys.readouterr().out


def test_grids_of_places_are_not_broadcast(spark, capsys):
    df, rows = raster(spark)
    got, plan = ran(G.rotate_expanded(df, 90), capsys)
    assert {(r["raster_id"], r["y"], r["x"]): r["v"] for r in got} == {(r, 6 - x, y): v for r, y, x, v in rows}
    assert "Broadcast" not in plan
    got, plan = ran(G.resize(df, 4, 4, method="nearest"), capsys)
    assert len(got) == 48 and "Broadcast" not in plan


def test_resampling_fills_what_lies_outside_and_what_is_missing(spark):
    df, rows = raster(spark)
    got = {(r["raster_id"], r["y"], r["x"]): r["v"] for r in G.warp_affine(df.where("not (y = 4 and x = 3)"), [[1, 0, 0.5], [0, 1, 0]]).collect()}
    v = {(r, y, x): v for r, y, x, v in rows if (y, x) != (4, 3)}
    for (r, y, x), value in got.items():
        near = [v[r, y, q] for q in (x - 1, x) if (r, y, q) in v] if x else []
        assert value == (sum(near) / len(near) if near else 0.0)
    assert len(got) == 3 * 63


def test_draws_of_matches_are_not_broadcast(spark, capsys):
    rng = np.random.default_rng(6)
    rows = [(k, i, float(p), float(q), 2.0 * p + q + 1, float(q - p + 3)) for k in range(3) for i, (p, q) in enumerate(rng.integers(0, 50, (20, 2)).tolist())]
    frame = spark.createDataFrame(rows, "pair long, match_id long, x1 double, y1 double, x2 double, y2 double")
    plans, real = [], X.cut
    X.cut = lambda df: (plans.append(ran(df, capsys)[1]), real(df))[1]
    try:
        best, _ = X.ransac_matches(frame, ["pair"], 0.5, 40)
    finally:
        X.cut = real
    assert [r["inliers"] for r in best.collect()] == [20] * 3
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_turned_rasters_are_not_broadcast(spark, capsys):
    df, rows = raster(spark)
    got, plan = ran(G.rotate(df, 180), capsys)
    assert {(r["raster_id"], r["y"], r["x"]): r["v"] for r in got} == {(r, 8 - y, 6 - x): v for r, y, x, v in rows}
    assert "Broadcast" not in plan


def test_corners_flow_from_what_is_written_once(spark, monkeypatch):
    """The gradients of the frames are computed once for the corners and their flow, in one pass, and the plan that is left reads tables instead of computing them again."""
    from meristem.operators import features as X
    from meristem.operators import stencils

    rows = [(r, t, y, x, float((x * 7 + y * 13 + t * 5 + r) % 31)) for r in range(2) for t in range(2) for y in range(8) for x in range(8)]
    frames = spark.createDataFrame(rows, "raster_id long, tick long, y int, x int, v double")
    made, real = [], X.gradients
    monkeypatch.setattr(X, "gradients", lambda *a: made.append(1) or real(*a))
    assert X.corner_flow(frames).count() > 0 and len(made) == 1
    df = frames.where("tick = 0 and not (raster_id = 1 and y = 3 and x = 3)").select("raster_id", "y", "x", "v")
    two = stencils.convolve(df, stencils.SOBEL_X).withColumnRenamed("v", "dx").join(stencils.convolve(df, stencils.SOBEL_X.T.copy()).withColumnRenamed("v", "dy"), ["raster_id", "y", "x"])
    order = lambda d: sorted(map(tuple, d.select("raster_id", "y", "x", "dx", "dy").collect()))
    assert order(real(df)) == order(two)
