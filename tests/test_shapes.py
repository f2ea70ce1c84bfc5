"""Least rectangles, dilation along borders and mixtures of backgrounds against plain versions."""

import math

import duckdb
import numpy as np
import pyarrow as pa

from meristem.operators import features as X
from meristem.operators import geometry as G
from meristem.operators import signals as S


def test_least_rectangles(spark):
    rng = np.random.default_rng(1)
    sets = [rng.normal(size=(40, 2)) @ np.array([[3, 1], [0.2, 0.7]]), np.array([[0.0, 0], [1, 1], [2, 2]]), np.array([[4.0, 5]]), np.array([[x, y] for x in range(5) for y in range(3)], float)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, s in enumerate(sets) for x, y in s], "raster_id long, x double, y double")
    got = {r["raster_id"]: r for r in G.least_rectangle(df).collect()}
    for i, s in enumerate(sets):
        r = got[i]
        least = min(np.ptp(s @ (math.cos(t), math.sin(t))) * np.ptp(s @ (-math.sin(t), math.cos(t))) for t in np.radians(np.arange(0, 90, 0.02)))
        assert r["width"] * r["height"] <= least + 1e-9
        c, n = math.cos(math.radians(r["angle"])), math.sin(math.radians(r["angle"]))
        u, v = (s - (r["cx"], r["cy"])) @ (c, n), (s - (r["cx"], r["cy"])) @ (-n, c)
        assert np.abs(u).max() <= r["width"] / 2 + 1e-9 and np.abs(v).max() <= r["height"] / 2 + 1e-9
    assert (got[3]["width"], got[3]["height"], got[3]["angle"]) == (4, 2, 0)


def test_borders_are_drawn_out_along_themselves(spark):
    """A horizontal and a vertical bar with a gap each: the gaps are bridged, and the bars get no thicker than closing makes them."""
    a = np.zeros((40, 40))
    a[10:13, 3:14] = a[10:13, 18:30] = 255
    a[20:30, 35:38] = a[34:39, 35:38] = 255
    df = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(40) for x in range(40)], "raster_id long, y int, x int, v double")
    out = np.zeros((40, 40))
    for r in X.oriented_dilate(df, 9, then_close=False).collect():
        out[r["y"], r["x"]] = r["v"]
    assert (out[a > 0] == 255).all() and (out[11, 3:30] == 255).all() and (out[20:39, 36] == 255).all()
    assert (out[:8] == 0).all() and (out[15:, :30] == 0).all()
    assert X.line_places(5, 0) == [(0, x) for x in range(-2, 3)] and X.line_places(5, 90) == [(y, 0) for y in range(-2, 3)]
    assert X.line_places(3, 45, 2) == [(2 - k, k - 2) for k in range(5)][::-1]


def plain_mixture(values, history, threshold):
    """One pixel's masks, with arrays of at most five weights, means and variances."""
    w, m, s, out = np.zeros(0), np.zeros(0), np.zeros(0), []
    for n, v in enumerate(values, 1):
        rate = 1 / min(2 * n, history)
        far = (m - v) ** 2
        fit = next((i for i in range(len(w)) if far[i] < 9 * s[i]), None)
        last = len(w) if fit is None else fit + 1
        before = np.concatenate(([0], np.cumsum(w)))[:-1]
        back = any(before[i] < 0.9 and far[i] < threshold * s[i] for i in range(last))
        dark = any(before[i] < 0.9 and m[i] > 0 and 0.5 * m[i] <= v <= m[i] for i in range(len(w)))
        out.append(0 if back else 127 if dark else 255)
        w = (1 - rate) * w - 0.05 * rate
        if fit is not None:
            w[fit] += rate
            k = rate / w[fit]
            m[fit], s[fit] = m[fit] + k * (v - m[fit]), np.clip(s[fit] + k * (far[fit] - s[fit]), 4, 75)
        keep = w > 0.05 * rate
        w, m, s = w[keep], m[keep], s[keep]
        if fit is None:
            w, m, s = w[:4] if len(w) == 5 else w, m[:4] if len(w) == 5 else m, s[:4] if len(w) == 5 else s
            m, s = m[: len(w)], s[: len(w)]
            w, m, s = np.append((1 - rate) * w, rate if len(w) else 1.0), np.append(m, v), np.append(s, 15.0)
        w = w / w.sum()
        order = np.argsort(-w, kind="stable")
        w, m, s = w[order], m[order], s[order]
    return out


def test_backgrounds_of_several_distributions(spark):
    """A pixel that flickers between two levels is background at both, which one distribution can't say."""
    rng = np.random.default_rng(2)
    flicker = [float(np.clip(rng.choice([60, 180]) + rng.normal(0, 2), 0, 255)) for _ in range(120)] + [230.0, 95.0, 60.0]
    steady = [100.0 + float(rng.normal(0, 1)) for _ in range(60)] + [70.0, 20.0, 100.0]
    wild = [float(v) for v in rng.integers(0, 256, 80)]
    streams = [flicker, steady, wild]
    df = spark.createDataFrame([(0, t, 0, x, v) for x, own in enumerate(streams) for t, v in enumerate(own)], "raster_id int, tick int, y int, x int, v double").repartition(3)
    got = {(r["x"], r["tick"]): r["mask"] for r in S.background_mixture(df, 50).collect()}
    assert got == {(x, t): v for x, own in enumerate(streams) for t, v in enumerate(plain_mixture(own, 50, 16.0))}
    assert [got[0, t] for t in (120, 122)] == [255, 0] and np.mean([got[0, t] > 0 for t in range(20, 120)]) < 0.05
    assert [got[1, t] for t in (60, 61, 62)] == [127, 255, 0]
    shown = {(r["x"], r["tick"]): r["v"] for r in S.foreground(df, 50).collect()}
    assert shown[1, 61] == 20.0 and shown[1, 60] == shown[1, 62] == 0.0


def test_upright_boxes_point_as_their_sql_says(spark):
    """The places of one raster whose covariance is 0 but for rounding, just below 0: its SQL has -90 degrees."""
    places = [(5, 0), (1, 1), (3, 1), (1, 2), (2, 2), (2, 3), (5, 3), (2, 4), (3, 4), (4, 4), (6, 4), (1, 5), (1, 6), (4, 6), (5, 6), (6, 6), (0, 7), (1, 7), (2, 7), (3, 7), (6, 7)]
    box = G.oriented_box(spark.createDataFrame([(1, y, x, 255.0) for x, y in places], "raster_id long, y int, x int, v double")).first()
    assert (round(box["angle"], 4), round(box["length"], 4), round(box["width"], 4)) == (-90.0, 7.0, 6.0)


def on_the_threshold():
    """(rows, frames, places of the foreground by SQL): values whose squared distance is 16 variances exactly, so that the variance's last bit decides."""
    rng, rows = np.random.default_rng(5), []
    while len(rows) < 400:
        n = int(rng.integers(2, 11))
        w = np.clip(np.floor(128 + rng.normal(0, rng.choice([3, 8, 20]), (20000, n))), 0, 255).astype(int)
        total, spread = w.sum(1), 16 * (n * (w * w).sum(1) - w.sum(1) ** 2)
        root = np.sqrt(spread).round().astype(int)
        v, on = (total + root) // n, (root * root == spread) & (spread > 64 * n * n) & ((total + root) % n == 0)
        rows += [[*w[i].tolist(), int(v[i])] for i in np.flatnonzero(on & (v < 256))[:50]]
    frames = pa.table(dict(zip(("raster_id", "tick", "y", "x", "v"), zip(*[(0, t, 0, x, float(v)) for x, own in enumerate(rows) for t, v in enumerate(own)], strict=True), strict=True)))
    sql = "select x, tick from frames window w as (partition by raster_id, y, x order by tick rows between 10 preceding and 1 preceding) qualify coalesce(power(v - avg(v) over w, 2) > 16 * greatest(var_pop(v) over w, 4), false)"
    return rows, frames, set(duckdb.sql(sql).fetchall())


def test_backgrounds_on_the_threshold_are_as_their_sql_says(spark):
    rows, frames, want = on_the_threshold()
    got = S.background_gaussian(spark.createDataFrame(frames).repartition(3)).where("mask = 255").select("x", "tick").collect()
    assert {tuple(r) for r in got} == want and 0 < sum(t + 1 == len(rows[x]) for x, t in want) < len(rows)


def test_what_is_left_of_frames_on_the_threshold_is_as_its_sql_says(spark):
    _, frames, want = on_the_threshold()
    got = S.background_removed(spark.createDataFrame(frames).repartition(3)).where("v > 0").select("x", "tick").collect()
    assert {tuple(r) for r in got} == want


def test_oriented_boxes_have_the_least_area(spark):
    """A bar with a corner, whose principal axes' box is larger; a slanted and an upright line; one pixel; nothing set."""
    sets = [[(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 2)], [(3, 0), (2, 1), (1, 2)], [(4, 1), (4, 2), (4, 5)], [(6, 5)], []]
    rows = [(i, y, x, 255.0) for i, s in enumerate(sets) for x, y in s] + [(4, 0, 0, 0.0)]
    got = {r["raster_id"]: tuple(round(v, 6) for v in (r["cx"], r["cy"], r["angle"], r["length"], r["width"])) for r in G.oriented_box(spark.createDataFrame(rows, "raster_id long, y int, x int, v double")).collect()}
    assert got == {0: (2, 1, 0, 4, 2), 1: (2, 1, -45, round(math.sqrt(8), 6), 0), 2: (4, 3, -90, 4, 0), 3: (6, 5, 0, 0, 0)}
