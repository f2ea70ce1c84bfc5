"""Operators without plain SQL against plain Python on small rasters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem.operators import features as X
from meristem.operators import labels as L
from meristem.operators import learning as M

RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def raster(spark, arrays):
    rows = [(r, y, x, float(a[y, x])) for r, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "raster_id long, y int, x int, v double").repartition(3)


def thin(a):
    a = np.pad(a > 0, 1)
    quiet, step = 0, 0
    while quiet < 2:
        out = []
        for y, x in zip(*np.nonzero(a), strict=True):
            n = [int(a[y + dy, x + dx]) for dy, dx in RING]
            turns = sum(n[i] == 0 and n[(i + 1) % 8] == 1 for i in range(8))
            first = n[0] * n[2] * n[4] == 0 and n[2] * n[4] * n[6] == 0
            second = n[0] * n[2] * n[6] == 0 and n[0] * n[4] * n[6] == 0
            if 2 <= sum(n) <= 6 and turns == 1 and (first if step % 2 == 0 else second):
                out.append((y, x))
        for p in out:
            a[p] = False
        quiet = quiet + 1 if not out else 0
        step += 1
    return a[1:-1, 1:-1]


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(1)
    ring = np.zeros((16, 18))
    ring[2:14, 2:15] = 255
    ring[6:9, 6:10] = 0
    return [(rng.random((12, 12)) > 0.35) * 255.0, ring, np.zeros((5, 5))]


def test_skeletons(spark, shapes):
    masks = raster(spark, shapes)
    out, length = X.skeletonize(masks)
    got = {(r["raster_id"], r["y"], r["x"]): r["v"] for r in out.collect()}
    want = [thin(a) for a in shapes]
    assert got == {(r, y, x): 255.0 * w[y, x] for r, w in enumerate(want) for y in range(w.shape[0]) for x in range(w.shape[1])}
    assert {r["raster_id"]: r["length_px"] for r in length.collect()} == {r: int(w.sum()) for r, w in enumerate(want)}
    pixels, stats = X.skeleton(masks)
    near = lambda w, y, x: sum(w[y + dy, x + dx] for dy, dx in RING if 0 <= y + dy < w.shape[0] and 0 <= x + dx < w.shape[1])
    for r in stats.collect():
        w, a = want[r["raster_id"]], shapes[r["raster_id"]]
        away = lambda y, x, a=a: min(math.hypot(y - p, x - q) for p, q in zip(*np.nonzero(a == 0), strict=True))
        places = list(zip(*np.nonzero(w), strict=True))
        assert r["branch_count"] == sum(near(w, y, x) >= 3 for y, x in places) and abs(r["max_radius"] - max(away(y, x) for y, x in places)) < 1e-9


def test_spaced_is_the_greedy_choice(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, i, float(rng.integers(0, 30)), float(rng.integers(0, 30)), float(rng.integers(0, 6))) for i in range(120)]
    got = {r["id"] for r in X.spaced(spark.createDataFrame(rows, "raster_id long, id long, y double, x double, strength double"), 5.0).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(r[0] != k[0] or math.hypot(r[2] - k[2], r[3] - k[3]) >= 5 for k in kept):
            kept.append(r)
    assert got == {r[1] for r in kept}
    assert X.spaced(spark.createDataFrame([], "raster_id long, id long, y double, x double, strength double"), 5.0).count() == 0


def test_circles_and_homographies_are_found(spark):
    y, x = np.mgrid[0:32, 0:32]
    disc = np.where((y - 15) ** 2 + (x - 14) ** 2 <= 64, 220.0, 20.0)
    best = X.hough_circles(raster(spark, [disc]), 5, 10, 12, 6, 100, 300).orderBy(F.desc("votes")).first()
    assert abs(best["cy"] - 15) <= 1 and abs(best["cx"] - 14) <= 1 and abs(best["radius"] - 8) <= 1
    rng = np.random.default_rng(4)
    h = np.array([[1.2, 0.1, 5], [-0.2, 0.9, 3], [0.001, 0.002, 1]])
    rows = []
    for i in range(60):
        p = rng.uniform(0, 100, 2)
        q = h @ [*p, 1]
        q = q[:2] / q[2] + (rng.uniform(30, 60, 2) if i % 5 == 0 else 0)
        rows.append((1, i, *map(float, p), *map(float, q)))
    models, marked = X.ransac_matches(spark.createDataFrame(rows, "pair long, match_id long, x1 double, y1 double, x2 double, y2 double"), ["pair"], 0.5, 100)
    found = models.first()
    assert found["inliers"] == 48 and np.allclose(np.array(found["h"]).reshape(3, 3), h, atol=1e-4)
    assert {r["match_id"] for r in marked.where("not inlier").collect()} == set(range(0, 60, 5))


def test_watershed_floods_by_grey_level(spark):
    """Two basins with a wall between them: each takes its side however near the other's marker is, and a pixel far along a channel is reached."""
    a = np.full((6, 44), 10.0)
    a[:, 12] = 200
    a[2:4, 20:] = 20
    marks = np.zeros_like(a)
    marks[3, 10], marks[3, 40] = 1, 2
    labels = raster(spark, [marks]).selectExpr("raster_id", "y", "x", "cast(v as int) as label")
    got = L.watershed(labels, raster(spark, [np.full_like(a, 255.0)]), raster(spark, [a]))
    out = np.zeros(a.shape, int)
    for r in got.collect():
        out[r["y"], r["x"]] = r["label"]
    assert (out[:, :12] == 1).all() and (out[:, 13:] == 2).all()


def test_contours_follow_the_border(spark, shapes):
    c = np.zeros((9, 9))
    c[1:8, 1:8] = 255
    c[3:6, 3:8] = 0  # concave
    for r in L.find_contours(raster(spark, [c, *shapes])).collect():
        p = [(q["y"], q["x"]) for q in r["pts"]]
        if len(p) > 1:
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(p, p[1:] + p[:1], strict=True))
        if r["raster_id"] == 0:
            border = {(y, x) for y, x in zip(*np.nonzero(c), strict=True) if any(not (0 <= y + dy < 9 and 0 <= x + dx < 9) or c[y + dy, x + dx] == 0 for dy, dx in RING[::2])}
            assert border <= set(p)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_nearest_over_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(M, "NEAR_BLOCK", 40)
    rng = np.random.default_rng(6)
    v = rng.integers(0, 5, (150, 3)).astype(float)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "q long, v array<double>")
    got = {}
    for r in M.nearest(rows, rows.withColumnRenamed("q", "t"), 4, metric, others=True).orderBy("q", "r").collect():
        got.setdefault(r["q"], []).append(r["t"])
    d = np.abs(v[:, None] - v[None])
    d = {"euclidean": np.sqrt((d * d).sum(2)), "manhattan": d.sum(2), "chebyshev": d.max(2)}[metric]
    assert got == {i: [j for _, j in sorted((d[i, j], j) for j in range(150) if j != i)[:4]] for i in range(150)}


def test_approx_poly_keeps_the_corners(spark):
    a = np.zeros((24, 30))
    a[3:20, 4:26] = 255
    c = L.find_contours(raster(spark, [a]))
    pts = X.approx_poly(c, 2.0).first()["pts"]
    assert {(p["y"], p["x"]) for p in pts} == {(3, 4), (3, 25), (19, 25), (19, 4)}
    n = len(c.first()["pts"])
    assert len(X.approx_poly(c, 0.0).first()["pts"]) == 4 and n == 2 * (16 + 21)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_close_is_the_plain_choice_among_copies(monkeypatch, metric):
    """Near, equal and far off pairs; most of them are never measured one by one."""
    rng = np.random.default_rng(8)
    t = rng.integers(0, 2, (200, 8)).astype(float) if metric == "manhattan" else np.concatenate([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(5, 8)), 10, axis=0) + 1e6])
    q, far = t[::3], M._far(t[::3], t, metric)
    far[np.arange(len(q)), np.arange(0, 200, 3)] = np.inf
    want = np.argsort(far, axis=1, kind="stable")[:, :4]
    monkeypatch.setattr(M, "_far", None)
    a, b, d = M._close(q, t, 4, metric, np.stack([np.arange(len(q)), np.arange(0, 200, 3)], 1))
    assert (b.reshape(-1, 4) == want).all() and (d.reshape(-1, 4) == np.take_along_axis(far, want, axis=1)).all()


@pytest.mark.parametrize(("scale", "middle"), [(1, 0), (1e-3, 100), (1e25, 0)])
def test_candidates_hold_the_nearest_and_little_else(scale, middle):
    """One product of single-precision matrices leaves out no pair that is among the nearest, far from the origin too."""
    rng = np.random.default_rng(3)
    t, q = (rng.normal(size=(n, 6)) * scale + middle for n in (700, 50))
    t[300:400] = t[:100]
    a, b = M._candidates(q, t, 5, None, np.float32)
    far = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    want = {(i, int(j)) for i in range(50) for j in np.argsort(far[i], kind="stable")[:5]}
    assert want <= set(zip(a.tolist(), b.tolist(), strict=True)) and (scale > 1e20 or len(a) < 50 * 60)
    rows, cols, d = M._close(q, t, 5, "euclidean")
    assert want == set(zip(rows.tolist(), cols.tolist(), strict=True)) and np.allclose(d, far[rows, cols])


def test_every_vector_is_matched(spark):
    """Not those alone whose id is divisible by 50."""
    from meristem import catalog

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.array([r["embedding"] for r in e], float), [r["vec_id"] for r in e]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) + np.diag(np.full(len(v), np.inf))
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    want = {(ids[i], ids[a]) for i, (a, b) in enumerate(order) if d[i, a] < 0.9 * d[i, b]}
    got = {(r["q"], r["t"]) for r in catalog.queries()["feat_matcher"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(q % 50 for q, _ in want)


def test_tiles_give_the_nearest_of_all(monkeypatch):
    """Rows in falling distance, so that each tile's are nearer than all before, copies among them, and pairs that are apart."""
    monkeypatch.setattr(M, "TILE", 50)
    rng = np.random.default_rng(9)
    t = rng.normal(size=(430, 4))
    t = t[np.argsort(-(t**2).sum(1))]
    t[400:430] = t[300:330]
    q = np.concatenate([t[::4] * 0.1, t[::7]])
    apart = np.array([(i, j) for i in range(len(q)) for j in rng.choice(430, 3, replace=False)])
    far = M._far(q, t, "euclidean")
    far[apart[:, 0], apart[:, 1]] = np.inf
    want = np.argsort(far, axis=1, kind="stable")[:, :3]
    a, b, d = M._close(q, t, 3, "euclidean", apart)
    assert (a == np.repeat(np.arange(len(q)), 3)).all() and (b.reshape(-1, 3) == want).all() and (d.reshape(-1, 3) == np.take_along_axis(far, want, axis=1)).all()
