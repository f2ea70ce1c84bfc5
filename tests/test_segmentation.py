"""Contours, cuts, scale bars and foot prints against plain versions on small rasters."""

import collections
import math

import numpy as np
import pytest

from meristem.operators import prints as P
from meristem.operators import segmentation as S

LINES = (((0, -1), (0, 0), (0, 1)), ((-1, 0), (0, 0), (1, 0)), ((-1, -1), (0, 0), (1, 1)), ((-1, 1), (0, 0), (1, -1)))


def raster(spark, arrays, kind="v double"):
    rows = [(r, y, x, float(a[y, x])) for r, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"raster_id long, y int, x int, {kind}").repartition(3)


def grid(df, n, column="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r["raster_id"], {})[r["y"], r["x"]] = r[column]
    return [np.array([[out[i][y, x] for x in range(1 + max(p[1] for p in out[i]))] for y in range(1 + max(p[0] for p in out[i]))]) for i in range(n)]


def at(u, y, x):
    return 0 <= y < len(u) and 0 <= x < len(u[0]) and bool(u[y][x])


def plain_smooth(u, parity):
    def fills(a):
        return [[any(all(at(a, y + i, x + j) for i, j in e) for e in LINES) for x in range(len(a[0]))] for y in range(len(a))]

    def reaches(a):
        return [[all(any(at(a, y + i, x + j) for i, j in e) for e in LINES) for x in range(len(a[0]))] for y in range(len(a))]

    return reaches(fills(u)) if parity % 2 else fills(reaches(u))


def plain_slope(a, y, x, axis):
    n, p = (len(a), y) if axis == 0 else (len(a[0]), x)
    get = lambda k: a[k][x] if axis == 0 else a[y][k]
    return (get(1) - get(0)) if p == 0 else get(n - 1) - get(n - 2) if p == n - 1 else (get(p + 1) - get(p - 1)) / 2


def plain_contour(image, u, method, iterations, smoothing, balloon):
    h, w = len(u), len(u[0])
    if method == "edges":
        g = [[1 / math.sqrt(1 + 100 * math.hypot(plain_slope(image, y, x, 0), plain_slope(image, y, x, 1))) for x in range(w)] for y in range(h)]
        limit = sorted(v for row in g for v in row)[int(h * w * 0.4)]
        limit = limit / balloon if balloon > 0 else limit * -balloon
    for it in range(iterations):
        if method == "regions":
            inside = [image[y][x] for y in range(h) for x in range(w) if u[y][x]]
            outside = [image[y][x] for y in range(h) for x in range(w) if not u[y][x]]
            if not inside or not outside:
                break
            m1, m0 = sum(inside) / len(inside), sum(outside) / len(outside)
        else:
            ball = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            take = any if balloon > 0 else all
            u = [[take(at(u, y + i, x + j) for i, j in ball) if g[y][x] > limit else bool(u[y][x]) for x in range(w)] for y in range(h)]
        f = [[float(v) for v in row] for row in u]
        new = [list(row) for row in u]
        for y in range(h):
            for x in range(w):
                dy, dx = plain_slope(f, y, x, 0), plain_slope(f, y, x, 1)
                force = -(abs(dy) + abs(dx)) * ((image[y][x] - m1) ** 2 - (image[y][x] - m0) ** 2) if method == "regions" else plain_slope(g, y, x, 0) * dy + plain_slope(g, y, x, 1) * dx
                new[y][x] = True if force > 0 else False if force < 0 else u[y][x]
        u = new
        for s in range(smoothing):
            u = plain_smooth(u, it + s)
    return np.array(u) * 255.0


@pytest.mark.parametrize(("method", "balloon"), [("regions", -1.0), ("edges", -1.0), ("edges", 1.0)])
def test_contours_move_as_plain_ones(spark, method, balloon):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:22, :27]
    images = [np.where((y - 11) ** 2 + (x - 13) ** 2 < 49, 200, 60) + rng.integers(0, 20, (22, 27)), np.where(y + x < 18, 10, 150)[:12, :9] + 0, np.full((6, 6), 9)]
    starts = [np.where((y > 3) & (y < 19) & (x > 4) & (x < 22), 255, 0), np.where((y + x) % 5 > 1, 255, 0)[:12, :9], np.full((6, 6), 255)]
    got = grid(S.active_contour(raster(spark, images), raster(spark, starts), method, 5, 1, balloon=balloon, pre_blur=0, tile=8), 3)
    for a, u, g in zip(images, starts, got, strict=True):
        want = plain_contour((a / 255).tolist(), (u > 127).tolist(), method, 5, 1, balloon)
        assert (g == want).all()


def test_a_contour_that_rests_ends_the_rounds(spark, monkeypatch):
    a = np.full((16, 16), 20)
    a[4:12, 5:11] = 220
    puts = []
    real = S.Scratch.put
    monkeypatch.setattr(S.Scratch, "put", lambda self, name, df: (puts.append(name), real(self, name, df))[1])
    got = grid(S.active_contour(raster(spark, [a]), raster(spark, [np.pad(np.full((12, 12), 255), 2)]), iterations=150, pre_blur=0), 1)[0]
    assert puts.count("state") < 15 and (got[5:11, 6:10] == 255).all() and (got[a < 100] == 0).mean() > 0.95


def max_flow(edges, s, t):
    cap = collections.defaultdict(dict)
    for a, b, c in edges:
        cap[a][b] = cap[a].get(b, 0) + c
        cap[b].setdefault(a, 0)
    total = 0
    while True:
        before = {s: None}
        queue = collections.deque([s])
        while queue and t not in before:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 0 and b not in before:
                    before[b] = a
                    queue.append(b)
        if t not in before:
            return total
        path, b = [], t
        while before[b] is not None:
            path.append((before[b], b))
            b = before[b]
        f = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= f
            cap[b][a] += f
        total += f


def test_cuts_are_worth_the_largest_flow(spark, monkeypatch):
    monkeypatch.setattr(S, "PUSHES", 3)
    rng = np.random.default_rng(2)
    rows, edges = [], {}
    for r, (h, w) in enumerate([(7, 9), (12, 4), (1, 6)]):
        edges[r] = []
        for y in range(h):
            for x in range(w):
                v = int(rng.integers(-30, 31))
                caps = [int(rng.integers(0, 12)) * (0 <= y + dy < h and 0 <= x + dx < w) * int(rng.random() < 0.8) for dy, dx in S.NEAR]
                rows.append((r, y, x, float(max(0, v)), float(max(0, -v)), *map(float, caps)))
                edges[r] += [("s", (y, x), max(0, v)), ((y, x), "t", max(0, -v))] + [((y, x), (y + dy, x + dx), c) for (dy, dx), c in zip(S.NEAR, caps, strict=True) if c]
    df = spark.createDataFrame(rows, "raster_id long, y int, x int, " + ", ".join(f"{c} double" for c in S.CAPACITIES))
    side = {(r["raster_id"], r["y"], r["x"]): r["source"] for r in S.min_cut(df, 4).collect()}
    for r, own in edges.items():
        on = lambda n, r=r: n == "s" or (n != "t" and side[(r, *n)])
        assert sum(c for a, b, c in own if on(a) and not on(b)) == max_flow(own, "s", "t") > 0


def test_grabcut_finds_the_object(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:24, :24]
    disc = (y - 12) ** 2 + (x - 11) ** 2 < 40
    colour = lambda on, off: np.clip(np.where(disc, on, off) + rng.normal(0, 12, disc.shape), 0, 255)
    b, g, r = colour(40, 180), colour(160, 90), colour(200, 60)
    rows = [(0, i, j, float(b[i, j]), float(g[i, j]), float(r[i, j])) for i in range(24) for j in range(24)]
    image = spark.createDataFrame(rows, "raster_id long, y int, x int, b double, g double, r double")
    hints = np.where((y > 2) & (y < 22) & (x > 1) & (x < 21), 3, 0)
    hints[12, 11] = 1
    got = grid(S.grabcut(image, raster(spark, [hints]), 2, tile=16), 1)[0]
    assert ((got > 0) == disc).mean() > 0.99 and got[12, 11] == 255 and (got[hints == 0] == 0).all()


def test_scale_bars(spark):
    rng = np.random.default_rng(4)
    bright, dark, none = (rng.integers(90, 110, (80, 120)).astype(float) for _ in range(3))
    bright[60:63, 20:80] = 250
    bright[30:32, 10:45] = 250
    dark = rng.integers(60, 256, (80, 120)).astype(float)  # uneven, so that no rows beside the bar pass for a bright one
    dark[46:56, [4, 50]] = 100  # its ends
    dark[50:52, 5:50] = 5
    got = {r["raster_id"]: r for r in P.scale_bar(raster(spark, [bright, dark, none]), 2.0, "um", fallback_px_per_mm=7.0).collect()}
    assert [got[0][c] for c in ("x", "y", "w", "h", "dark", "px_per_mm")] == [20, 60, 60, 3, False, 60 / 0.002]
    assert [got[1][c] for c in ("x", "y", "w", "h", "dark", "px_per_mm")] == [5, 50, 45, 2, True, 45 / 0.002]
    assert got[2]["length_px"] is None and got[2]["px_per_mm"] == 7.0


def plain_print(m, p, zones):
    def extents(a):
        ys, xs = np.nonzero(a)
        return ys.min(), ys.max(), xs.min(), xs.max()

    y0, y1, x0, x1 = extents(m)
    if x1 - x0 > y1 - y0:
        m, p = np.rot90(m, -1), np.rot90(p, -1)
    y0, y1, x0, x1 = extents(m)
    if int(m.sum(1)[y0 : y1 + 1].argmax()) > (y1 - y0 + 1) / 2:
        m, p = np.rot90(m, 2), np.rot90(p, 2)
    y0, y1, x0, x1 = extents(m)
    fh, fw = max(1, y1 - y0), max(1, x1 - x0)
    bounds = [y0 + i * fh // zones for i in range(zones)] + [y1]
    area = [int(m[bounds[i] : bounds[i + 1], x0:x1].sum()) for i in range(zones)]
    up = lambda v, d: math.floor(v * 10**d + 0.5) / 10**d
    mid = (x0 + x1) // 2
    left, right = int(m[:, x0:mid].sum()), int(m[:, mid:x1].sum())
    ys, xs = np.nonzero(m)
    w = p[ys, xs]
    cx, cy = (math.floor((w * c).sum() / w.sum() + 0.5) for c in (xs, ys))

    def across(i):
        counts = m[bounds[i] : bounds[i + 1], x0:x1].sum(1)
        if not len(counts) or counts.max() <= 0:
            return None
        on = np.flatnonzero(m[bounds[i] + counts.argmax(), x0:x1])
        return int(on.max() - on.min())

    return [up(100 * a / m.sum(), 1) for a in area], up(area[-2] / max(1, area[-3] + area[-2]), 3), up(abs(left - right) / max(left + right, 1), 3), up(100 * (cx - x0) / fw, 1), up(100 * (cy - y0) / fh, 1), across(zones - 3), across(zones - 1)


@pytest.mark.parametrize("zones", [3, 4])
def test_foot_prints(spark, zones):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:40, :24]
    foot = ((y - 12) ** 2 / 90 + (x - 12) ** 2 / 60 < 1) | ((y - 30) ** 2 / 60 + (x - 11) ** 2 / 25 < 1) | ((x > 11) & (x < 15) & (y > 12) & (y < 30))
    masks = [foot, np.rot90(foot), np.rot90(foot, 2), rng.random((9, 13)) < 0.4, np.zeros((4, 4), bool)]
    rows = [(i, a, b, 255.0 * float(m[a, b]), float(10 + (7 * a + 3 * b) % 50)) for i, m in enumerate(masks) for a in range(m.shape[0]) for b in range(m.shape[1])]
    got = {r["raster_id"]: r for r in P.footprint(spark.createDataFrame(rows, "raster_id long, y int, x int, v double, p double"), zones, px_per_mm=2.0).collect()}
    assert set(got) == {0, 1, 2, 3}
    names = (["toes"] if zones == 4 else []) + ["forefoot", "arch", "heel"]
    for i in range(4):
        m = masks[i]
        g = np.array([[10 + (7 * a + 3 * b) % 50 for b in range(m.shape[1])] for a in range(m.shape[0])], float)
        r, want = got[i], plain_print(m.astype(int), g, zones)
        assert ([r[f"{n}_area_pct"] for n in names], r["staheli"], r["asymmetry"], r["centroid_x_pct"], r["centroid_y_pct"], r["forefoot_width_px"], r["heel_width_px"]) == want
    assert got[0]["staheli"] == got[1]["staheli"] == got[2]["staheli"]
