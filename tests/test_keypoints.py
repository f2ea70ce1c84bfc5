"""Keypoints and binary matching against plain versions on small rasters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem.operators import keypoints as N
from meristem.operators import learning as M
from meristem.operators.tiles import Tile, by_tiles


def blobs(seed, h, w, n):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    a = np.full((h, w), 100.0)
    for _ in range(n):
        cy, cx, s, v = rng.uniform(0, h), rng.uniform(0, w), rng.uniform(1.5, 6), rng.uniform(-120, 120)
        a += v * np.exp(-(((y - cy) * rng.uniform(0.7, 1.4)) ** 2 + (x - cx) ** 2) / (2 * s * s))
    return np.clip(np.rint(a + rng.normal(0, 4, a.shape)), 0, 255)


def raster(spark, arrays):
    rows = [(r, y, x, float(a[y, x])) for r, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "raster_id long, y int, x int, v double").repartition(3)


def whole(a):
    return Tile(0, 0, 0, 1 << 20, 0, 1 << 20, {"v": a})


def test_tiles_give_what_the_whole_raster_gives(spark):
    a = blobs(1, 50, 41, 10)

    def local(t):
        b = N.blurred(t.planes["v"], 1.0)
        y, x = np.nonzero(b > -1)
        inside = t.in_core(y + t.y0, x + t.x0)
        return {"py": (y + t.y0)[inside], "px": (x + t.x0)[inside], "b": b[y[inside], x[inside]]}

    got = by_tiles(raster(spark, [a, a[:9, :30]]), ["v"], local, "py long, px long, b double", 16, 4).collect()
    for r, m in enumerate((a, a[:9, :30])):
        want = N.blurred(m, 1.0)
        mine = {(g["py"], g["px"]): g["b"] for g in got if g["raster_id"] == r}
        assert len(mine) == m.size and all(abs(v - want[k]) < 1e-9 for k, v in mine.items())


def test_blur_is_a_convolution_with_mirrored_borders():
    a = blobs(2, 9, 7, 3)
    w = N.kernel(1.3)
    r = len(w) // 2
    mirror = lambda i, n: (lambda k: 2 * (n - 1) - k if k >= n else k)(abs(i) % (2 * (n - 1)))
    want = np.array([[sum(w[i + r] * w[j + r] * a[mirror(y + i, 9), mirror(x + j, 7)] for i in range(-r, r + 1) for j in range(-r, r + 1)) for x in range(7)] for y in range(9)])
    assert np.allclose(N.blurred(a, 1.3), want)


def plain_sift(a, octaves, contrast, edge):
    """Scale-space keypoints by loops over places."""
    out = []
    for o, levels in enumerate(N.scale_space(a, octaves)):
        d = [levels[i + 1] - levels[i] for i in range(len(levels) - 1)]
        found = set()
        for s in range(1, len(d) - 1):
            for y in range(1, a.shape[0] // 2**o - 1 + (a.shape[0] % 2**o > 0)):
                for x in range(1, d[0].shape[1] - 1):
                    if y >= d[0].shape[0] - 1:
                        continue
                    near = [d[s + i][y + j, x + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
                    c = d[s][y, x]
                    if abs(c) <= 0.5 * contrast / N.LEVELS or not (c > 0 and c >= max(near) or c < 0 and c <= min(near)):
                        continue
                    p = np.array([s, y, x])
                    for _ in range(5):
                        at = lambda i, j, k, p=p: d[p[0] + i][p[1] + j, p[2] + k]
                        e = np.eye(3, dtype=int)
                        g = np.array([(at(*e[i]) - at(*-e[i])) / 2 for i in range(3)])
                        h = np.array([[at(*e[i]) + at(*-e[i]) - 2 * at(0, 0, 0) if i == j else (at(*(e[i] + e[j])) + at(*-(e[i] + e[j])) - at(*(e[i] - e[j])) - at(*(e[j] - e[i]))) / 4 for j in range(3)] for i in range(3)])
                        off = -np.linalg.solve(h, g)
                        if (abs(off) < 0.5).all():
                            value, det, trace = at(0, 0, 0) + 0.5 * g @ off, h[1, 1] * h[2, 2] - h[1, 2] ** 2, h[1, 1] + h[2, 2]
                            if abs(value) * N.LEVELS >= contrast and det > 0 and trace**2 / det < (edge + 1) ** 2 / edge:
                                found.add((tuple(p.tolist()), tuple(off), float(value)))
                            break
                        p = p + np.rint(off).astype(int)
                        if not all(1 <= p[i] < n - 1 for i, n in enumerate((len(d), *d[0].shape))):
                            break
        for (s, y, x), off, value in found:
            sigma = N.SIGMA * 2 ** ((s + off[0]) / N.LEVELS)
            for turn in plain_turns(levels[s], y, x, sigma):
                out.append(((y + off[1]) * 2**o, (x + off[2]) * 2**o, sigma * 2**o, math.degrees(turn), abs(value), plain_histograms(levels[s], y + off[1], x + off[2], sigma, turn)))
    return out


def gradients_near(a, y, x, r):
    for p in range(max(1, y - r), min(a.shape[0] - 1, y + r + 1)):
        for q in range(max(1, x - r), min(a.shape[1] - 1, x + r + 1)):
            dy, dx = a[p + 1, q] - a[p - 1, q], a[p, q + 1] - a[p, q - 1]
            yield p, q, math.hypot(dy, dx), math.atan2(dy, dx) % (2 * math.pi)


def plain_turns(a, y, x, sigma):
    h = [0.0] * 36
    for p, q, size, angle in gradients_near(a, y, x, round(4.5 * sigma)):
        h[round(angle * 36 / (2 * math.pi)) % 36] += size * math.exp(-((p - y) ** 2 + (q - x) ** 2) / (2 * (1.5 * sigma) ** 2))
    h = [(6 * h[i] + 4 * (h[i - 1] + h[(i + 1) % 36]) + h[i - 2] + h[(i + 2) % 36]) / 16 for i in range(36)]
    for i in range(36):
        before, after = h[i - 1], h[(i + 1) % 36]
        if h[i] > before and h[i] > after and h[i] >= 0.8 * max(h):
            yield (i + 0.5 * (before - after) / (before - 2 * h[i] + after)) % 36 * 2 * math.pi / 36


def plain_histograms(a, y, x, sigma, turn):
    out = np.zeros((4, 4, 8))
    for p, q, size, angle in gradients_near(a, round(y), round(x), round(3 * sigma * math.sqrt(2) * 2.5)):
        dy, dx = (p - y) / (3 * sigma), (q - x) / (3 * sigma)
        u, v = math.cos(turn) * dx + math.sin(turn) * dy, math.cos(turn) * dy - math.sin(turn) * dx
        for i in range(4):
            for j in range(4):
                share = max(0, 1 - abs(v + 1.5 - i)) * max(0, 1 - abs(u + 1.5 - j))
                if share:
                    k = ((angle - turn) % (2 * math.pi)) * 8 / (2 * math.pi)
                    for b in range(8):
                        away = abs(k - b)
                        out[i, j, b] += size * math.exp(-(u * u + v * v) / 8) * share * max(0, 1 - min(away, 8 - away))
    d = out.ravel()
    d = np.minimum(d, 0.2 * np.linalg.norm(d))
    return np.clip(np.rint(512 * d / np.linalg.norm(d)), 0, 255)


def test_sift_is_the_plain_one_whatever_the_tiles(spark):
    arrays = [blobs(3, 60, 52, 14), blobs(4, 33, 70, 9), np.full((20, 20), 7.0)]
    assert N.sift_halo(2) % 2 == 0
    got = N.sift(raster(spark, arrays), octaves=2, contrast=0.012, tile=16).collect()
    want = [(r, *k) for r, a in enumerate(arrays) for k in plain_sift(a, 2, 0.012 * 255, 10)]
    assert len(got) == len(want) > 10
    got = sorted(got, key=lambda r: (r["raster_id"], r["y"], r["x"], r["angle"]))
    want.sort(key=lambda k: (k[0], k[1], k[2], k[4]))
    for g, w in zip(got, want, strict=True):
        assert g["raster_id"] == w[0] and np.allclose([g["y"], g["x"], g["scale"], g["angle"], g["response"]], w[1:6], atol=1e-6)
        assert len(g["d"]) == 128 and np.abs(np.array(g["d"]) - w[6]).max() <= 1


def test_descriptors_find_a_turned_raster(spark):
    a = blobs(5, 90, 90, 30)
    found = N.sift(raster(spark, [a, np.rot90(a).copy()]), octaves=2, contrast=0.012).withColumn("k", F.monotonically_increasing_id()).cache()
    matches = M.match_descriptors(found.where("raster_id = 0").select(F.col("k").alias("q"), "d"), found.where("raster_id = 1").select(F.col("k").alias("t"), "d"), 0.8).collect()
    at = {r["k"]: (r["y"], r["x"]) for r in found.collect()}
    right = [abs(at[m["t"]][0] - (89 - at[m["q"]][1])) < 1.5 and abs(at[m["t"]][1] - at[m["q"]][0]) < 1.5 for m in matches]
    assert len(right) >= 10 and np.mean(right) > 0.9


def plain_orb(a, levels, factor, threshold):
    out = []
    for level in range(levels):
        scale = factor**level
        b, first = N.sampled(a, scale, (0, 0))
        assert first == (0, 0)
        h, w = b.shape
        strength = {}
        for y in range(3, h - 3):
            for x in range(3, w - 3):
                ring = [b[y + dy, x + dx] - b[y, x] for dy, dx in N.CIRCLE]
                for sign in (1, -1):
                    if any(all(sign * ring[(i + k) % 16] > threshold for k in range(9)) for i in range(16)):
                        strength[y, x] = plain_harris(b, y, x)
        smooth = N.blurred(b, 2.0)
        for (y, x), s in strength.items():
            before = [strength.get((y + i, x + j), -np.inf) for i, j in ((-1, -1), (-1, 0), (-1, 1), (0, -1))]
            after = [strength.get((y + i, x + j), -np.inf) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
            if s > max(before) and s >= max(after) and 16 <= y < h - 16 and 16 <= x < w - 16:
                disc = [(i, j) for i in range(-15, 16) for j in range(-15, 16) if i * i + j * j <= 225]
                turn = math.atan2(sum(i * b[y + i, x + j] for i, j in disc), sum(j * b[y + i, x + j] for i, j in disc))
                c, sn = math.cos(turn), math.sin(turn)
                place = lambda p, q: smooth[y + round(sn * q + c * p), x + round(c * q - sn * p)]  # noqa: B023, E731
                bits = [int(place(p, q) < place(u, v)) for p, q, u, v in N.pattern()]
                out.append((level, (y + 0.5) * scale - 0.5, (x + 0.5) * scale - 0.5, math.degrees(turn) % 360, s, bits))
    return out


def plain_harris(b, y, x):
    xx = yy = xy = 0.0
    for p in range(y - 3, y + 4):
        for q in range(x - 3, x + 4):
            if not (1 <= p < b.shape[0] - 1 and 1 <= q < b.shape[1] - 1):
                return 0.0
            dx = sum(k * (b[p + i, q + 1] - b[p + i, q - 1]) for i, k in ((-1, 1), (0, 2), (1, 1))) / 8
            dy = sum(k * (b[p + 1, q + i] - b[p - 1, q + i]) for i, k in ((-1, 1), (0, 2), (1, 1))) / 8
            xx, yy, xy = xx + dx * dx, yy + dy * dy, xy + dx * dy
    return (xx * yy - xy * xy - 0.04 * (xx + yy) ** 2) / 49


def test_orb_is_the_plain_one_whatever_the_tiles(spark):
    arrays = [np.rint(blobs(6, 64, 60, 25)), blobs(7, 40, 80, 14)]
    arrays[0][20:40, 20:40] = 220
    got = N.orb(raster(spark, arrays), 100000, n_levels=3, threshold=12, tile=24).collect()
    want = [(r, *k) for r, a in enumerate(arrays) for k in plain_orb(a, 3, 1.2, 12)]
    assert len(got) == len(want) > 10
    got = sorted(got, key=lambda r: (r["raster_id"], r["level"], r["y"], r["x"]))
    want.sort(key=lambda k: k[:4])
    for g, w in zip(got, want, strict=True):
        assert (g["raster_id"], g["level"]) == w[:2] and np.allclose([g["y"], g["x"], g["angle"], g["response"]], w[2:6], atol=1e-6)
        bits = [(d >> i) & 1 for d in g["d"] for i in range(64)]
        assert sum(p != q for p, q in zip(bits, w[6], strict=True)) <= 2
    few = N.orb(raster(spark, arrays), 3, n_levels=3, threshold=12).groupBy("raster_id", "level").count().collect()
    assert all(r["count"] <= 2 for r in few)


@pytest.mark.parametrize("others", [False, True])
def test_binary_matches_are_exact(spark, others):
    """Near pairs through the index, the others in blocks: the same as all pairs."""
    rng = np.random.default_rng(8)
    t = rng.integers(-(1 << 62), 1 << 62, (120, 4))
    q = t[rng.integers(0, 120, 150)].copy()
    for i in range(150):
        for b in rng.integers(0, 256, int(rng.integers(0, 60))):
            q[i, b // 64] ^= np.int64(1) << np.int64(b % 64)
    t[5] = t[6]
    tables = [spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], f"{name} long, d array<long>") for x, name in ((q, "q"), (t, "t"))]
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)
    far = (bits(q)[:, None] != bits(t)[None]).sum(2)
    pairs, radius = N.binary_pairs(*tables, 4, others)
    skip = lambda i, j: others and i == j
    assert radius == 31 and {(r["q"], r["t"], r["dist"]) for r in pairs.collect()} == {(i, j, int(far[i, j])) for i in range(150) for j in range(120) if far[i, j] <= 31 and not skip(i, j)}
    assert pairs.count() == pairs.select("q", "t").distinct().count() < 150 * 120 / 20
    want = set()
    for i in range(150):
        best = sorted((int(far[i, j]), j) for j in range(120) if not skip(i, j))
        if best[0][0] < 0.75 * best[1][0]:
            want.add((i, best[0][1], float(best[0][0])))
    assert {tuple(r) for r in N.match_binary(*tables, others=others).collect()} == want and len(want) > 50


def test_tiles_are_not_smaller_than_their_halo(spark, monkeypatch):
    """Tiles of 16 with a halo of well over 100 would have sent a small raster to each of them."""
    used, real = [], N.by_tiles
    monkeypatch.setattr(N, "by_tiles", lambda *a, **k: used.append((*a[-2:], k)) or real(*a, **k))
    rng = np.random.default_rng(8)
    wide = [rng.integers(0, 256, (40, 420)).astype(float)]
    got, whole = (sorted(map(tuple, N.sift(raster(spark, wide), octaves=2, contrast=0.012, tile=t).select("y", "x", "angle").collect())) for t in (16, 1024))
    assert used[0][0] % 16 == 0 and used[0][0] >= used[0][1] and used[1][0] == 1024 and used[0][2] == {"within": True}
    sent = lambda **k: by_tiles(raster(spark, wide), ["v"], lambda t: {"n": np.ones(1, np.int64)}, "n long", 210, 100, **k).count()
    assert sent(within=True) == 2 and sent() == 3
    assert used[0][0] < 420 and len(got) == len(whole) > 0 and np.allclose(got, whole)
