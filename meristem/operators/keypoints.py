"""Keypoints with descriptors: scale-space extrema with gradient histograms, and corners with binary tests; matching of binary descriptors.

Rasters go through tiles (tiles.py), so a keypoint is found in the one tile in whose core it lies, from
all that it depends on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import cut
from .features import CIRCLE
from .learning import nearest
from .tiles import Tile, by_tiles, widened

LEVELS, SIGMA, BEFORE = 3, 1.6, 0.5  # levels of an octave that are searched, blur of its first one, and of the raster itself
WIDTH, BINS = 4, 8  # cells along a side of a gradient descriptor, and directions of each
REACH = 15  # of binary tests and moments around a corner
PATTERN = 256


def kernel(sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian; rows and columns beyond the border are its own, mirrored without the last."""
    w = kernel(sigma)
    r = len(w) // 2
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.abs(np.arange(-r, n + r))
        period = max(1, 2 * (n - 1))
        at = at % period
        at = np.where(at >= n, period - at, at)
        wide = np.take(a, at, axis=axis)
        a = sum(w[k] * np.take(wide, np.arange(k, k + n), axis=axis) for k in range(len(w)))
    return a


def _steps() -> list[float]:
    """What each level of an octave is blurred by, from the one before."""
    k = 2 ** (1 / LEVELS)
    return [SIGMA * k ** (i - 1) * math.sqrt(k * k - 1) for i in range(1, LEVELS + 3)]


def sift_halo(octaves: int) -> int:
    """What a keypoint can depend on, in pixels: blurs of its octave and of those before, and the descriptor's window; a multiple of the last octave's pixel."""
    radius = lambda s: max(1, math.ceil(3 * s))
    blur = [radius(s) for s in _steps()]
    before = radius(math.sqrt(SIGMA**2 - BEFORE**2))
    for o in range(octaves - 1):
        before += sum(blur[:LEVELS]) << o
    window = math.ceil(3 * SIGMA * 2 ** ((LEVELS + 0.5) / LEVELS) * math.sqrt(2) * (WIDTH + 1) / 2) + 4
    last = 1 << (octaves - 1)
    return -(-(before + (sum(blur) + window + 2) * last) // last) * last


def scale_space(a: np.ndarray, octaves: int) -> list[list[np.ndarray]]:
    base, out = blurred(a, math.sqrt(SIGMA**2 - BEFORE**2)), []
    for _ in range(octaves):
        if min(base.shape) < 4:
            break
        level = [base]
        for s in _steps():
            level.append(blurred(level[-1], s))
        out.append(level)
        base = level[LEVELS][::2, ::2]
    return out


def extrema(d: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, y, x) over the threshold that no one of their 26 neighbours exceeds, border left out."""
    c = d[1:-1, 1:-1, 1:-1]
    high, low = np.abs(c) > threshold, np.abs(c) > threshold
    high, low = high & (c > 0), low & (c < 0)
    for i in range(3):
        for j in range(3):
            for k in range(3):
                n = d[i : i + c.shape[0], j : j + c.shape[1], k : k + c.shape[2]]
                high, low = high & (c >= n), low & (c <= n)
    return tuple(x + 1 for x in np.nonzero(high | low))


def refined(d: np.ndarray, s: np.ndarray, y: np.ndarray, x: np.ndarray, contrast: float, edge: float) -> tuple[np.ndarray, ...]:
    """(level, y, x, their offsets and value) of extrema moved to where a quadratic has its own, at most five times; weak ones and those on edges go."""
    done = []
    for _ in range(5):
        if not len(s):
            break
        at = lambda i, j, k: d[s + i, y + j, x + k]  # noqa: B023, E731
        c = at(0, 0, 0)
        g = np.stack([at(1, 0, 0) - at(-1, 0, 0), at(0, 1, 0) - at(0, -1, 0), at(0, 0, 1) - at(0, 0, -1)], 1) / 2
        ss, yy, xx = at(1, 0, 0) + at(-1, 0, 0) - 2 * c, at(0, 1, 0) + at(0, -1, 0) - 2 * c, at(0, 0, 1) + at(0, 0, -1) - 2 * c
        sy, sx, yx = ((at(*p) + at(*[-v for v in p]) - at(*q) - at(*[-v for v in q])) / 4 for p, q in (((1, 1, 0), (1, -1, 0)), ((1, 0, 1), (1, 0, -1)), ((0, 1, 1), (0, 1, -1))))
        h = np.stack([np.stack([ss, sy, sx], 1), np.stack([sy, yy, yx], 1), np.stack([sx, yx, xx], 1)], 1)
        solid = np.abs(np.linalg.det(h)) > 1e-12
        off = np.zeros_like(g)
        off[solid] = -np.linalg.solve(h[solid], g[solid][..., None])[..., 0]
        settled = solid & (np.abs(off) < 0.5).all(1)
        value = c + 0.5 * (g * off).sum(1)
        det = yy * xx - yx * yx
        good = settled & (np.abs(value) * LEVELS >= contrast) & (det > 0) & ((yy + xx) ** 2 * edge < (edge + 1) ** 2 * det)
        done.append((s[good], y[good], x[good], off[good], value[good]))
        more = solid & ~settled & (np.abs(off) < 1e6).all(1)
        move = np.rint(off[more]).astype(np.int64)
        s, y, x = s[more] + move[:, 0], y[more] + move[:, 1], x[more] + move[:, 2]
        inside = (s >= 1) & (s < d.shape[0] - 1) & (y >= 1) & (y < d.shape[1] - 1) & (x >= 1) & (x < d.shape[2] - 1)
        s, y, x = s[inside], y[inside], x[inside]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0)
    found = [np.concatenate(c) for c in zip(*done, strict=True)]
    _, first = np.unique(np.stack(found[:3]), axis=1, return_index=True)  # several may have moved to one place
    return tuple(c[first] for c in found)


def _gradient(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and direction (radians, y downwards) of central differences at inner places."""
    dy, dx = a[y + 1, x] - a[y - 1, x], a[y, x + 1] - a[y, x - 1]
    return np.hypot(dy, dx), np.arctan2(dy, dx) % (2 * math.pi)


def _window(shape: tuple[int, int], y: int, x: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    ys, xs = np.arange(max(1, y - r), min(shape[0] - 1, y + r + 1)), np.arange(max(1, x - r), min(shape[1] - 1, x + r + 1))
    return tuple(g.ravel() for g in np.meshgrid(ys, xs, indexing="ij"))


def orientations(a: np.ndarray, y: int, x: int, sigma: float) -> list[float]:
    """Main directions around a place, from a smoothed histogram of 36: the largest peak and those of 0.8 of it or more."""
    ys, xs = _window(a.shape, y, x, round(4.5 * sigma))
    size, angle = _gradient(a, ys, xs)
    weight = size * np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * (1.5 * sigma) ** 2))
    h = np.bincount(np.rint(angle * 36 / (2 * math.pi)).astype(np.int64) % 36, weight, 36)
    h = (6 * h + 4 * (np.roll(h, 1) + np.roll(h, -1)) + np.roll(h, 2) + np.roll(h, -2)) / 16
    before, after = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > before) & (h > after) & (h >= 0.8 * h.max()))
    return [float((p + 0.5 * (before[p] - after[p]) / (before[p] - 2 * h[p] + after[p])) % 36 * 2 * math.pi / 36) for p in peaks]


def gradient_descriptor(a: np.ndarray, y: float, x: float, sigma: float, turn: float) -> np.ndarray:
    """WIDTH x WIDTH x BINS gradient histograms in a window turned upright, each gradient dealt to the cells and directions around it; normalised, cut at 0.2, as whole numbers up to 255."""
    cell = 3 * sigma
    ys, xs = _window(a.shape, round(y), round(x), round(cell * math.sqrt(2) * (WIDTH + 1) / 2))
    size, angle = _gradient(a, ys, xs)
    dy, dx = (ys - y) / cell, (xs - x) / cell
    u, v = math.cos(turn) * dx + math.sin(turn) * dy, -math.sin(turn) * dx + math.cos(turn) * dy
    weight = size * np.exp(-(u * u + v * v) / (0.5 * WIDTH**2))
    row, column, direction = v + WIDTH / 2 - 0.5, u + WIDTH / 2 - 0.5, ((angle - turn) % (2 * math.pi)) * BINS / (2 * math.pi)
    out = np.zeros((WIDTH + 2, WIDTH + 2, BINS))
    inside = (row > -1) & (row < WIDTH) & (column > -1) & (column < WIDTH)
    row, column, direction, weight = row[inside], column[inside], direction[inside], weight[inside]
    i, j, k = (np.floor(c).astype(np.int64) for c in (row, column, direction))
    for di in (0, 1):
        for dj in (0, 1):
            for dk in (0, 1):
                share = np.abs(1 - di - (row - i)) * np.abs(1 - dj - (column - j)) * np.abs(1 - dk - (direction - k))
                np.add.at(out, (i + di + 1, j + dj + 1, (k + dk) % BINS), weight * share)
    d = out[1:-1, 1:-1].ravel()
    d = np.minimum(d, 0.2 * np.sqrt((d * d).sum()))
    return np.clip(np.rint(512 * d / max(np.sqrt((d * d).sum()), 1e-12)), 0, 255).astype(np.int32)


def scale_keypoints(tile: Tile, octaves: int, contrast: float, edge: float) -> dict:
    """What feat_sift finds in a tile's core."""
    rows: list[tuple] = []
    descriptors: list[np.ndarray] = []
    for o, levels in enumerate(scale_space(tile.planes["v"], octaves)):
        d = np.diff(np.stack(levels), axis=0)
        if min(d.shape[1:]) < 3:
            continue
        for s, y, x, off, value in zip(*refined(d, *extrema(d, 0.5 * contrast / LEVELS), contrast, edge), strict=True):
            at = tile.y0 + (y + off[1]) * 2**o, tile.x0 + (x + off[2]) * 2**o
            if not tile.in_core(at[0], at[1]):
                continue
            sigma = SIGMA * 2 ** ((s + off[0]) / LEVELS)
            for turn in orientations(levels[s], int(y), int(x), sigma):
                rows.append((*at, sigma * 2**o, math.degrees(turn), abs(value)))
                descriptors.append(gradient_descriptor(levels[s], y + off[1], x + off[2], sigma, turn))
    columns = np.array(rows, float).reshape(-1, 5).T
    return {**dict(zip(("y", "x", "scale", "angle", "response"), columns, strict=True)), "d": pa.array([d.tolist() for d in descriptors], pa.list_(pa.int32()))}


def strongest(found: DataFrame, n: int | None, by: list[str]) -> DataFrame:
    if not n:
        return found
    w = Window.partitionBy(*by).orderBy(F.desc("response"), "y", "x", "angle")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


@operator("feat_sift")
def sift(df: DataFrame, n_features: int | None = None, octaves: int = 3, contrast: float = 0.04, edge: float = 10, tile: int = 1024) -> DataFrame:
    """(raster_id, y, x, scale, angle, response, d) of grey rasters (raster_id, y, x, v in 0..255): extrema of the differences of Gaussian levels over space and scale, with 128 numbers each.

    A place with several main directions is a keypoint for each. n_features keeps the strongest of each raster. Rasters without such places have no rows.
    """
    if tile % (1 << (octaves - 1)):
        raise ValueError("a tile's side has to be a multiple of the last octave's pixel")
    schema = "y double, x double, scale double, angle double, response double, d array<int>"
    halo = sift_halo(octaves)
    return strongest(by_tiles(df, ["v"], lambda t: scale_keypoints(t, octaves, contrast * 255, edge), schema, widened(tile, halo), halo, within=True), n_features, ["raster_id"])


# Corners with binary descriptors


def pattern(seed: int = 1) -> np.ndarray:
    """PATTERN pairs of places (y, x, y, x), normally spread around the corner and within REACH of it."""
    rng = np.random.default_rng(seed)
    points = rng.normal(0, (2 * REACH + 1) / 5, (16 * PATTERN, 2))
    points = points[np.hypot(*points.T) <= REACH - 1][: 2 * PATTERN]
    return points.reshape(PATTERN, 4)


def sampled(a: np.ndarray, scale: float, start: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """A smaller raster, each of whose pixels is between four of a, and its first pixel's place; start is a's place in the raster, to which the pixels are aligned."""
    out, first = blurred(a, 0.5 * math.sqrt(scale * scale - 1)) if scale > 1 else a, []
    for axis in (0, 1):
        lo, n = start[axis], out.shape[axis]
        i = np.arange(math.ceil((lo + 0.5) / scale - 0.5), math.floor((lo + n - 0.5) / scale - 0.5) + 1)
        p = (i + 0.5) * scale - 0.5 - lo
        k = np.clip(np.floor(p).astype(np.int64), 0, max(0, n - 2))
        t = np.expand_dims(p - k, 1 - axis)
        out = (1 - t) * np.take(out, k, axis=axis) + t * np.take(out, np.minimum(k + 1, n - 1), axis=axis)
        first.append(int(i[0]) if len(i) else 0)
    return out, (first[0], first[1])


def corners(a: np.ndarray, threshold: float) -> np.ndarray:
    """Where nine neighbouring pixels of the circle are all brighter, or all darker, by more than the threshold; border of 3 left out."""
    h, w = a.shape
    out = np.zeros((h, w), bool)
    if min(h, w) < 7:
        return out
    c = a[3:-3, 3:-3]
    ring = np.stack([a[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dy, dx in CIRCLE])
    for over in (ring > c + threshold, ring < c - threshold):
        wide = np.concatenate([over, over[:8]])
        out[3:-3, 3:-3] |= np.any([wide[i : i + 9].all(0) for i in range(16)], axis=0)
    return out


def harris(a: np.ndarray, k: float = 0.04, block: int = 7) -> np.ndarray:
    """det - k trace^2 of the gradients' products, summed over a block; 0 where the block leaves the array."""
    out = np.zeros_like(a)
    r = block // 2 + 1
    if min(a.shape) < 2 * r + 1:
        return out
    p = a[:-2] + 2 * a[1:-1] + a[2:]
    dx = (p[:, 2:] - p[:, :-2]) / 8
    p = a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
    dy = (p[2:] - p[:-2]) / 8

    def boxed(m: np.ndarray) -> np.ndarray:
        n = block
        m = sum(m[i : m.shape[0] - n + 1 + i] for i in range(n))
        return sum(m[:, i : m.shape[1] - n + 1 + i] for i in range(n))

    xx, yy, xy = boxed(dx * dx), boxed(dy * dy), boxed(dx * dy)
    out[r:-r, r:-r] = (xx * yy - xy * xy - k * (xx + yy) ** 2) / block**2
    return out


def turned(a: np.ndarray, y: int, x: int) -> float:
    """The direction from a corner to the centre of grey within REACH."""
    g = np.arange(-REACH, REACH + 1)
    disc = g[:, None] ** 2 + g[None] ** 2 <= REACH**2
    part = a[y - REACH : y + REACH + 1, x - REACH : x + REACH + 1] * disc
    return math.atan2(float((part * g[:, None]).sum()), float((part * g[None]).sum()))


def binary_descriptor(smooth: np.ndarray, y: int, x: int, turn: float, tests: np.ndarray) -> np.ndarray:
    """PATTERN bits, 64 in a long: whether the first of two places, turned with the corner, is darker than the second."""
    c, s = math.cos(turn), math.sin(turn)
    ys, xs = tests[:, [0, 2]], tests[:, [1, 3]]
    v = smooth[y + np.rint(s * xs + c * ys).astype(np.int64), x + np.rint(c * xs - s * ys).astype(np.int64)]
    return np.packbits(v[:, 0] < v[:, 1], bitorder="little").view(np.int64)


def binary_keypoints(tile: Tile, levels: int, factor: float, threshold: float) -> dict:
    """What feat_orb finds in a tile's core."""
    rows: list[tuple] = []
    bits: list[np.ndarray] = []
    tests, margin = pattern(), REACH + 1
    for level in range(levels):
        scale = factor**level
        a, (y0, x0) = sampled(tile.planes["v"], scale, (tile.y0, tile.x0))
        if min(a.shape) <= 2 * margin:
            break
        strength = np.where(corners(a, threshold), harris(a), -np.inf)
        c = strength[1:-1, 1:-1]
        peak = np.isfinite(c)
        for i in range(3):
            for j in range(3):
                n = strength[i : i + c.shape[0], j : j + c.shape[1]]
                peak &= c > n if 3 * i + j < 4 else c >= n if (i, j) != (1, 1) else True
        smooth = blurred(a, 2.0)
        for y, x in np.argwhere(peak) + 1:
            at = (y + y0 + 0.5) * scale - 0.5, (x + x0 + 0.5) * scale - 0.5
            if min(y, x) < margin or y >= a.shape[0] - margin or x >= a.shape[1] - margin or not tile.in_core(*at):
                continue
            turn = turned(a, y, x)
            rows.append((*at, level, (2 * REACH + 1) * scale, math.degrees(turn) % 360, strength[y, x]))
            bits.append(binary_descriptor(smooth, y, x, turn, tests))
    y, x, level, size, angle, response = np.array(rows, float).reshape(-1, 6).T
    return {"y": y, "x": x, "level": level.astype(np.int32), "size": size, "angle": angle, "response": response, "d": pa.array([b.tolist() for b in bits], pa.list_(pa.int64()))}


@operator("feat_orb")
def orb(df: DataFrame, n_features: int = 500, scale_factor: float = 1.2, n_levels: int = 8, threshold: float = 20, tile: int = 1024) -> DataFrame:
    """(raster_id, y, x, level, size, angle, response, d) of grey rasters (raster_id, y, x, v): corners of a pyramid by their ring of 16 pixels, ranked by the Harris measure, with 256 bits of turned tests each (four longs).

    A level keeps its share of n_features in each raster, by its area's side. Corners nearer to the border than the tests reach are left out.
    """
    halo = math.ceil((REACH + 12) * scale_factor ** (n_levels - 1)) + 8
    schema = "y double, x double, level int, size double, angle double, response double, d array<bigint>"
    found = by_tiles(df, ["v"], lambda t: binary_keypoints(t, n_levels, scale_factor, threshold), schema, widened(tile, halo), halo, within=True)
    sides = [scale_factor**-i for i in range(n_levels)]
    quota = F.array(*[F.lit(max(1, round(n_features * s / sum(sides)))) for s in sides])
    w = Window.partitionBy("raster_id", "level").orderBy(F.desc("response"), "y", "x")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.element_at(quota, F.col("level") + 1)).drop("_r")


def _chunks(longs: int) -> list[tuple[int, int]]:
    return [(i, 16 * j) for i in range(longs) for j in range(4)]


def hamming(a: Column, b: Column, longs: int) -> Column:
    return sum((F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(longs)), F.lit(0))


def binary_pairs(queries: DataFrame, train: DataFrame, longs: int, others: bool = False) -> tuple[DataFrame, int]:
    """((q, t, dist) of all pairs within a radius, the radius).

    Descriptors are cut into chunks of 16 bits. Of two that differ in 2 * chunks - 1 bits at most, some
    chunk differs in one bit at most; so train's chunks meet the queries' chunks and those one bit away,
    and a pair is kept where its first such chunk meets.
    """
    chunks = _chunks(longs)
    part = lambda d, i, shift: F.shiftrightunsigned(F.element_at(d, i + 1), shift).bitwiseAND(F.lit(0xFFFF))
    held = lambda d: F.array(*[F.struct(F.lit(n).alias("n"), part(d, *c).alias("c")) for n, c in enumerate(chunks)])
    t = train.select("t", F.col("d").alias("_d"), F.explode(held(F.col("d"))).alias("k")).select("t", "_d", "k.*")
    flips = F.array(*[F.lit(f).cast("long") for f in (0, *(1 << b for b in range(16)))])
    q = queries.select("q", "d", F.explode(held(F.col("d"))).alias("k")).select("q", "d", "k.n", F.explode(F.transform(flips, lambda f: F.col("k.c").bitwiseXOR(f))).alias("c"))
    first: Column = F.lit(len(chunks))
    for n in range(len(chunks) - 1, -1, -1):
        first = F.when(F.bit_count(part(F.col("d"), *chunks[n]).bitwiseXOR(part(F.col("_d"), *chunks[n]))) <= 1, F.lit(n)).otherwise(first)
    radius = 2 * len(chunks) - 1
    met = q.join(t, ["n", "c"]).where((F.col("q") != F.col("t")) if others else F.lit(True)).where(F.col("n") == first)
    return met.withColumn("dist", hamming(F.col("d"), F.col("_d"), longs)).where(F.col("dist") <= radius).select("q", "t", "dist"), radius


def match_binary(queries: DataFrame, train: DataFrame, ratio: float = 0.75, others: bool = False, longs: int = 4) -> DataFrame:
    """queries(q, d) and train(t, d), d array<long> of `longs` numbers, to (q, t, d1) whose nearest by differing bits is under ratio times the second nearest; t <> q if others. Of equally near ones the smaller t is the nearest.

    Pairs within the radius of binary_pairs are looked at first. A query whose two nearest, or whose
    answer, lie within it is decided; the others are compared with all of train, in blocks.
    """
    pairs, radius = binary_pairs(queries, train, longs, others)
    best = cut(_two(pairs))
    decided = F.col("d2").isNotNull() | (F.col("d1") < ratio * (radius + 1))
    near = best.where(decided)
    left = queries.join(near.select("q"), "q", "left_anti")
    bits = lambda d: F.flatten(F.transform(d, lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit(1)).cast("double"))))
    rest = nearest(left.select("q", bits(F.col("d")).alias("v")), train.select("t", bits(F.col("d")).alias("v")), 2, "manhattan", others)
    rest = rest.groupBy("q").agg(F.max(F.when(F.col("r") == 1, F.col("t"))).alias("t"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2"))
    sure = near.where(F.col("d1") < ratio * F.coalesce(F.col("d2"), F.lit(radius + 1))).select("q", "t", F.col("d1").cast("double").alias("d1"))
    return sure.unionByName(rest.where(F.col("d1") < ratio * F.col("d2")).select("q", "t", "d1"))


def _two(pairs: DataFrame) -> DataFrame:
    """(q, t, d1, d2): each query's nearest, and the second one's distance, null if there is none. Ranks are cut in partial windows, so a query with many near ones is no large row."""
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "t"))).where("_r <= 2")
    one, two = F.col("_r") == 1, F.col("_r") == 2
    return ranked.groupBy("q").agg(F.max(F.when(one, F.col("t"))).alias("t"), F.max(F.when(one, F.col("dist"))).alias("d1"), F.max(F.when(two, F.col("dist"))).alias("d2"))
