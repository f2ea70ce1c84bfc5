"""Edges, thin lines, Hough and random-sample fits, corners, flow and disparity on (raster_id, y, x, v).

Votes and samples are rows: pixels are exploded to the accumulator cells that they support, which a
partial aggregate counts before anything moves. Samples are drawn by md5 of a seed and their number, so
they are the same on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import Scratch, cut, dealt
from .labels import component_labels, distance_transform, fill_holes, filter_area
from .neighbours import RING, around, spaced
from .pixels import KEY, size_of, threshold_adv, with_raster_stats
from .stencils import box_mean, dilate, gaussian_blur, gradients, morphology, stencil
from .tiles import Stack, by_stacks

#: The circle of 16 pixels at radius 3, clockwise from above.
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


@operator("filter_canny")
def canny(df: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """255 on edges: ridges of the gradient (sum of absolute Sobel differences) over low that touch, through others, one over high."""
    g = gradients(df).withColumn("m", F.abs("dx") + F.abs("dy"))
    d = around(g, "m", RING)
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(8)]
    ax, ay, m = F.abs("dx"), F.abs("dy"), F.col("m")
    flat, steep = ay < ax * math.tan(math.pi / 8), ay > ax * math.tan(3 * math.pi / 8)
    falling = (F.col("dx") >= 0) == (F.col("dy") >= 0)
    ridge = F.when(flat, (m > n[6]) & (m >= n[2])).when(steep, (m > n[0]) & (m >= n[4])).when(falling, (m > n[7]) & (m > n[3])).otherwise((m > n[1]) & (m > n[5]))
    weak = cut(d.where(ridge & (m > low)).select(*KEY, "m", F.lit(255.0).alias("v")))
    labels = component_labels(weak).join(weak, KEY)
    strong = labels.where(F.col("m") > high).select("raster_id", "label").distinct()
    kept = labels.join(strong, ["raster_id", "label"], "leftsemi").select(*KEY, F.lit(255.0).alias("v"))
    return df.select(*KEY).join(kept, KEY, "left").fillna(0.0, ["v"])


def _thin(live: np.ndarray, most: int | None) -> np.ndarray:
    """Two-step thinning of an array, until nothing goes or for most steps."""
    live = np.pad(live, 1)
    quiet, step = 0, 0
    while quiet < 2 and (most is None or step < most):
        n = [live[1 + dy : live.shape[0] - 1 + dy, 1 + dx : live.shape[1] - 1 + dx] for dy, dx in RING]
        count = sum((k.astype(np.int8) for k in n[1:]), n[0].astype(np.int8))
        turns = sum(((~n[i] & n[(i + 1) % 8]).astype(np.int8) for i in range(1, 8)), (~n[0] & n[1]).astype(np.int8))
        a, b = (n[0] & n[2] & n[4], n[2] & n[4] & n[6]) if step % 2 == 0 else (n[0] & n[2] & n[6], n[0] & n[4] & n[6])
        goes = live[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & ~a & ~b
        quiet = 0 if goes.any() else quiet + 1
        live[1:-1, 1:-1] &= ~goes
        step += 1
    return live[1:-1, 1:-1]


def thinned(mask: DataFrame, tile: int = 512, halo: int = 16) -> DataFrame:
    """(raster_id, y, x) of the skeleton by two-step thinning: border pixels whose removal breaks nothing go until none is left.

    A tile whose halo is empty is thinned to its end; the others go as many steps (an even number) as the
    halo is wide in a pass, and passes go on until none of their pixels goes. Lineage is cut each pass.
    """
    kind = {f.name: f.dataType.simpleString() for f in mask.schema}

    def run(t: Stack) -> dict[str, np.ndarray]:
        y, x = np.nonzero(t.planes["v"])
        wider = np.zeros(len(t.rows), bool)  # tiles with pixels in their halo
        wider[t.of(y[~t.in_core(y, x)])] = True
        some = wider[t.of(np.arange(len(t.planes["v"])))][:, None]
        on = t.planes["v"] > 0
        y, x = np.nonzero(_thin(on & ~some, None) | _thin(on & some, halo))
        core = t.in_core(y, x)
        y, x = y[core], x[core]
        return {"row": y, "y": t.y(y), "x": t.x(y, x), "open": wider[t.of(y)]}

    live, before = mask.where("v > 0").select(*KEY), -1
    while True:
        live = cut(by_stacks(live.select(*KEY, F.lit(1.0).alias("v")), ["v"], run, f"y {kind['y']}, x {kind['x']}, open boolean", tile, halo))
        if live.where("open").isEmpty() or (left := live.count()) == before:
            return live.select(*KEY)
        before = left


@operator("cv_skeletonize")
def skeletonize(mask: DataFrame, close_holes: bool = False, min_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mask of the skeleton, length_px per raster); holes may be filled and small components left out before."""
    m = fill_holes(mask) if close_holes else mask
    m = filter_area(m, min_size) if min_size > 0 else m
    line = thinned(m)
    out = mask.select(*KEY).join(line.withColumn("v", F.lit(255.0)), KEY, "left").fillna(0.0, ["v"])
    return out, out.groupBy("raster_id").agg(F.count_if(F.col("v") > 0).alias("length_px"))


@operator("feat_skeleton")
def skeleton(mask: DataFrame, min_radius: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(skeleton pixels with their radius, where it is min_radius or more; branch_count and max_radius per raster). A branch point has three or more skeleton neighbours."""
    line = thinned(mask)
    radius = line.join(distance_transform(mask).withColumnRenamed("v", "radius"), KEY, "left").where(F.coalesce(F.col("radius") >= min_radius, F.lit(True)))
    d = around(cut(radius).withColumn("one", F.lit(1)), "one", RING)
    near = sum((F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(8)), F.lit(0))
    d = d.select(*KEY, "radius", (near >= 3).alias("branch"))
    return d, d.groupBy("raster_id").agg(F.count_if("branch").alias("branch_count"), F.max("radius").alias("max_radius"))


@operator("feat_hough_lines")
def hough_lines(mask: DataFrame, rho: float = 1.0, theta_deg: float = 1.0, threshold: int = 10, min_length: float = 3, max_gap: float = 2) -> DataFrame:
    """(raster_id, theta, rho, votes, x1, y1, x2, y2): segments along the lines that get threshold votes and no fewer than their four neighbours in the accumulator.

    A line's pixels, in the order of their place along it, are cut where the gap is over max_gap.
    """
    t = F.radians(F.col("t") * theta_deg)
    along = F.round(F.col("x") * F.cos(t) + F.col("y") * F.sin(t), 6)
    votes = mask.where("v > 0").select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(math.ceil(180 / theta_deg) - 1))).alias("t"))
    votes = votes.withColumn("r", F.floor(along / rho + 0.5).cast("int"))
    cells = cut(votes.groupBy("raster_id", F.col("t").alias("y"), F.col("r").alias("x")).agg(F.count("*").alias("votes")))
    near = around(cells, "votes", ((0, -1), (-1, 0), (0, 1), (1, 0)))
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(4)]
    peaks = near.where((F.col("votes") >= threshold) & (F.col("votes") > n[0]) & (F.col("votes") > n[1]) & (F.col("votes") >= n[2]) & (F.col("votes") >= n[3]))
    peaks = peaks.select("raster_id", F.col("y").alias("t"), F.col("x").alias("r"), "votes")
    line = Window.partitionBy("raster_id", "t", "r").orderBy("_s", "y", "x")
    d = votes.join(peaks, ["raster_id", "t", "r"]).withColumn("_s", F.round(F.col("y") * F.cos(t) - F.col("x") * F.sin(t), 6))
    d = d.withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(line) > max_gap).cast("int"), F.lit(0))).withColumn("_part", F.sum("_new").over(line))
    first, last = F.min(F.struct("_s", "y", "x")), F.max(F.struct("_s", "y", "x"))
    s = d.groupBy("raster_id", "t", "r", "votes", "_part").agg(first.alias("a"), last.alias("b")).where(F.col("b._s") - F.col("a._s") >= min_length)
    return s.select("raster_id", (F.col("t") * theta_deg).alias("theta"), (F.col("r") * rho).alias("rho"), "votes", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def near_segments(like: DataFrame, segments: DataFrame, thickness: float) -> DataFrame:
    """255 at the pixels of `like` within half the thickness of a segment (x1, y1, x2, y2) of their raster, 0 elsewhere. A segment meets only the rows that it reaches."""
    r = thickness / 2
    rows = F.explode(F.sequence(F.floor(F.least("y1", "y2") - r).cast("int"), F.ceil(F.greatest("y1", "y2") + r).cast("int"))).alias("y")
    d = like.select(*KEY).join(segments.select("raster_id", rows, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), ["raster_id", "y"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    far = F.pow(F.col("x") - F.col("x1") - t * dx, F.lit(2)) + F.pow(F.col("y") - F.col("y1") - t * dy, F.lit(2))
    on = d.where(F.round(far, 9) <= r * r).select(*KEY).distinct()
    return like.select(*KEY).join(on.withColumn("v", F.lit(255.0)), KEY, "left").fillna(0.0, ["v"])


@operator("filter_linearity")
def linearity(gray: DataFrame, min_length: float = 25, threshold: int = 50, thickness: float = 3, theta_deg: float = 1.0) -> DataFrame:
    """Mask of the straight segments of what Otsu's level finds dark, drawn with a thickness. Gaps up to half of min_length are bridged."""
    dark = threshold_adv(gray, "otsu_inv").select(*KEY, "v")
    return near_segments(gray, hough_lines(dark, 1.0, theta_deg, threshold, min_length, min_length / 2), thickness)


@operator("filter_linear_direction")
def linear_direction(gray: DataFrame, angle: float = 0.0, tolerance: float = 10, min_length: float = 20, extend: float = 0.0, thickness: float = 5, remove: bool = True, threshold: int = 30, theta_deg: float = 1.0) -> DataFrame:
    """Segments of what Otsu's level finds bright whose direction is within the tolerance of an angle in degrees, made longer at both ends: taken out of that mask, or alone."""
    bright = cut(threshold_adv(gray, "otsu").select(*KEY, "v"))
    s = hough_lines(bright, 1.0, theta_deg, threshold, min_length, min_length / 2)
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    off = F.abs(F.pmod(F.round(F.degrees(F.atan2(dy, dx)), 6), F.lit(180.0)) - angle)
    s = s.where(F.least(off, 180 - off) <= tolerance).withColumn("_ex", dx / F.hypot(dx, dy) * extend).withColumn("_ey", dy / F.hypot(dx, dy) * extend)
    at = lambda c, e: F.floor(F.round(F.col(c) + e, 6) + 0.5).alias(c)
    s = s.select("raster_id", at("x1", -F.col("_ex")), at("y1", -F.col("_ey")), at("x2", F.col("_ex")), at("y2", F.col("_ey")))
    lines = near_segments(gray, s, thickness)
    if not remove:
        return lines
    return bright.join(lines.withColumnRenamed("v", "_l"), KEY).select(*KEY, F.greatest(F.lit(0.0), F.col("v") - F.col("_l")).alias("v"))


def _simplified(points: list[tuple[float, float]], epsilon: float, closed: bool) -> list[int]:
    """Places of the points that stay when runs within epsilon of their chord are dropped."""
    n = len(points)
    p = np.array(points, float)
    if n < 3:
        return list(range(n))
    half = int(((p - p[0]) ** 2).sum(1).argmax()) if closed else n - 1
    ring = np.vstack([p, p[:1]]) if closed else p
    kept, todo = {0, half}, [(0, half), (half, n)] if closed else [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = math.hypot(*chord)
        far = np.abs(rest[:, 0] * chord[1] - rest[:, 1] * chord[0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        i = int(far.argmax())
        if far[i] > epsilon:
            kept.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return sorted(kept)


@operator("geom_approx_poly")
def approx_poly(contours: DataFrame, epsilon_pct: float = 2.0, closed: bool = True) -> DataFrame:
    """contours(..., pts array<struct<x, y>>) with pts simplified: corners stay that stand off the chord by more than a share of the perimeter (in percent). A contour is one row, and is worked on where it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pts in batch["pts"]:
                p = [(float(q["x"]), float(q["y"])) for q in (pts if pts is not None else [])]
                around_ = sum(math.dist(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True))
                out.append([pts[i] for i in _simplified(p, epsilon_pct / 100 * around_, closed)])
            batch["pts"] = out
            yield batch

    return contours.mapInPandas(run, contours.schema)


@operator("feat_hough_circles")
def hough_circles(df: DataFrame, min_radius: int = 2, max_radius: int = 4, threshold: int = 4, min_distance: float = 3, low: float = 50, high: float = 150) -> DataFrame:
    """(raster_id, cy, cx, radius, votes): centres and radii that edge pixels vote for along their gradients, both ways; cells with threshold votes, apart by min_distance, most votes first."""
    edges = canny(df, low, high).where("v > 0").select(*KEY).join(gradients(df), KEY)
    norm = F.hypot("dx", "dy")
    o = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(r * s).alias("s")) for r in range(min_radius, max_radius + 1) for s in (-1, 1)])).alias("o")
    e = edges.where(norm > 0).select(*KEY, (F.col("dy") / norm).alias("uy"), (F.col("dx") / norm).alias("ux"), o)
    at = lambda c, u: F.floor(F.round(F.col(c) + F.col("o.s") * F.col(u), 6) + 0.5).cast("int")
    votes = e.select("raster_id", at("y", "uy").alias("cy"), at("x", "ux").alias("cx"), F.col("o.r").alias("radius")).groupBy("raster_id", "cy", "cx", "radius").agg(F.count("*").alias("votes"))
    inside = votes.join(size_of(df), "raster_id").where("cy >= 0 and cx >= 0 and cy < h and cx < w").where(F.col("votes") >= threshold)
    named = cut(inside.select("raster_id", F.struct("cy", "cx", "radius").alias("id"), F.col("cy").alias("y"), F.col("cx").alias("x"), F.col("votes").alias("strength")))
    return spaced(named, min_distance).select("raster_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("id.radius").alias("radius"), F.col("strength").alias("votes"))


def drawn(keys: list[str], n: str, size: int, seed: int) -> list[Column]:
    """Places (from 0) of a sample's members among n: the md5 of seed, keys, sample and member."""

    def place(i: int) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("i").cast("string"), F.lit(str(i))))
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col(n)).alias(f"p{i}")

    return [place(i) for i in range(size)]


@operator("feat_ransac_line")
def ransac_line(points: DataFrame, threshold: float = 1.0, iterations: int = 50, seed: int = 42) -> DataFrame:
    """points(raster_id, y, x) to (raster_id, angle, inliers, n_points): of the lines through drawn pairs of points the one with most points within the threshold (ties: the earlier draw), its direction in degrees from 0 to 180."""
    p = cut(points.select(*KEY).withColumn("_i", F.row_number().over(Window.partitionBy("raster_id").orderBy("y", "x")) - 1))
    n = p.groupBy("raster_id").agg(F.count("*").alias("n_points"))
    d = n.select("raster_id", "n_points", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i"))
    d = d.select("raster_id", "i", *drawn(["raster_id"], "n_points", 2, seed)).where("p0 <> p1")
    end = lambda k: p.select("raster_id", F.col("_i").alias(f"p{k}"), F.col("y").alias(f"y{k}"), F.col("x").alias(f"x{k}"))
    lines = d.join(end(0), ["raster_id", "p0"]).join(end(1), ["raster_id", "p1"]).select("raster_id", "i", "y0", "x0", (F.col("y1") - F.col("y0")).alias("dy"), (F.col("x1") - F.col("x0")).alias("dx"))
    far = F.abs((F.col("x") - F.col("x0")) * F.col("dy") - (F.col("y") - F.col("y0")) * F.col("dx")) / F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    votes = p.join(lines, "raster_id").where(F.round(far, 9) <= threshold).groupBy("raster_id", "i", "dy", "dx").agg(F.count("*").alias("inliers"))
    best = votes.groupBy("raster_id").agg(F.max(F.struct("inliers", -F.col("i"), "dy", "dx")).alias("b"))
    angle = F.pmod(F.round(F.degrees(F.atan2(F.col("b.dy").cast("double"), F.col("b.dx").cast("double"))), 6), F.lit(180.0))
    return best.join(n, "raster_id").select("raster_id", angle.alias("angle"), F.col("b.inliers").alias("inliers"), "n_points")


def _homographies(rows: np.ndarray) -> np.ndarray:
    """For each four rows (x, y, u, v) nine numbers that take the points (x, y) to (u, v), by the null vector of their equations; nan if they are degenerate."""
    x, y, u, v = np.moveaxis(rows, 2, 0)
    one, zero = np.ones_like(x), np.zeros_like(x)
    a = np.stack([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 2), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 2)], 2).reshape(-1, 8, 9)
    _, s, vt = np.linalg.svd(a)
    h = vt[:, -1]
    whole = (s[:, -1] > 1e-9 * s[:, 0]) & (np.abs(h[:, 8]) > 1e-12)
    return np.where(whole[:, None], h / np.where(whole, h[:, 8], 1)[:, None], np.nan)


@operator("cv_ransac")
def ransac_matches(matches: DataFrame, by: list[str], threshold: float = 3.0, iterations: int = 100, min_inliers: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """matches(by..., match_id, x1, y1, x2, y2) to (homography h as nine numbers and inliers per by; matches with inlier).

    Homographies of drawn groups of four matches are tried on all matches of their key; the one with most
    inliers wins (ties: the earlier draw). Keys without min_inliers are left out. Draws are estimated by
    the keys that they are made for, so joins with them are merge joins.
    """
    m = cut(matches.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("match_id")) - 1))
    n = m.groupBy(*by).agg(F.count("*").alias("_n"))
    d = dealt(n, *by).select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i"))
    d = d.select(*by, "i", F.array(*drawn(by, "_n", 4, seed)).alias("p")).where(F.size(F.array_distinct("p")) == 4)
    four = d.select(*by, "i", F.posexplode("p").alias("k", "_i")).join(m.hint("merge"), [*by, "_i"]).groupBy(*by, "i").agg(F.array_sort(F.collect_list(F.struct("k", F.col("x1").cast("double").alias("a"), F.col("y1").cast("double").alias("b"), F.col("x2").cast("double").alias("c"), F.col("y2").cast("double").alias("d")))).alias("q"))
    names = [*by, "i"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _homographies(np.array([[[r["a"], r["b"], r["c"], r["d"]] for r in q] for q in batch["q"]]).reshape(-1, 4, 4))
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(found, columns=h)], axis=1)[np.isfinite(found).all(axis=1)]

    h = [f"_h{i}" for i in range(9)]  # numbers, as an array would make the count of votes sort its rows
    models = four.mapInPandas(solve, ", ".join([four.select(*names).schema.simpleString()[7:-1], *[f"{c} double" for c in h]]))
    w = F.col(h[6]) * F.col("x1") + F.col(h[7]) * F.col("y1") + F.col(h[8])
    off = lambda a, b, c, to: F.try_divide(F.col(h[a]) * F.col("x1") + F.col(h[b]) * F.col("y1") + F.col(h[c]), w) - F.col(to)
    near = F.coalesce(F.hypot(off(0, 1, 2, "x2"), off(3, 4, 5, "y2")) <= threshold, F.lit(False))
    votes = m.hint("merge").join(models, by).groupBy(*by, "i").agg(F.count_if(near).alias("inliers"), *[F.first(c).alias(c) for c in h])
    best = votes.groupBy(*by).agg(F.max(F.struct("inliers", -F.col("i"), *h)).alias("b")).select(*by, F.col("b.inliers").alias("inliers"), *[F.col(f"b.{c}").alias(c) for c in h])
    best = cut(best.where(F.col("inliers") >= min_inliers))
    return best.select(*by, F.array(*h).alias("h"), "inliers"), m.join(best.drop("inliers"), by).withColumn("inlier", near).drop("_i", *h)


@operator("feat_fast")
def fast(df: DataFrame, threshold: float = 20, nonmax: bool = True) -> DataFrame:
    """(raster_id, y, x, score) of pixels with nine neighbouring ones on the circle all brighter, or all darker, by more than the threshold; score: the sum of what exceeds it. Only the best of a 3 x 3 neighbourhood if nonmax."""
    d = around(df, "v", CIRCLE).where(" and ".join(f"n{i} is not null" for i in range(16)))
    ring = F.array(*[F.col(f"n{i % 16}") for i in range(24)])

    def run(beyond) -> Column:
        longest = F.aggregate(ring, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, v: F.struct(F.when(beyond(v), a["now"] + 1).otherwise(F.lit(0)).alias("now"), F.greatest(a["best"], F.when(beyond(v), a["now"] + 1).otherwise(F.lit(0))).alias("best")), lambda a: a["best"])
        return longest >= 9

    v = F.col("v")
    over = sum((F.greatest(F.lit(0.0), F.abs(F.col(f"n{i}") - v) - threshold) for i in range(16)), F.lit(0.0))
    found = d.where(run(lambda c: c > v + threshold) | run(lambda c: c < v - threshold)).select(*KEY, over.alias("score"))
    if not nonmax:
        return found
    near = around(cut(found), "score", RING)
    n = [F.coalesce(F.col(f"n{i}"), F.lit(-1.0)) for i in range(8)]
    later = (2, 3, 4, 5)  # of equal scores the first in row order stays
    best = F.lit(True)
    for i in range(8):
        best = best & (F.col("score") >= n[i] if i in later else F.col("score") > n[i])
    return near.where(best).select(*KEY, "score")


def flow(frames: DataFrame, window: int = 3, g: DataFrame | None = None) -> DataFrame:
    """(raster_id, tick, y, x, dx, dy): how far each pixel has moved since the tick before, by least squares over a window of the brightness equation; 0 where the window has no texture. g: the frames' gradients, if they are at hand."""
    f = frames.select(F.struct("raster_id", "tick").alias("raster_id"), "y", "x", "v")
    scratch = Scratch(frames.sparkSession)
    g = scratch.put("gradients", gradients(f)) if g is None else g
    later = f.select(F.struct(F.col("raster_id.raster_id"), (F.col("raster_id.tick") - 1).alias("tick")).alias("raster_id"), "y", "x", F.col("v").alias("_next"))
    d = scratch.put("changes", g.join(f, KEY).join(later, KEY).select(*KEY, (F.col("dx") / 8).alias("gx"), (F.col("dy") / 8).alias("gy"), (F.col("_next") - F.col("v")).alias("gt")))
    x, y, t = F.col("gx"), F.col("gy"), F.col("gt")
    s = stencil_means(d, {"xx": x * x, "yy": y * y, "xy": x * y, "xt": x * t, "yt": y * t}, window)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solved = lambda a, b, c, e: F.when(det > 1e-6, (F.col(a) * F.col(b) - F.col(c) * F.col(e)) / F.when(det > 1e-6, det)).otherwise(0.0)
    return s.select(F.col("raster_id.raster_id").alias("raster_id"), (F.col("raster_id.tick") + 1).alias("tick"), "y", "x", solved("xy", "yt", "yy", "xt").alias("dx"), solved("xy", "xt", "xx", "yt").alias("dy"))


def stencil_means(d: DataFrame, columns: dict[str, Column], window: int) -> DataFrame:
    """Means of several columns over one window, in one pass."""
    packed = d.select(*KEY, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("v"))
    k = np.ones((window | 1, window | 1))
    return stencil(packed, k, **{n: F.avg(F.col(f"v.{n}")) for n in columns})


@operator("analysis_flow")
def dense_flow(frames: DataFrame, window: int = 3) -> DataFrame:
    """Flow at every pixel, with its magnitude and angle in degrees."""
    return flow(frames, window).withColumn("magnitude", F.hypot("dx", "dy")).withColumn("angle", F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0)))


@operator("optical_flow_lk")
def corner_flow(frames: DataFrame, quality: float = 0.1, window: int = 3, max_corners: int = 100) -> DataFrame:
    """Flow at each frame's corners of the tick before: local maxima of the smaller eigenvalue over a share of the frame's largest, at most max_corners, strongest first (ties: row order). What a stencil reads is written once: a stencil reads it twice, and so would compute all before it twice over."""
    scratch = Scratch(frames.sparkSession)
    f = frames.select(F.struct("raster_id", "tick").alias("raster_id"), "y", "x", "v")
    slopes = scratch.put("gradients", gradients(f))
    g = slopes.select(*KEY, (F.col("dx") / 8).alias("gx"), (F.col("dy") / 8).alias("gy"))
    s = stencil_means(g, {"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")}, window)
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.col("xy") * F.col("xy"))
    e = scratch.put("corners", s.select(*KEY, F.round(half - root, 6).alias("v")))
    d = with_raster_stats(scratch.put("peaks", e.join(dilate(e, 3).withColumnRenamed("v", "_d"), KEY)), _top=F.max("v")).where((F.col("v") == F.col("_d")) & (F.col("v") > quality * F.col("_top")))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("raster_id").orderBy(F.desc("v"), "y", "x"))).where(F.col("_r") <= max_corners)
    corners = d.select(F.col("raster_id.raster_id").alias("raster_id"), (F.col("raster_id.tick") + 1).alias("tick"), "y", "x")
    return flow(frames, window, slopes).join(corners, ["raster_id", "tick", "y", "x"])


def line_places(length: int, angle: float, iterations: int = 1) -> list[tuple[int, int]]:
    """Offsets (y, x) of a line around a place, at an angle in degrees counted against the clock, laid end to end with itself."""
    r = length // 2
    steps = np.linspace(-r, r, 4 * r + 1) if r else np.zeros(1)
    line = {(round(-t * math.sin(math.radians(angle))), round(t * math.cos(math.radians(angle)))) for t in steps.tolist()}
    out = {(0, 0)}
    for _ in range(iterations):
        out = {(a + c, b + d) for a, b in out for c, d in line}
    return sorted(out)


@operator("cv_directional_dilate")
def oriented_dilate(mask: DataFrame, length: int = 11, bins: int = 8, tensor_sigma: float = 2.0, iterations: int = 1, then_close: bool = True) -> DataFrame:
    """Each set pixel is drawn out along the border's direction there: that of the smoothed gradients' structure, turned by a right angle, in one of some bins. Then small gaps are closed.

    A set pixel sends itself to the places of its bin's line; line_dilate has one angle for all.
    """
    on = mask.select(*KEY, (F.col("v") > 0).cast("double").alias("v"))
    g = gradients(on)
    size = max(3, int(math.floor(tensor_sigma * 4 + 0.5)) | 1)
    mean = lambda v, name: gaussian_blur(g.select(*KEY, v.alias("v")), size, tensor_sigma).withColumnRenamed("v", name)
    t = mean(F.col("dx") * F.col("dx"), "xx").join(mean(F.col("dy") * F.col("dy"), "yy"), KEY).join(mean(F.col("dx") * F.col("dy"), "xy"), KEY)
    tangent = F.pmod(F.round(F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2) + 90, 6), F.lit(180.0))
    lines = F.array(*[F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in line_places(length, (b + 0.5) * 180 / bins, iterations)]) for b in range(bins)])
    drawn = t.join(on.where("v > 0"), KEY).select(*KEY, F.least(F.lit(bins - 1), F.floor(tangent * bins / 180)).cast("int").alias("bin"))
    drawn = drawn.select(*KEY, F.explode(F.get(lines, F.col("bin"))).alias("o")).select("raster_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    out = on.join(drawn.withColumn("_in", F.lit(1)), KEY, "left").select(*KEY, F.when((F.col("v") > 0) | F.col("_in").isNotNull(), 255.0).otherwise(0.0).alias("v"))
    return morphology(out, "close", 3, "cross") if then_close else out


def line_dilate(mask: DataFrame, length: int = 5, angle: float = 0.0, iterations: int = 1) -> DataFrame:
    """Dilation by a line at an angle in degrees (0 along x, 90 along y)."""
    r = length // 2
    k = np.full((2 * r + 1, 2 * r + 1), np.nan)
    for i in range(-r, r + 1):
        k[r + round(i * math.sin(math.radians(angle))), r + round(i * math.cos(math.radians(angle)))] = 1.0
    d = mask
    for _ in range(iterations):
        d = stencil(d, k, v=F.max("v"))
    return d


@operator("cv_stereo")
def disparity(left: DataFrame, right: DataFrame, num_disparities: int = 4, block_size: int = 3) -> DataFrame:
    """(raster_id, y, x, disparity): for each pixel of the left raster the shift at which the mean absolute difference over a block is least (ties: the smaller); pixels shifted out of the raster count 255."""
    shifts = F.explode(F.sequence(F.lit(0), F.lit(num_disparities - 1))).alias("d")
    a = left.select("raster_id", "y", "x", "v", shifts)
    b = right.select("raster_id", "y", F.col("x").alias("_x"), F.col("v").alias("_v"))
    gap = F.coalesce(F.abs(F.col("v") - F.col("_v")), F.lit(255.0))
    d = a.withColumn("_x", F.col("x") - F.col("d")).join(b, ["raster_id", "y", "_x"], "left").select(F.struct("raster_id", "d").alias("raster_id"), "y", "x", gap.alias("v"))
    cost = box_mean(d, block_size).select(F.col("raster_id.raster_id").alias("raster_id"), F.col("raster_id.d").alias("d"), "y", "x", F.round("v", 6).alias("v"))
    return cost.groupBy(*KEY).agg(F.min(F.struct("v", "d"))["d"].alias("disparity"))


@operator("cv_mean_shift")
def mean_shift(df: DataFrame, spatial_radius: int = 2, value_radius: float = 30, iterations: int = 5, tile: int = 512) -> DataFrame:
    """Each pixel's value where the mean of the pixels within both radii of it, and then of that mean, and so on, comes to after some iterations. A mean moves by the radius and half a pixel at most, so tiles have a halo that holds all places it can reach."""
    near = [(dy, dx) for dy in range(-spatial_radius, spatial_radius + 1) for dx in range(-spatial_radius, spatial_radius + 1) if dy * dy + dx * dx <= spatial_radius**2]
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(t: Stack) -> dict[str, np.ndarray | pa.Array]:
        v, known = t.planes["v"], t.planes["_in"] == 1
        y, x = np.nonzero(t.planes["_in"])
        core = t.in_core(y, x)
        y, x = y[core], x[core]
        at = [y.astype(float), x.astype(float), v[y, x]]
        for _ in range(iterations):
            by, bx, sums = np.floor(at[0] + 0.5).astype(int), np.floor(at[1] + 0.5).astype(int), np.zeros((4, len(y)))
            for dy, dx in near:
                py, px = by + dy, bx + dx
                i = np.flatnonzero((py >= 0) & (px >= 0) & (py < v.shape[0]) & (px < v.shape[1]))
                i = i[known[py[i], px[i]]]
                i = i[np.abs(v[py[i], px[i]] - at[2][i]) <= value_radius]
                for total, one in zip(sums, (1, py[i], px[i], v[py[i], px[i]]), strict=True):
                    total[i] += one
            met = sums[0] > 0
            for k in range(3):
                at[k][met] = np.round(sums[k + 1][met] / sums[0][met], 6)
        return {"row": y, "y": t.y(y), "x": t.x(y, x), "v": pa.array(at[2], mask=t.planes["_in"][y, x] == 2)}

    d = df.select(*KEY, "v", F.when(F.col("v").isNull(), 2).otherwise(1).alias("_in"))
    return by_stacks(d, ["v", "_in"], run, f"y {kind['y']}, x {kind['x']}, v double", tile, iterations * (spatial_radius + 1))
