"""Geometric operators: coordinate changes as projections, resampling as joins with the source pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import operator
from ..session import dealt
from .pixels import KEY, bilinear, size_of, with_size

TURNS = 512  # turns of a hull that are tried at a time


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY]


def _moved(df: DataFrame, y: Column, x: Column, keep: Column | None = None) -> DataFrame:
    d = with_size(df)
    d = d.where(keep) if keep is not None else d
    return d.select("raster_id", y.alias("y"), x.alias("x"), *_rest(df))


@operator("geom_flip")
def flip(df: DataFrame, mode: str = "horizontal") -> DataFrame:
    y = F.col("h") - 1 - F.col("y") if mode in ("vertical", "both") else F.col("y")
    x = F.col("w") - 1 - F.col("x") if mode in ("horizontal", "both") else F.col("x")
    return _moved(df, y, x)


def _target(df: DataFrame, h: Column, w: Column) -> DataFrame:
    """Every place of the result, with the source's size as h, w."""
    s = size_of(df).withColumn("_h", h.cast("int")).withColumn("_w", w.cast("int"))
    rows = s.select("raster_id", "h", "w", "_h", "_w", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("y"))
    return dealt(rows, "raster_id", "y").select("raster_id", "h", "w", "_h", "_w", "y", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x"))


def _resampled(df: DataFrame, grid: DataFrame, py: Column, px: Column, nearest: bool = False, fill: float = 0.0) -> DataFrame:
    """v at source places for each place of the grid; outside the source it is the fill.

    Joins on places are merge joins: a grid is estimated by the rasters that it was made of, and so would be broadcast.
    """
    g = grid.withColumn("py", py).withColumn("px", px)
    if nearest:
        s = df.select("raster_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "v")
        at = g.select(*KEY, F.floor(F.col("py") + 0.5).cast("int").alias("_y"), F.floor(F.col("px") + 0.5).cast("int").alias("_x"))
        return at.join(s.hint("merge"), ["raster_id", "_y", "_x"], "left").select(*KEY, F.coalesce("v", F.lit(fill)).alias("v"))
    inside = (F.col("py") >= 0) & (F.col("px") >= 0) & (F.col("py") <= F.col("h") - 1) & (F.col("px") <= F.col("w") - 1)
    corners = F.filter(F.array(*[F.struct((F.floor("py") + i).cast("int").alias("_y"), (F.floor("px") + j).cast("int").alias("_x"), ((1 - F.abs(F.col("py") - F.floor("py") - i)) * (1 - F.abs(F.col("px") - F.floor("px") - j))).alias("weight")) for i in (0, 1) for j in (0, 1)]), lambda c: c["weight"] > 0)
    outside = F.array(F.struct(F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), F.lit(0.0).alias("weight")))
    p = g.select(*KEY, F.inline(F.when(inside, corners).otherwise(outside)))
    s = df.select("raster_id", F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), "v", F.lit(1).alias("_in"))
    met = p.join(s.hint("merge"), ["raster_id", "_y", "_x"], "left")
    weight = F.when(F.col("_in").isNotNull(), F.col("weight"))
    return met.groupBy(*KEY).agg(F.try_divide(F.sum(F.col("v") * weight), F.sum(weight)).alias("v")).fillna(fill, ["v"])


@operator("geom_resize")
def resize(df: DataFrame, height: int | None = None, width: int | None = None, scale: float = 1.0, method: str = "linear") -> DataFrame:
    """Linear, nearest, or area (block means, for whole-number shrinking)."""
    h = F.lit(height) if height else F.greatest(F.lit(1), F.floor(F.col("h") * scale + 0.5))
    w = F.lit(width) if width else F.greatest(F.lit(1), F.floor(F.col("w") * scale + 0.5))
    if method == "area":
        d = with_size(df).withColumn("_h", h).withColumn("_w", w)
        return d.groupBy("raster_id", F.floor(F.col("y") * F.col("_h") / F.col("h")).cast("int").alias("y"), F.floor(F.col("x") * F.col("_w") / F.col("w")).cast("int").alias("x")).agg(F.avg("v").alias("v"))
    g = _target(df, h, w)
    place = lambda c, n, m: F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, (F.col(c) + 0.5) * F.col(n) / F.col(m) - 0.5))
    return _resampled(df, g, place("y", "h", "_h"), place("x", "w", "_w"), method == "nearest")


@operator("geom_crop_rect")
def crop_rect(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    keep = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return df.where(keep).withColumn("y", F.col("y") - y).withColumn("x", F.col("x") - x)


@operator("geom_cropper")
def crop_box(df: DataFrame, boxes: DataFrame, padding: float = 0.0) -> DataFrame:
    """One relative box (xmin, ymin, width, height in 0..1) per raster, grown by a padding."""
    b = boxes.select("raster_id", *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "width", "height")])
    d = with_size(df).join(b, "raster_id")
    x0, y0 = F.floor((F.col("_xmin") - padding) * F.col("w")), F.floor((F.col("_ymin") - padding) * F.col("h"))
    x1, y1 = F.ceil((F.col("_xmin") + F.col("_width") + padding) * F.col("w")), F.ceil((F.col("_ymin") + F.col("_height") + padding) * F.col("h"))
    x0, y0 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    kept = d.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return kept.select("raster_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), *_rest(df))


@operator("plugin_offset")
def offset(df: DataFrame, x_offset: int = 0, y_offset: int = 0) -> DataFrame:
    """Translation within the raster; what is uncovered is 0."""
    moved = df.select("raster_id", (F.col("y") + y_offset).alias("y"), (F.col("x") + x_offset).alias("x"), *_rest(df))
    return df.select(*KEY).join(moved, KEY, "left").fillna(0.0)


@operator("geom_warp_affine")
def warp_affine(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 2x3 matrix from source to result coordinates (x, y)."""
    m = np.linalg.inv(np.vstack([np.array(matrix, float), [0, 0, 1]]))
    g = _target(df, F.col("h"), F.col("w"))
    return _resampled(df, g, F.col("x") * m[1, 0].item() + F.col("y") * m[1, 1].item() + m[1, 2].item(), F.col("x") * m[0, 0].item() + F.col("y") * m[0, 1].item() + m[0, 2].item())


@operator("plugin_rotate")
def rotate(df: DataFrame, angle: float = 0.0, scale: float = 1.0, expand: bool = False) -> DataFrame:
    """Counter-clockwise about the centre (y points down), in the same frame or in one that holds it all."""
    a = math.radians(angle)
    c, s = math.cos(a), math.sin(a)
    size = lambda p, q: F.ceil(F.abs(F.lit(c)) * F.col(p) + F.abs(F.lit(s)) * F.col(q) - 1e-9)
    g = _target(df, size("h", "w"), size("w", "h")) if expand else _target(df, F.col("h"), F.col("w"))
    dx, dy = (F.col("x") - (F.col("_w") - 1) / 2) / scale, (F.col("y") - (F.col("_h") - 1) / 2) / scale
    return _resampled(df, g, F.bround(dx * s + dy * c + (F.col("h") - 1) / 2, 9), F.bround(dx * c - dy * s + (F.col("w") - 1) / 2, 9))


@operator("geom_rotate_no_crop")
def rotate_expanded(df: DataFrame, angle: float = 0.0) -> DataFrame:
    return rotate(df, angle, expand=True)


@operator("geom_perspective")
def perspective(df: DataFrame, corners: list[tuple[float, float]], width: int, height: int) -> DataFrame:
    """The quadrilateral of four source corners (x, y; clockwise from the upper left) as a rectangle."""
    rows, rhs = [], []
    for (u, v), (x, y) in zip(((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)), corners, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        rhs += [x, y]
    m = [*np.linalg.solve(np.array(rows, float), np.array(rhs, float)).tolist(), 1.0]
    g = _target(df, F.lit(height), F.lit(width))
    z = F.col("x") * m[6] + F.col("y") * m[7] + 1.0
    place = lambda i: F.bround((F.col("x") * m[i] + F.col("y") * m[i + 1] + m[i + 2]) / z, 9)
    return _resampled(df, g, place(3), place(0))


@operator("cv_undistort")
def undistort(df: DataFrame, focal: float = 1.0, k1: float = 0.0, k2: float = 0.0, p1: float = 0.0, p2: float = 0.0, k3: float = 0.0) -> DataFrame:
    """Radial and tangential distortion taken out; focal length in widths."""
    g = _target(df, F.col("h"), F.col("w"))
    f, cx, cy = F.col("w") * focal, (F.col("w") - 1) / 2, (F.col("h") - 1) / 2
    x, y = (F.col("x") - cx) / f, (F.col("y") - cy) / f
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    xd, yd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return _resampled(df, g, F.bround(yd * f + cy, 9), F.bround(xd * f + cx, 9))


@operator("geom_obb")
def oriented_box(mask: DataFrame) -> DataFrame:
    """Per raster the rectangle of least area around the set pixels (see least_rectangle): centre, angle of its longer side in degrees, in [-90, 90), length and width."""
    tall = F.col("width") < F.col("height") - 1e-9
    box = least_rectangle(mask.where("v > 0"))
    return box.select("raster_id", "cx", "cy", F.when(tall, F.col("angle") - 90).otherwise(F.col("angle")).alias("angle"), F.greatest("width", "height").alias("length"), F.least("width", "height").alias("width"))


def least_rectangle(points: DataFrame) -> DataFrame:
    """(raster_id, cx, cy, width, height, angle): the rectangle of least area around points(raster_id, x, y), its width along angle (degrees from x, in [0, 90)).

    Of each line of equal y only the outer points can matter, so a raster's group has two a line; one
    side of the least rectangle lies on the hull. Of equally small ones the smaller angle is taken.
    """
    ends = points.groupBy("raster_id", F.col("y").cast("double").alias("y")).agg(F.min("x").cast("double").alias("a"), F.max("x").cast("double").alias("b"))
    kind = points.schema["raster_id"].dataType.simpleString()

    def run(lines: pa.Table) -> pa.Table:
        y, a, b = (lines.column(c).to_pylist() for c in ("y", "a", "b"))
        p = sorted({*zip(a, y, strict=True), *zip(b, y, strict=True)})
        hull: list[tuple[float, float]] = []
        for side in (p, p[::-1]):
            part: list[tuple[float, float]] = []
            for q in side:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]):
                    part.pop()
                part.append(q)
            hull += part[:-1] or part
        h = np.array(hull)
        step = np.append(h[1:], h[:1], axis=0) - h
        turns = np.array(sorted(set((np.round(np.degrees(np.arctan2(step[:, 1], step[:, 0])) % 90, 9) % 90).tolist())))
        found = []
        for k in range(0, len(turns), TURNS):  # of a hull with many sides, some at a time
            c, s = np.cos(np.radians(turns[k : k + TURNS])), np.sin(np.radians(turns[k : k + TURNS]))
            u, v = np.outer(h[:, 0], c) + np.outer(h[:, 1], s), np.outer(h[:, 1], c) - np.outer(h[:, 0], s)
            found.append(np.stack([u.min(0), u.max(0), v.min(0), v.max(0), c, s]))
        least, most, low, high, c, s = np.concatenate(found, axis=1)
        best, area = 0, ((most - least) * (high - low)).tolist()
        for k, size in enumerate(area):
            if size < area[best] - 1e-9:
                best = k
        mu, mv = (least[best] + most[best]) / 2, (low[best] + high[best]) / 2
        out = c[best] * mu - s[best] * mv, s[best] * mu + c[best] * mv, most[best] - least[best], high[best] - low[best], turns[best]
        return pa.table([lines.column("raster_id").slice(0, 1), *([float(x)] for x in out)], names=["raster_id", "cx", "cy", "width", "height", "angle"])

    return ends.groupBy("raster_id").applyInArrow(run, f"raster_id {kind}, cx double, cy double, width double, height double, angle double")


@operator("geom_fit_shape")
def fit_shape(points: DataFrame, padding: float = 0.0) -> DataFrame:
    """Bounding box of points(raster_id, x, y) grown by a padding. least_rectangle has the turned one."""
    return points.groupBy("raster_id").agg((F.min("x") - padding).alias("xmin"), (F.min("y") - padding).alias("ymin"), (F.max("x") + padding).alias("xmax"), (F.max("y") + padding).alias("ymax"))


def _inside(points: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule for a polygon given in relative coordinates."""
    crossings: Column = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


@operator("util_roi_polygon")
def roi_polygon(df: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """Mask of a polygon (relative points), tested at pixel centres."""
    d = with_size(df)
    on = _inside(points, (F.col("x") + 0.5) / F.col("w"), (F.col("y") + 0.5) / F.col("h"))
    return d.select(*KEY, F.when(on, 255.0).otherwise(0.0).alias("v"))


@operator("feat_fill_contours")
def fill_contours(df: DataFrame, contours: list[list[tuple[float, float]]]) -> DataFrame:
    d = with_size(df)
    on: Column = F.lit(False)
    for points in contours:
        on = on | _inside(points, (F.col("x") + 0.5) / F.col("w"), (F.col("y") + 0.5) / F.col("h"))
    return d.select(*KEY, F.when(on, 255.0).otherwise(0.0).alias("v"))


@operator("util_coord_to_mask")
def boxes_to_mask(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes(raster_id, ymin, ymax, xmin, xmax) in pixels as a mask: an equi-join on the boxes' rows."""
    rows = boxes.select("raster_id", F.explode(F.sequence("ymin", "ymax")).alias("y"), F.col("xmin").alias("_x0"), F.col("xmax").alias("_x1"))
    hit = df.join(rows, ["raster_id", "y"]).where((F.col("x") >= F.col("_x0")) & (F.col("x") <= F.col("_x1"))).select(*KEY).distinct()
    return df.select(*KEY).join(hit.withColumn("v", F.lit(255.0)), KEY, "left").fillna(0.0, ["v"])


@operator("points_to_mask")
def points_to_mask(df: DataFrame, points: DataFrame, radius: int = 1) -> DataFrame:
    """Discs about points(raster_id, y, x)."""
    around = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])).alias("o")
    hit = points.select("raster_id", "y", "x", o).select("raster_id", (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).distinct()
    return df.select(*KEY).join(hit.withColumn("v", F.lit(255.0)), KEY, "left").fillna(0.0, ["v"])


@operator("transform_eye_crop")
def eye_crop(df: DataFrame, eyes: DataFrame, size: int = 8) -> DataFrame:
    """eyes(raster_id, eye, cx, cy, half, angle) to aligned square crops of size x size, by resampling."""
    at = F.sequence(F.lit(0), F.lit(size - 1))
    g = eyes.select("*", F.explode(at).alias("y")).select("*", F.explode(at).alias("x"))
    u, v = (F.col("x") / (size - 1) * 2 - 1) * F.col("half"), (F.col("y") / (size - 1) * 2 - 1) * F.col("half")
    a = F.radians("angle")
    g = g.withColumn("px", F.col("cx") + u * F.cos(a) - v * F.sin(a)).withColumn("py", F.col("cy") + u * F.sin(a) + v * F.cos(a))
    return bilinear(df, g.select("raster_id", "eye", F.col("y").alias("_ty"), F.col("x").alias("_tx"), "px", "py"), ["raster_id", "eye", "_ty", "_tx"]).withColumnsRenamed({"_ty": "y", "_tx": "x"})


def dft(df: DataFrame, inverse: bool = False) -> DataFrame:
    """(raster_id, y, x, re, im): the discrete Fourier transform of (v) or (re, im), rows and then columns. A line is one row of arrays and is transformed where it is; what it lacks is 0."""
    d = df if "re" in df.columns else df.select(*KEY, F.col("v").alias("re"), F.lit(0.0).alias("im"))
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    sizes = size_of(df)
    for along, size in (("x", "w"), ("y", "h")):
        other = "y" if along == "x" else "x"
        lines = d.groupBy("raster_id", other).agg(F.collect_list(F.struct(F.col(along).cast("int").alias("p"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("re", "im")])).alias("line")).join(sizes.select("raster_id", F.col(size).cast("int").alias("n")), "raster_id")

        def run(batches: Iterator[pa.RecordBatch], other: str = other) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, n = batch.column("line"), batch.column("n").to_numpy()
                cells, line = lists.flatten(), np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                p, value = cells.field("p").to_numpy(), cells.field("re").to_numpy() + 1j * cells.field("im").to_numpy()
                for size in np.unique(n).tolist():  # lines of one length at a time
                    own, here = np.flatnonzero(n == size), n[line] == size
                    z = np.zeros((len(own), size), complex)
                    np.add.at(z, (np.searchsorted(own, line[here]), p[here]), value[here])
                    f = np.fft.ifft(z) if inverse else np.fft.fft(z)
                    at = pa.array(np.repeat(own, size))
                    yield pa.RecordBatch.from_arrays([batch.column("raster_id").take(at), batch.column(other).take(at), pa.array(np.tile(np.arange(size, dtype=np.int32), len(own))), pa.array(f.real.ravel()), pa.array(f.imag.ravel())], names=["raster_id", "other", "along", "re", "im"])

        out = lines.select("raster_id", other, "n", "line").mapInArrow(run, f"raster_id {kind['raster_id']}, other {kind[other]}, along int, re double, im double")
        d = out.select("raster_id", F.col("along" if along == "y" else "other").alias("y"), F.col("along" if along == "x" else "other").alias("x"), "re", "im")
    return d


@operator("sci_fft")
def fft(df: DataFrame) -> DataFrame:
    """Magnitude and phase with the zero frequency in the middle, besides re and im."""
    d = with_size(dft(df))
    y, x = F.pmod(F.col("y") + F.floor(F.col("h") / 2), F.col("h")), F.pmod(F.col("x") + F.floor(F.col("w") / 2), F.col("w"))
    return d.select("raster_id", y.cast("int").alias("y"), x.cast("int").alias("x"), "re", "im", F.hypot("re", "im").alias("magnitude"), F.atan2("im", "re").alias("phase"))


@operator("sci_ifft")
def ifft(spectrum: DataFrame) -> DataFrame:
    """The raster of a spectrum as sci_fft gives it."""
    d = with_size(spectrum)
    y, x = F.pmod(F.col("y") - F.floor(F.col("h") / 2), F.col("h")), F.pmod(F.col("x") - F.floor(F.col("w") / 2), F.col("w"))
    return dft(d.select("raster_id", y.cast("int").alias("y"), x.cast("int").alias("x"), "re", "im"), inverse=True).select(*KEY, F.col("re").alias("v"))


@operator("sci_dct")
def dct(df: DataFrame, keep: int | None = None) -> DataFrame:
    """Orthonormal cosine transform; keep leaves the lowest keep x keep coefficients."""
    d = df.select(*KEY, "v")
    for along, size in (("x", "w"), ("y", "h")):
        other = "y" if along == "x" else "x"
        e = with_size(d).select("raster_id", other, F.col(along).alias("_p"), "v", size, F.explode(F.sequence(F.lit(0), (F.col(size) - 1).cast("int"))).alias(along))
        norm = F.sqrt(F.when(F.col(along) == 0, 1.0).otherwise(2.0) / F.col(size))
        d = e.groupBy(*KEY).agg(F.sum(F.col("v") * norm * F.cos(math.pi * (2 * F.col("_p") + 1) * F.col(along) / (2 * F.col(size)))).alias("v"))
    return d.withColumn("v", F.when((F.col("y") < keep) & (F.col("x") < keep), F.col("v")).otherwise(0.0)) if keep else d


def utm(lon: Column, lat: Column, zone: int) -> Column:
    """struct(easting, northing) on WGS84 by the usual transverse Mercator series (northern hemisphere's false origin)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    p, l0 = F.radians(lat), math.radians(zone * 6 - 183)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    t, c, big = F.tan(p) * F.tan(p), ep2 * F.cos(p) * F.cos(p), F.cos(p) * (F.radians(lon) - l0)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - 35 * e2**3 / 3072 * F.sin(6 * p))
    pw = lambda k: F.pow(big, F.lit(k))
    x = k0 * n * (big + (1 - t + c) * pw(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pw(5) / 120) + 500000.0
    y = k0 * (m + n * F.tan(p) * (pw(2) / 2 + (5 - t + 9 * c + 4 * c * c) * pw(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pw(6) / 720))
    return F.struct(x.alias("easting"), y.alias("northing"))
