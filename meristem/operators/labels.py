"""Label maps and regions.

A mask is (raster_id, y, x, v), a label map (raster_id, y, x, label) with 0 as background. Components
are found over horizontal runs of set pixels: runs that touch are joined within tiles, and the graph of
what touches across tiles names the labels. Labels are numbered from 1 in a raster by the first pixel in
row order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import cut
from .components import connected_components
from .distance import distances
from .neighbours import RING, around, spaced
from .pixels import KEY, size_of
from .stencils import box_mean, dilate, erode, gaussian_blur, morphology
from .tiles import Stack, by_stacks


def runs(mask: DataFrame) -> DataFrame:
    """(raster_id, y, x0, x1) of maximal horizontal runs of v > 0."""
    on = mask.where("v > 0").select(*KEY)
    group = F.col("x") - F.row_number().over(Window.partitionBy("raster_id", "y").orderBy("x"))
    return on.withColumn("_g", group).groupBy("raster_id", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def _tile_runs(t: Stack, reach: int) -> dict[str, np.ndarray]:
    """Horizontal runs of tiles, and the first pixel in row order of the component that each is of within the tile."""
    on = np.zeros((t.planes["v"].shape[0], t.planes["v"].shape[1] + 2), np.int8)
    on[:, 1:-1] = t.planes["v"] > 0
    edge = np.diff(on, axis=1)
    (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
    wide = on.shape[1]
    low = np.searchsorted(y * wide + x1, (y + 1) * wide + x0 - reach)
    high = np.searchsorted(y * wide + x0, (y + 1) * wide + x1 + reach, side="right")
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        for k in range(a, b):
            p, q = root(i), root(k)
            parent[max(p, q)] = min(p, q)
    first = np.array([root(i) for i in range(len(y))], int)
    return {"row": y, "y": t.y(y), "x0": t.x(y, x0), "x1": t.x(y, x1), "ry": t.y(y[first]), "rx": t.x(y, x0[first])}


def component_labels(mask: DataFrame, connectivity: int = 8, tile: int = 512) -> DataFrame:
    """(raster_id, y, x, label) of the set pixels.

    Each tile's runs are joined where they lie; only components that touch across the border of two
    tiles meet in a graph, whose components name the labels.
    """
    kind = {f.name: f.dataType.simpleString() for f in mask.schema}
    reach = 1 if connectivity == 8 else 0
    on = mask.where("v > 0").select(*KEY, F.lit(1.0).alias("v"))
    r = cut(by_stacks(on, ["v"], lambda t: _tile_runs(t, reach), f"y {kind['y']}, x0 {kind['x']}, x1 {kind['x']}, ry {kind['y']}, rx {kind['x']}", tile, 0)).withColumn("node", F.struct("raster_id", "ry", "rx"))
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    # a run's pixels at the lower border of its tile, else its ends at the sides
    at = F.when(last("y"), F.sequence("x0", "x1")).otherwise(F.array_distinct(F.array("x0", "x1")))
    rim = r.where(last("y") | last("x1") | (F.pmod("x0", F.lit(tile)) == 0) & (F.col("x0") > 0)).select("raster_id", "y", F.explode(at).alias("x"), "node")
    near = ((0, 1), (1, -1), (1, 0), (1, 1)) if connectivity == 8 else ((0, 1), (1, 0))
    o = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in near])).alias("o")
    rim = rim.select("raster_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "node", o).select("raster_id", "_y", "_x", (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x"), "node")
    place = lambda c: F.floor(F.col(c) / tile)
    rim = cut(rim.where((place("y") != place("_y")) | (place("x") != place("_x"))).select("raster_id", "y", "x", F.col("node").alias("a")))
    named = r.withColumn("_c", F.col("node"))
    if not rim.isEmpty():
        other = r.select("raster_id", "y", "x0", "x1", F.col("node").alias("b"))
        edges = rim.join(other, ["raster_id", "y"]).where("x between x0 and x1").select("a", "b")
        found = connected_components(edges).withColumnRenamed("id", "node")
        named = cut(r.join(found, "node", "left").withColumn("_c", F.coalesce("component", "node")))
    names = named.select("raster_id", "_c").distinct().withColumn("label", F.row_number().over(Window.partitionBy("raster_id").orderBy("_c.ry", "_c.rx")))
    return named.join(names, ["raster_id", "_c"]).select("raster_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def areas(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").groupBy("raster_id", "label").agg(F.count("*").alias("area"))


def _as_mask(like: DataFrame, on: DataFrame) -> DataFrame:
    """255 at the pixels of `on`, 0 at the other pixels of `like`."""
    return like.select(*KEY).join(on.select(*KEY, F.lit(255.0).alias("v")), KEY, "left").fillna(0.0, ["v"])


@operator("feat_connected_components")
def connected(mask: DataFrame) -> DataFrame:
    """Full label maps, 0 where the mask isn't set."""
    return mask.select(*KEY).join(component_labels(mask), KEY, "left").fillna(0, ["label"])


@operator("sci_connected_components")
def components_by_area(gray: DataFrame, threshold: float = 127, connectivity: int = 8, min_area: int = 1, max_area: int | None = None) -> DataFrame:
    """(raster_id, label, area, cy, cx) of components of the thresholded raster within an area range."""
    found = component_labels(gray.withColumn("v", F.when(F.col("v") > threshold, 255.0).otherwise(0.0)), connectivity)
    c = found.groupBy("raster_id", "label").agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return c.where((F.col("area") >= min_area) & (F.col("area") <= max_area if max_area is not None else F.lit(True)))


@operator("feat_marker_filter")
def marker_filter(labels: DataFrame, min_area: float = 0, max_area: float = float("inf"), unit: str = "px", remap: bool = True) -> DataFrame:
    """Regions within an area range, in pixels or percent of the raster, renumbered from 1."""
    total = labels.groupBy("raster_id").agg(F.count("*").alias("_n"))
    a = areas(labels).join(total, "raster_id")
    size = F.col("area") if unit == "px" else 100 * F.col("area") / F.col("_n")
    kept = a.where((size >= min_area) & (size <= max_area)).select("raster_id", "label")
    new = F.row_number().over(Window.partitionBy("raster_id").orderBy("label")) if remap else F.col("label")
    return labels.join(kept.withColumn("_new", new), ["raster_id", "label"], "left").select(*KEY, F.coalesce("_new", F.lit(0)).cast("int").alias("label"))


@operator("sci_marker_filter")
def marker_area_filter(labels: DataFrame, min_area: float = 0, max_area: float = float("inf")) -> DataFrame:
    return marker_filter(labels, min_area, max_area, remap=False)


@operator("util_label_filter_area")
def label_filter_area(labels: DataFrame, min_area_px: float = 0, min_area_pct: float = 0, mode: int = 0) -> DataFrame:
    """Mask of labels with an area of at least max(pixels, percent of the raster) (mode 0), or of the others."""
    total = labels.groupBy("raster_id").agg((F.count("*") * (min_area_pct / 100)).alias("_p"))
    a = areas(labels).join(total, "raster_id")
    large = F.col("area") >= F.greatest(F.lit(float(min_area_px)), F.col("_p"))
    kept = a.where(large if mode == 0 else ~large)
    return _as_mask(labels, labels.join(kept.select("raster_id", "label"), ["raster_id", "label"], "leftsemi"))


@operator("mask_filter_area")
def filter_area(mask: DataFrame, min_area_px: float = 0, min_area_pct: float = 0, mode: int = 0, invert: bool = False, fill: bool = False) -> DataFrame:
    m = mask.withColumn("v", 255 - F.col("v")) if invert else mask
    m = fill_holes(m) if fill else m
    return label_filter_area(connected(m), min_area_px, min_area_pct, mode)


@operator("mask_keep_largest")
def keep_largest(mask: DataFrame, count: int = 1, connectivity: int = 8) -> DataFrame:
    found = component_labels(mask, connectivity)
    rank = F.row_number().over(Window.partitionBy("raster_id").orderBy(F.desc("area"), "label"))
    kept = areas(found).withColumn("_r", rank).where(F.col("_r") <= count)
    return _as_mask(mask, found.join(kept.select("raster_id", "label"), ["raster_id", "label"], "leftsemi"))


@operator("mask_select_by_marker")
def select_by_marker(mask: DataFrame, marker: DataFrame, mode: int = 0, connectivity: int = 8) -> DataFrame:
    """Components that the marker touches are kept, or removed in mode 1."""
    found = component_labels(mask, connectivity)
    touched = found.join(marker.where("v > 0").select(*KEY), KEY, "leftsemi").select("raster_id", "label").distinct()
    return _as_mask(mask, found.join(touched, ["raster_id", "label"], "leftsemi" if mode == 0 else "leftanti"))


@operator("fill_holes")
def fill_holes(mask: DataFrame, max_hole_px: int | None = None) -> DataFrame:
    """Background components (4-connected) that don't reach the border are filled, if not over a size."""
    back = component_labels(mask.withColumn("v", 255 - F.col("v")).withColumn("v", F.when(F.col("v") >= 255, 255.0).otherwise(0.0)), 4)
    d = back.join(size_of(mask), "raster_id")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x") == F.col("w") - 1)
    holes = d.groupBy("raster_id", "label").agg(F.max(edge.cast("int")).alias("_e"), F.count("*").alias("area")).where("_e = 0")
    holes = holes.where(F.col("area") <= max_hole_px) if max_hole_px is not None else holes
    return _as_mask(mask, mask.where("v > 0").select(*KEY).unionByName(back.join(holes, ["raster_id", "label"], "leftsemi").select(*KEY)))


@operator("util_fill_holes")
def fill_all_holes(mask: DataFrame) -> DataFrame:
    return fill_holes(mask)


@operator("mask_region_sealer")
def region_sealer(mask: DataFrame, gap: int = 3, min_area: int = 0) -> DataFrame:
    """Closing, filling, and an area filter."""
    return filter_area(fill_holes(morphology(mask, "close", gap)), min_area)


@operator("filter_morphology_smart")
def smart_morphology(mask: DataFrame, area_pct: float = 5, amount: int = 3) -> DataFrame:
    """Components under a share of the raster are eroded, the others dilated."""
    labels = connected(mask)
    small, large = label_filter_area(labels, 0, area_pct, 1), label_filter_area(labels, 0, area_pct, 0)
    both = erode(small, amount).unionByName(dilate(large, amount))
    return both.groupBy(*KEY).agg(F.max("v").alias("v"))


@operator("sci_region_props")
def region_props(labels: DataFrame, intensity: DataFrame | None = None, um_per_px: float = 1.0) -> DataFrame:
    """Per label: area, equivalent diameter, centroid, box, extent, the axes, orientation and eccentricity of its moments, perimeter (outer edges of pixels) and circularity, and intensity statistics."""
    on = labels.where("label > 0")
    d = on.join(intensity.select(*KEY, F.col("v").alias("_i")), KEY, "left") if intensity is not None else on.withColumn("_i", F.lit(None).cast("double"))
    g = d.groupBy("raster_id", "label").agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("x").alias("xmin"), F.max("x").alias("xmax"),
        F.var_pop("y").alias("_vy"), F.var_pop("x").alias("_vx"), F.covar_pop("y", "x").alias("_vxy"), F.avg("_i").alias("mean_intensity"), F.min("_i").alias("min_intensity"), F.max("_i").alias("max_intensity"),
    )
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("o")
    around = on.select("raster_id", "label", "y", "x", near).select("raster_id", "label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    edges = around.join(on.select(*KEY, "label"), [*KEY, "label"], "leftanti").groupBy("raster_id", "label").agg(F.count("*").alias("perimeter"))
    half, root = (F.col("_vx") + F.col("_vy")) / 2, F.sqrt(F.pow((F.col("_vx") - F.col("_vy")) / 2, F.lit(2)) + F.col("_vxy") * F.col("_vxy"))
    major, minor = 4 * F.sqrt(half + root), 4 * F.sqrt(F.greatest(F.lit(0.0), half - root))
    out = g.join(edges, ["raster_id", "label"])
    box = (F.col("ymax") - F.col("ymin") + 1) * (F.col("xmax") - F.col("xmin") + 1)
    return out.select(
        "raster_id", "label", "area", (F.sqrt(4 * F.col("area") / math.pi) * um_per_px).alias("eq_diameter"), "cy", "cx", "ymin", "ymax", "xmin", "xmax", (F.col("area") / box).alias("extent"),
        major.alias("major_axis"), minor.alias("minor_axis"), F.degrees(F.atan2(2 * F.col("_vxy"), F.col("_vx") - F.col("_vy")) / 2).alias("orientation"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(minor * minor, major * major), F.lit(1.0)))).alias("eccentricity"), "perimeter",
        (4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).alias("circularity"), "mean_intensity", "min_intensity", "max_intensity",
    )


@operator("sci_marker_analysis")
def marker_analysis(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").groupBy("raster_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("area"))


@operator("feat_shape_gate")
def shape_gate(mask: DataFrame, min_size: int = 1, min_circularity: float | None = None, max_aspect: float | None = None, max_eccentricity: float | None = None) -> DataFrame:
    """Components with `kept`: whether they pass each shape test that is given."""
    p = region_props(component_labels(mask)).where(F.col("area") >= min_size)
    aspect = F.greatest(F.col("ymax") - F.col("ymin") + 1, F.col("xmax") - F.col("xmin") + 1) / F.least(F.col("ymax") - F.col("ymin") + 1, F.col("xmax") - F.col("xmin") + 1)
    ok: Column = F.lit(True)
    ok = ok & (F.col("circularity") >= min_circularity) if min_circularity is not None else ok
    ok = ok & (aspect <= max_aspect) if max_aspect is not None else ok
    ok = ok & (F.col("eccentricity") <= max_eccentricity) if max_eccentricity is not None else ok
    return p.withColumn("aspect", aspect).withColumn("kept", ok)


@operator("filter_blob_filter")
def blob_filter(mask: DataFrame, min_area: int = 1, max_area: int | None = None, circularity: tuple[float, float] = (0.0, 10.0), connectivity: int = 8) -> DataFrame:
    found = component_labels(mask, connectivity)
    p = region_props(found).where(F.col("area") >= min_area).where(F.col("circularity").between(*circularity))
    p = p.where(F.col("area") <= max_area) if max_area is not None else p
    return _as_mask(mask, found.join(p.select("raster_id", "label"), ["raster_id", "label"], "leftsemi"))


@operator("feat_visual_size_gate")
def size_gate(labels: DataFrame, tolerance: float = 0.5, min_size: int = 1) -> DataFrame:
    """Regions with `kept`: whether the area is within a share of the raster's median area."""
    a = areas(labels).where(F.col("area") >= min_size)
    m = a.groupBy("raster_id").agg(F.median("area").alias("median_area"))
    return a.join(m, "raster_id").withColumn("kept", F.col("area").between(F.col("median_area") * (1 - tolerance), F.col("median_area") * (1 + tolerance)))


@operator("obj_extractor")
def object_extractor(mask: DataFrame, min_area: int = 1) -> DataFrame:
    return region_props(component_labels(mask)).where(F.col("area") >= min_area)


@operator("sci_robust_bbox")
def robust_bbox(mask: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """The box between a lower and an upper percentage of the set pixels' coordinates, and how many lie outside it."""
    on = mask.where("v > 0")
    p = lambda c, q: F.percentile(c, F.lit(q))
    b = on.groupBy("raster_id").agg(p("x", tolerance / 100).alias("x0"), p("x", 1 - tolerance / 100).alias("x1"), p("y", tolerance / 100).alias("y0"), p("y", 1 - tolerance / 100).alias("y1"))
    outside = ~(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return on.join(b, "raster_id").groupBy("raster_id", "x0", "x1", "y0", "y1").agg(F.count_if(outside).alias("n_rejected")).select("raster_id", F.col("x0").alias("box_x"), F.col("y0").alias("box_y"), (F.col("x1") - F.col("x0")).alias("box_w"), (F.col("y1") - F.col("y0")).alias("box_h"), "n_rejected")


@operator("sci_curve_trace")
def curve_trace(mask: DataFrame, axis: str = "x", aggregate: str = "median") -> DataFrame:
    """One place per column (or row): the median, mean, first or last set pixel."""
    other = "y" if axis == "x" else "x"
    form = {"median": F.median, "mean": F.avg, "first": F.min, "last": F.max}[aggregate]
    return mask.where("v > 0").groupBy("raster_id", axis).agg(form(other).cast("double").alias(other))


@operator("sci_axis_calibration")
def axis_calibration(points: DataFrame, x_px: tuple[float, float], x_values: tuple[float, float] | tuple[str, str], y_px: tuple[float, float], y_values: tuple[float, float]) -> DataFrame:
    """Pixel points (x, y) to values by two references per axis; x references given as ISO dates give dates."""
    part = lambda c, px: (F.col(c) - px[0]) / (px[1] - px[0])
    if isinstance(x_values[0], str):
        start, end = (F.to_date(F.lit(v)) for v in x_values)
        x = F.date_add(start, F.floor(part("x", x_px) * F.date_diff(end, start) + 0.5).cast("int"))
    else:
        x = x_values[0] + part("x", x_px) * (x_values[1] - x_values[0])
    return points.withColumns({"x_value": x, "y_value": y_values[0] + part("y", y_px) * (y_values[1] - y_values[0])})


@operator("feat_distance_transform")
def distance_transform(mask: DataFrame) -> DataFrame:
    """Euclidean distance of set pixels to the nearest unset one; 0 where unset, null in rasters without one."""
    d = distances(mask.where("v > 0"), mask.where("v <= 0"))
    return mask.join(d, KEY, "left").select(*KEY, F.when(F.col("v") <= 0, 0.0).otherwise(F.col("distance")).alias("v"))


def boundary(mask: DataFrame) -> DataFrame:
    """Set pixels that a cross-shaped erosion removes."""
    e = erode(mask, 3, "cross").withColumnRenamed("v", "_e")
    return mask.join(e, KEY).where("v > 0 and _e <= 0").select(*KEY)


@operator("sci_hausdorff")
def hausdorff(a: DataFrame, b: DataFrame, percentile: float = 100) -> DataFrame:
    """Directed distances of two masks' set pixels at a percentile by rank, and the larger."""
    def directed(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("raster_id")
        d = distances(p.where("v > 0"), q.where("v > 0")).withColumn("_i", F.row_number().over(w.orderBy("distance")) - 1).withColumn("_n", F.count("*").over(w))
        at = F.least(F.col("_n") - 1, F.floor(F.lit(percentile / 100) * F.col("_n")))
        return d.groupBy("raster_id").agg(F.max(F.when(F.col("_i") == at, F.col("distance"))).alias(name))

    both = directed(a, b, "h_ab").join(directed(b, a, "h_ba"), "raster_id")
    return both.withColumn("h_max", F.greatest("h_ab", "h_ba"))


@operator("sci_boundary_f1")
def boundary_f1(pred: DataFrame, truth: DataFrame, tolerance: int = 1) -> DataFrame:
    """Share of each mask's boundary within a tolerance of the other's; empty boundaries count as matched."""
    p, t = boundary(pred), boundary(truth)

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        near = a.join(distances(a, b), KEY, "left").withColumn("_ok", F.coalesce(F.col("distance") <= tolerance, F.lit(False)))
        return near.groupBy("raster_id").agg(F.avg(F.col("_ok").cast("double")).alias(name))

    rasters = pred.select("raster_id").distinct()
    d = rasters.join(share(p, t, "precision"), "raster_id", "left").join(share(t, p, "recall"), "raster_id", "left").fillna(1.0)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return d.withColumn("boundary_f1", f1)


@operator("mask_depth_bands")
def depth_bands(outer: DataFrame, inner: DataFrame, bands: int = 3) -> DataFrame:
    """Pixels of the outer mask outside the inner one by where they lie between the two: bands 1 to n from the inside out."""
    ring = outer.where("v > 0").join(inner.where("v > 0").select(*KEY), KEY, "leftanti")
    d_in = distances(ring, inner.where("v > 0")).withColumnRenamed("distance", "_i")
    d_out = distances(ring, outer.where("v <= 0")).withColumnRenamed("distance", "_o")
    d = d_in.join(d_out, KEY).withColumn("depth", F.col("_i") / (F.col("_i") + F.col("_o") + 1e-6))
    return d.select(*KEY, "depth", (F.least(F.floor(F.col("depth") * bands), F.lit(bands - 1)) + 1).cast("int").alias("band"))


@operator("feat_peak_markers")
def peak_markers(df: DataFrame, sigma_size: int = 3, min_distance: int = 0) -> DataFrame:
    """Local maxima of the smoothed raster that rise over the local minimum by 2 % of the range; the strongest stays, those nearer than min_distance to it go, and so on among the rest."""
    s = gaussian_blur(df, sigma_size).withColumn("v", F.round("v", 6)) if sigma_size > 1 else df  # plateaus stay level however the sums are ordered
    top, low = dilate(s, 3).withColumnRenamed("v", "_t"), erode(s, 3).withColumnRenamed("v", "_l")
    span = s.groupBy("raster_id").agg((F.max("v") - F.min("v")).alias("_s"))
    peaks = s.join(top, KEY).join(low, KEY).join(span, "raster_id").where("v = _t and v > _l + 0.02 * _s").select(*KEY, F.lit(255.0).alias("v"))
    marks = component_labels(peaks).groupBy("raster_id", "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y"), F.min("x").alias("x"))
    marks = marks.join(s, KEY, "left").select("raster_id", "label", "cy", "cx", F.coalesce("v", F.lit(0.0)).alias("strength"))
    if min_distance <= 0:
        return marks
    kept = spaced(marks.select("raster_id", F.col("label").alias("id"), F.col("cy").alias("y"), F.col("cx").alias("x"), "strength"), min_distance)
    return marks.join(kept.select("raster_id", F.col("id").alias("label")), ["raster_id", "label"], "leftsemi")


@operator("feat_seeds_from_boundaries")
def seeds(mask: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Components of where the distance to the background exceeds a share of the raster's largest."""
    d = distance_transform(mask)
    top = d.groupBy("raster_id").agg(F.max("v").alias("_t"))
    return connected(d.join(top, "raster_id").select(*KEY, F.when(F.col("v") > threshold * F.col("_t"), 255.0).otherwise(0.0).alias("v")))


@operator("feat_watershed")
def watershed(markers: DataFrame, mask: DataFrame, gray: DataFrame | None = None) -> DataFrame:
    """Labels that flood the mask from the markers: a pixel goes to the marker from which it is reached over the lowest grey level, then in fewer steps, then with the smaller label. Without gray all pixels lie equally high.

    In a round pixels that have changed offer their label to their eight neighbours, until none changes,
    so a round's work follows the flood's edge. Lineage is cut each round.
    """
    area = mask.where("v > 0").select(*KEY)
    area = area.join(gray.select(*KEY, F.col("v").alias("_g")), KEY, "left") if gray is not None else area.withColumn("_g", F.lit(0.0))
    start = F.when(F.col("label") > 0, F.struct(F.col("_g").alias("cost"), F.lit(0).alias("steps"), F.col("label").cast("int").alias("label")))
    state = cut(area.join(markers.select(*KEY, "label"), KEY, "left").select(*KEY, "_g", start.alias("s"), (F.col("label") > 0).alias("new")))
    o = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in RING])).alias("o")
    while True:
        edge = state.where("new").select(*KEY, "s", o)
        if edge.isEmpty():
            break
        sent = edge.select("raster_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.struct("s.cost", (F.col("s.steps") + 1).alias("steps"), "s.label").alias("s"))
        best = sent.groupBy(*KEY).agg(F.min("s").alias("_s"))
        offered = F.when(F.col("_s").isNotNull(), F.struct(F.greatest("_s.cost", "_g").alias("cost"), F.col("_s.steps").alias("steps"), F.col("_s.label").alias("label")))
        d = state.drop("new").join(best, KEY, "left").withColumn("_o", offered)
        state = cut(d.select(*KEY, "_g", F.least("s", "_o").alias("s"), F.coalesce(F.col("s").isNull() & F.col("_o").isNotNull() | (F.col("_o") < F.col("s")), F.lit(False)).alias("new")))
    return mask.select(*KEY).join(state.select(*KEY, "s.label"), KEY, "left").fillna(0, ["label"])


@operator("sci_general_segmenter")
def general_segmenter(gray: DataFrame, smoothing: int = 3, min_size: int = 2) -> DataFrame:
    """Smoothing, Otsu's threshold, opening, labels and an area filter."""
    from .pixels import threshold_adv

    m = threshold_adv(gaussian_blur(gray, smoothing), "otsu").select(*KEY, "v")
    return marker_filter(connected(m), min_size)


def _traced(border: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer border's pixels clockwise from the first in row order, by the next set pixel around each one, beginning after the unset one that it was reached from."""
    start = min(border)
    path, at, back = [], start, 6  # RING's place of the unset pixel to the left
    first = None
    while True:
        for k in range(1, 9):
            i = (back + k) % 8
            if (to := (at[0] + RING[i][0], at[1] + RING[i][1])) in border:
                break
        else:
            return [start]
        if (at, i) == first:
            return path
        first = first or (at, i)
        path.append(at)
        unset = RING[(i - 1) % 8]
        back = RING.index((at[0] + unset[0] - to[0], at[1] + unset[1] - to[1]))
        at = to


@operator("feat_find_contours")
def find_contours(mask: DataFrame) -> DataFrame:
    """Each component's outer border as pts in order along it (a pixel that the border passes twice is there twice), with area, border length and circularity. A component's border pixels, and not its area, meet in one task, as they do in its row."""
    labels = cut(component_labels(mask))
    props = region_props(labels).select("raster_id", "label", "area", "cy", "cx", "perimeter", "circularity", "eccentricity")
    n = around(labels, "label", RING[::2])
    border = n.where(" or ".join(f"n{i} is null" for i in range(4))).select("raster_id", "label", "y", "x")

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        path = _traced(set(zip(rows["y"].tolist(), rows["x"].tolist(), strict=True)))
        return pd.DataFrame({"raster_id": rows["raster_id"].iloc[:1], "label": rows["label"].iloc[:1], "pts": [[{"x": x, "y": y} for y, x in path]]})

    kinds = {f.name: f.dataType.simpleString() for f in border.schema}
    pts = border.groupBy("raster_id", "label").applyInPandas(trace, f"raster_id {kinds['raster_id']}, label {kinds['label']}, pts array<struct<x:{kinds['x']},y:{kinds['y']}>>")
    return props.join(pts, ["raster_id", "label"])


@operator("mask_to_svg")
def mask_to_svg(mask: DataFrame) -> DataFrame:
    """(raster_id, label, path): closed SVG paths of the contours."""
    points = F.array_join(F.transform("pts", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " L ")
    return find_contours(mask).select("raster_id", "label", F.concat(F.lit("M "), points, F.lit(" Z")).alias("path"))


def crops(pixels: DataFrame, boxes: DataFrame, pad: int = 0) -> DataFrame:
    """boxes(raster_id, crop_id, ymin, ymax, xmin, xmax) to the pixels of each, with coordinates from the box's corner: an equi-join on the raster and the box's rows."""
    rows = boxes.select("raster_id", "crop_id", F.explode(F.sequence(F.col("ymin") - pad, F.col("ymax") + pad)).alias("y"), (F.col("ymin") - pad).alias("_y0"), (F.col("xmin") - pad).alias("_x0"), (F.col("xmax") + pad).alias("_x1"))
    d = pixels.join(rows, ["raster_id", "y"]).where((F.col("x") >= F.col("_x0")) & (F.col("x") <= F.col("_x1")))
    rest = [c for c in pixels.columns if c not in KEY]
    return d.select("raster_id", "crop_id", (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"), *rest)


@operator("export_crops")
def export_crops(pixels: DataFrame, boxes: DataFrame, pad: int = 0) -> DataFrame:
    return crops(pixels, boxes, pad)


@operator("sci_export_particles")
def export_particles(pixels: DataFrame, labels: DataFrame, pad: int = 0) -> DataFrame:
    b = region_boxes(labels).withColumnRenamed("label", "crop_id")
    return crops(pixels, b, pad)


def region_boxes(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").groupBy("raster_id", "label").agg(F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("x").alias("xmin"), F.max("x").alias("xmax"))


@operator("merge_points")
def merge_points(points: DataFrame, radius: float) -> DataFrame:
    """points(raster_id, point_id, x, y) nearer than the radius are linked; one centroid for each group of linked points. A grid of cells of that size bounds what is compared."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    q = p.select("raster_id", (F.col("_cx")).alias("_cx0"), F.col("_cy").alias("_cy0"), F.col("point_id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), around)
    q = q.select("raster_id", (F.col("_cx0") + F.col("o.i")).alias("_cx"), (F.col("_cy0") + F.col("o.j")).alias("_cy"), "_id", "_x", "_y")
    near = p.join(q, ["raster_id", "_cx", "_cy"]).where((F.col("point_id") < F.col("_id")) & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) < radius))
    links = near.select(F.struct("raster_id", "point_id").alias("a"), F.struct("raster_id", F.col("_id").alias("point_id")).alias("b"))
    found = connected_components(links)
    d = points.withColumn("id", F.struct("raster_id", "point_id")).join(found, "id", "left").withColumn("_c", F.coalesce("component", "id"))
    return d.groupBy("_c").agg(F.first("raster_id").alias("raster_id"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).select("raster_id", F.col("_c.point_id").alias("point_id"), "x", "y", "n")


def smooth_labels(labels: DataFrame, size: int = 3) -> DataFrame:
    """The label whose indicator has the largest local mean over a threshold of one half, else the pixel's own."""
    own = labels.where("label > 0").select("raster_id", "label").distinct()
    planes = labels.select(*KEY, F.col("label").alias("_l")).join(own, "raster_id").select(F.struct("raster_id", "label").alias("raster_id"), "y", "x", (F.col("_l") == F.col("label")).cast("double").alias("v"))
    won = box_mean(planes, size).where("v > 0.5").select(F.col("raster_id.raster_id").alias("raster_id"), "y", "x", F.col("raster_id.label").alias("_n"))
    return labels.join(won, KEY, "left").select(*KEY, F.coalesce("_n", "label").alias("label"))
