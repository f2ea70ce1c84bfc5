"""Pixel-wise and whole-raster operators.

A colour raster is a table (raster_id, y, x, b, g, r) and a grey one or a mask (raster_id, y, x, v),
values 0 to 255 as doubles. Pixel-wise operators are projections without a shuffle; whole-raster ones
aggregate by raster_id with partial sums and join one row per raster back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from ..registry import operator

BANDS = ("b", "g", "r")
KEY = ["raster_id", "y", "x"]


def saturate(c: Column) -> Column:
    """Rounded half to even and held in 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(c)))


def each_band(df: DataFrame, form) -> DataFrame:
    return df.withColumns({c: form(F.col(c)) for c in ((*BANDS,) if "b" in df.columns else ("v",))})


def with_raster_stats(df: DataFrame, **stats: Column) -> DataFrame:
    return df.join(df.groupBy("raster_id").agg(*[c.alias(n) for n, c in stats.items()]), "raster_id")


@operator("filter_gray")
def gray(image: DataFrame) -> DataFrame:
    return image.select(*KEY, saturate(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")).alias("v"))


@operator("filter_threshold")
def threshold(gray_: DataFrame, level: float = 127) -> DataFrame:
    return gray_.withColumn("v", F.when(F.col("v") > level, 255.0).otherwise(0.0))


@operator("plugin_invert")
def invert(image: DataFrame) -> DataFrame:
    return each_band(image, lambda c: 255 - c)


@operator("plugin_invert_mask")
def invert_mask(mask: DataFrame) -> DataFrame:
    return each_band(mask, lambda c: 255 - c)


@operator("plugin_brightness_contrast")
def brightness_contrast(image: DataFrame, brightness: float = 0, contrast: float = 0) -> DataFrame:
    a = 1 + contrast / (100 if contrast >= 0 else 200)
    return each_band(image, lambda c: saturate(c * a + brightness))


@operator("cv_gamma")
def gamma(image: DataFrame, gamma: float = 1.0, linearise: bool = False) -> DataFrame:
    power = gamma if linearise else 1 / gamma
    return each_band(image, lambda c: saturate(F.pow(c / 255, F.lit(power)) * 255))


@operator("cv_levels")
def levels(image: DataFrame, in_black: float = 0, in_white: float = 255, gamma: float = 1.0, out_black: float = 0, out_white: float = 255) -> DataFrame:
    t = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - in_black) / max(1e-6, in_white - in_black)))
    return each_band(image, lambda c: saturate(out_black + F.pow(t(c), F.lit(1 / gamma)) * (out_white - out_black)))


@operator("cv_colorspace")
def colour_space(image: DataFrame) -> DataFrame:
    """Adds h (0..180), s, v and lab_l, lab_a, lab_b on 8-bit scales (sRGB primaries, D65 white)."""
    b, g, r = (F.col(c) for c in BANDS)
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / F.nullif(d, F.lit(0.0))).when(top == g, 120 + 60 * (b - r) / F.nullif(d, F.lit(0.0))).otherwise(240 + 60 * (r - g) / F.nullif(d, F.lit(0.0)))
    hsv = {"h": saturate(F.pmod(hue, F.lit(360.0)) / 2), "s": F.when(top == 0, 0.0).otherwise(saturate(255 * d / F.nullif(top, F.lit(0.0)))), "v": top}
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    x = (0.412453 * lin(r) + 0.357580 * lin(g) + 0.180423 * lin(b)) / 0.950456
    y = 0.212671 * lin(r) + 0.715160 * lin(g) + 0.072169 * lin(b)
    z = (0.019334 * lin(r) + 0.119193 * lin(g) + 0.950227 * lin(b)) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    lab_l = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return image.withColumns(hsv | {"lab_l": saturate(lab_l * 255 / 100), "lab_a": saturate(500 * (f(x) - f(y)) + 128), "lab_b": saturate(200 * (f(y) - f(z)) + 128)})


@operator("cv_white_balance")
def white_balance(image: DataFrame, method: str = "gray_world", percentile: float = 99.0, gains: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Gray world (band means meet), white patch (band percentiles meet 255) or manual gains."""
    if method == "manual":
        return image.withColumns({c: saturate(F.col(c) * k) for c, k in zip(BANDS, gains, strict=True)})
    form = F.avg if method == "gray_world" else (lambda c: F.percentile(c, F.lit(percentile / 100)))
    d = with_raster_stats(image, **{f"_{c}": form(c) for c in BANDS})
    goal = (F.col("_b") + F.col("_g") + F.col("_r")) / 3 if method == "gray_world" else F.lit(255.0)
    return d.withColumns({c: saturate(F.col(c) * goal / F.greatest(F.col(f"_{c}"), F.lit(1e-6))) for c in BANDS}).drop("_b", "_g", "_r")


@operator("filter_img_clamp")
def clamp(image: DataFrame, low: float = 0, high: float = 255) -> DataFrame:
    return each_band(image, lambda c: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


@operator("plugin_channel_split")
def channel_split(image: DataFrame, band: str) -> DataFrame:
    return image.select(*KEY, F.col(band).alias("v"))


@operator("plugin_channel_merge")
def channel_merge(b: DataFrame, g: DataFrame, r: DataFrame) -> DataFrame:
    planes = [p.select(*KEY, F.col("v").alias(n)) for p, n in zip((b, g, r), BANDS, strict=True)]
    out = planes[0].join(planes[1], KEY, "outer").join(planes[2], KEY, "outer")
    return out.fillna(0.0, list(BANDS))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    bands = [c for c in a.columns if c not in KEY]
    return a.join(b.select(*KEY, *[F.col(c).alias(f"_{c}") for c in bands]), KEY)


BLENDS = {
    "normal": lambda a, b: b,
    "multiply": lambda a, b: a * b / 255,
    "screen": lambda a, b: 255 - (255 - a) * (255 - b) / 255,
    "overlay": lambda a, b: F.when(a < 128, 2 * a * b / 255).otherwise(255 - 2 * (255 - a) * (255 - b) / 255),
    "darken": F.least,
    "lighten": F.greatest,
    "difference": lambda a, b: F.abs(a - b),
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
}


@operator("plugin_blend_modes")
def blend(a: DataFrame, b: DataFrame, mode: str = "normal", opacity: float = 1.0) -> DataFrame:
    bands = [c for c in a.columns if c not in KEY]
    mixed = lambda c: saturate(F.col(c) * (1 - opacity) + BLENDS[mode](F.col(c), F.col(f"_{c}")) * opacity)
    return _paired(a, b).select(*KEY, *[mixed(c).alias(c) for c in bands])


@operator("util_image_math")
def image_power(image: DataFrame, power: float = 1.0) -> DataFrame:
    return each_band(image, lambda c: saturate(F.pow(c / 255, F.lit(power)) * 255))


def _ramp(t: Column, stops: list[tuple[float, float, float]]) -> list[Column]:
    """Piecewise-linear colour at t in 0..1 between equally spaced (r, g, b) stops."""
    at = F.least(F.floor(t * (len(stops) - 1)), F.lit(len(stops) - 2)).cast("int")
    part = t * (len(stops) - 1) - at
    out = []
    for k in range(3):
        low, high = F.array(*[F.lit(float(s[k])) for s in stops[:-1]]), F.array(*[F.lit(float(s[k])) for s in stops[1:]])
        out.append(saturate(F.get(low, at) * (1 - part) + F.get(high, at) * part))
    return out


#: Colour stops (r, g, b) from low to high.
COLORMAPS = {
    "gray": [(0, 0, 0), (255, 255, 255)],
    "jet": [(0, 0, 128), (0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0), (128, 0, 0)],
    "hot": [(0, 0, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255)],
    "viridis": [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)],
}


@operator("sci_colormap")
def colour_map(gray_: DataFrame, colormap: str = "viridis", auto_range: bool = True, in_min: float = 0, in_max: float = 255, invert: bool = False) -> DataFrame:
    d = with_raster_stats(gray_, _lo=F.min("v"), _hi=F.max("v")) if auto_range else gray_.withColumns({"_lo": F.lit(float(in_min)), "_hi": F.lit(float(in_max))})
    t = F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - t if invert else t))
    r, g, b = _ramp(t, COLORMAPS[colormap])
    return d.select(*KEY, b.alias("b"), g.alias("g"), r.alias("r"))


@operator("util_colormap")
def simple_colour_map(gray_: DataFrame, map: str = "jet") -> DataFrame:
    return colour_map(gray_, map)


@operator("filter_color_mask")
def colour_mask(image: DataFrame, colour: tuple[float, float, float], threshold: float = 30) -> DataFrame:
    """255 where the colour (b, g, r) is within a Euclidean distance."""
    d = F.sqrt(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(BANDS, colour, strict=True)), F.lit(0.0)))
    return image.select(*KEY, F.when(d <= threshold, 255.0).otherwise(0.0).alias("v"))


@operator("filter_float_threshold")
def float_threshold(raw: DataFrame, low: float, high: float, invert: bool = False) -> DataFrame:
    inside = F.col("v").between(low, high)
    return raw.withColumn("v", F.when(~inside if invert else inside, 255.0).otherwise(0.0))


@operator("plugin_image_to_mask")
def image_to_mask(image: DataFrame) -> DataFrame:
    return gray(image) if "b" in image.columns else image


@operator("plugin_mask_to_image")
def mask_to_image(mask: DataFrame) -> DataFrame:
    return mask.select(*KEY, *[F.col("v").alias(c) for c in BANDS])


@operator("mask_operations")
def mask_operation(a: DataFrame, b: DataFrame, operation: int = 0) -> DataFrame:
    """0: A or B, 1: A without B, others: A and B, by bits."""
    x, y = F.col("v").cast("int"), F.col("_v").cast("int")
    form = {0: x.bitwiseOR(y), 1: x.bitwiseAND(F.lit(255) - y)}.get(operation, x.bitwiseAND(y))
    return _paired(a, b).select(*KEY, form.cast("double").alias("v"))


@operator("util_mask_blend")
def mask_blend(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """b where the mask is 255, a where it is 0, in between a mixture."""
    bands = [c for c in a.columns if c not in KEY]
    d = _paired(a, b).join(mask.select(*KEY, (F.col("v") / 255).alias("_m")), KEY)
    return d.select(*KEY, *[saturate(F.col(c) * (1 - F.col("_m")) + F.col(f"_{c}") * F.col("_m")).alias(c) for c in bands])


@operator("util_image_masking")
def image_masking(image: DataFrame, mask: DataFrame, background: float = 0.0) -> DataFrame:
    bands = [c for c in image.columns if c not in KEY]
    d = image.join(mask.select(*KEY, F.col("v").alias("_m")), KEY, "left")
    return d.select(*KEY, *[F.when(F.col("_m") > 0, F.col(c)).otherwise(F.lit(float(background))).alias(c) for c in bands])


@operator("draw_tint_mask")
def tint_mask(image: DataFrame, mask: DataFrame, colour: tuple[float, float, float] = (0, 0, 255), alpha: float = 0.5) -> DataFrame:
    d = image.join(mask.select(*KEY, F.col("v").alias("_m")), KEY, "left")
    return d.select(*KEY, *[F.when(F.col("_m") > 0, saturate(F.col(c) * (1 - alpha) + v * alpha)).otherwise(F.col(c)).alias(c) for c, v in zip(BANDS, colour, strict=True)])


def size_of(df: DataFrame) -> DataFrame:
    """One row per raster: h, w."""
    return df.groupBy("raster_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def with_size(df: DataFrame) -> DataFrame:
    return df.join(size_of(df), "raster_id")


@operator("util_mask_band")
def mask_band(image: DataFrame, axis: str = "x", start_pct: float = 0, end_pct: float = 100) -> DataFrame:
    """Keeps the part between two percentages along an axis; the rest is 0."""
    at = F.col(axis) * 100.0 / F.col("w" if axis == "x" else "h")
    d = with_size(image)
    bands = [c for c in image.columns if c not in KEY]
    return d.select(*KEY, *[F.when((at >= start_pct) & (at < end_pct), F.col(c)).otherwise(0.0).alias(c) for c in bands])


@operator("util_split_half")
def split_half(image: DataFrame, axis: str = "x", position: float = 50, first: bool = True) -> DataFrame:
    return mask_band(image, axis, 0, position) if first else mask_band(image, axis, position, 101)


@operator("util_compose")
def compose(a: DataFrame, b: DataFrame, mode: str = "side", alpha: float = 0.5, split_pos: float = 50, block: int = 8, gap: int = 0) -> DataFrame:
    """side (b to the right), split, blend, difference or checker."""
    bands = [c for c in a.columns if c not in KEY]
    if mode == "side":
        moved = b.join(size_of(a), "raster_id").withColumn("x", F.col("x") + F.col("w") + gap)
        return a.unionByName(moved.select(*a.columns))
    d = with_size(_paired(a, b))
    first = {"split": F.col("x") * 100.0 / F.col("w") < split_pos, "checker": (F.floor(F.col("x") / block) + F.floor(F.col("y") / block)) % 2 == 0}.get(mode)
    form = {
        "blend": lambda c: saturate(F.col(c) * (1 - alpha) + F.col(f"_{c}") * alpha),
        "difference": lambda c: F.abs(F.col(c) - F.col(f"_{c}")),
    }.get(mode, lambda c: F.when(first, F.col(c)).otherwise(F.col(f"_{c}")))
    return d.select(*KEY, *[form(c).alias(c) for c in bands])


@operator("output_display")
def display(a: DataFrame, b: DataFrame | None = None, mode: str = "side") -> DataFrame:
    return a if b is None else compose(a, b, mode)


@operator("mask_circle")
def mask_circle(image: DataFrame, center: tuple[float, float] = (50, 50), radius: tuple[float, float] = (25, 25), feather: float = 0.0, invert: bool = False) -> DataFrame:
    """An ellipse given in percent of the size; feather is a share of the radius over which it fades."""
    d = with_size(image)
    dx = (F.col("x") - F.col("w") * center[0] / 100) / F.greatest(F.col("w") * radius[0] / 100, F.lit(1e-6))
    dy = (F.col("y") - F.col("h") * center[1] / 100) / F.greatest(F.col("h") * radius[1] / 100, F.lit(1e-6))
    far = F.sqrt(dx * dx + dy * dy)
    v = F.when(far <= 1, 255.0).otherwise(0.0) if feather <= 0 else saturate(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - far) / feather)))
    return d.select(*KEY, (255 - v if invert else v).alias("v"))


@operator("mask_point_query")
def mask_point_query(mask: DataFrame, points: DataFrame) -> DataFrame:
    """points(raster_id, y, x, ...) with inside: whether the mask is set there; false outside the raster."""
    d = points.join(mask.select(*KEY, F.col("v").alias("_m")), KEY, "left")
    return d.withColumn("inside", F.coalesce(F.col("_m") > 0, F.lit(False))).drop("_m")


def histogram256(df: DataFrame) -> DataFrame:
    """(raster_id, bin 0..255, n) of v; at most 256 rows a raster."""
    return df.groupBy("raster_id", F.greatest(F.lit(0), F.least(F.lit(255), F.rint("v"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu_levels(df: DataFrame) -> DataFrame:
    """(raster_id, level): the grey level that separates two classes best; the smallest of equals."""
    h = histogram256(df)
    to, whole = Window.partitionBy("raster_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("raster_id")
    vn = F.col("bin") * F.col("n")
    c = h.select("raster_id", "bin", F.sum("n").over(to).alias("n0"), F.sum(vn).over(to).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(vn).over(whole).alias("s"))
    gap = F.col("s0") / F.col("n0") - F.try_divide(F.col("s") - F.col("s0"), F.col("n") - F.col("n0"))
    between = F.coalesce(F.bround(F.col("n0") * (F.col("n") - F.col("n0")) * gap * gap / (F.col("n") * F.col("n")), 6), F.lit(0.0))
    return c.groupBy("raster_id").agg(F.max_by("bin", F.struct(between, -F.col("bin"))).cast("double").alias("level"))


@operator("feat_threshold_adv")
def threshold_adv(df: DataFrame, mode: str = "otsu", level: float = 127, offset: float = 0) -> DataFrame:
    """binary, binary_inv, otsu, otsu_inv or max (0.7 of the largest value)."""
    kind = mode.removesuffix("_inv")
    if kind == "binary":
        d = df.withColumn("level", F.lit(float(level)))
    elif kind == "otsu":
        d = df.join(otsu_levels(df), "raster_id")
    else:
        d = with_raster_stats(df, level=0.7 * F.max("v"))
    over = F.col("v") > F.col("level") + offset
    return d.select(*KEY, F.when(~over if mode.endswith("_inv") else over, 255.0).otherwise(0.0).alias("v"), (F.col("level") + offset).alias("level"))


@operator("sci_histogram")
def raster_histogram(df: DataFrame, bins: int = 32, log_scale: bool = False) -> DataFrame:
    out = histogram256(df).groupBy("raster_id", F.floor(F.col("bin") * bins / 256).cast("int").alias("bin")).agg(F.sum("n").cast("double").alias("n"))
    return out.withColumn("n", F.log10(1 + F.col("n"))) if log_scale else out


@operator("sci_first_order_stats")
def first_order_stats(df: DataFrame) -> DataFrame:
    h = histogram256(df).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("raster_id")))
    mean = F.sum(F.col("bin") * F.col("p"))
    return h.groupBy("raster_id").agg(mean.alias("mean"), (F.sum(F.col("bin") * F.col("bin") * F.col("p")) - mean * mean).alias("variance"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity"))


@operator("sci_normalizer")
def normalise(df: DataFrame, mode: str = "minmax", p_low: float = 2, p_high: float = 98) -> DataFrame:
    """To 0..1 by minimum and maximum, by z-score / 6 + 0.5, or by percentiles; held in 0..1."""
    v = F.col("v")
    if mode == "zscore":
        out = with_raster_stats(df, _m=F.avg("v"), _s=F.stddev_pop("v")).withColumn("v", F.coalesce(F.try_divide(v - F.col("_m"), F.col("_s")), F.lit(0.0)) / 6 + 0.5).drop("_m", "_s")
    else:
        ends = {"_lo": F.min("v"), "_hi": F.max("v")} if mode == "minmax" else {"_lo": F.percentile("v", F.lit(p_low / 100)), "_hi": F.percentile("v", F.lit(p_high / 100))}
        out = with_raster_stats(df, **ends).withColumn("v", F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")
    return out.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


@operator("sci_roi_stats")
def roi_stats(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = df.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return inside.groupBy("raster_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("count"))


@operator("sci_color_distance")
def colour_distance(image: DataFrame, colour: tuple[float, float, float], metric: str = "l2", threshold: float = 50) -> DataFrame:
    """Distance to a colour (b, g, r): l2, l1, linf or cosine, with a mask of those within the threshold."""
    d = [F.abs(F.col(c) - v) for c, v in zip(BANDS, colour, strict=True)]
    if metric == "l2":
        far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    elif metric == "l1":
        far = d[0] + d[1] + d[2]
    elif metric == "linf":
        far = F.greatest(*d)
    else:
        dot = sum((F.col(c) * v for c, v in zip(BANDS, colour, strict=True)), F.lit(0.0))
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in BANDS), F.lit(0.0))) * math.sqrt(sum(v * v for v in colour))
        far = 1 - F.coalesce(F.try_divide(dot, norm), F.lit(0.0))
    return image.select(*KEY, far.alias("distance")).withColumn("v", F.when(F.col("distance") <= threshold, 255.0).otherwise(0.0))


@operator("sci_delta_e")
def delta_e(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per raster the mean, largest and 95 % (by rank, not interpolated) CIE76 difference."""
    lab = lambda d: colour_space(d).select(*KEY, (F.col("lab_l") * 100 / 255).alias("L"), F.col("lab_a").alias("A"), F.col("lab_b").alias("B"))
    d = _paired(lab(a), lab(b))
    e = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "LAB"), F.lit(0.0)))
    ranked = d.select("raster_id", e.alias("e")).withColumn("i", F.row_number().over(Window.partitionBy("raster_id").orderBy("e")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("raster_id")))
    return ranked.groupBy("raster_id").agg(F.avg("e").alias("delta_e"), F.max("e").alias("de_max"), F.max(F.when(F.col("i") == F.floor(0.95 * F.col("n")), F.col("e"))).alias("de_p95"))


@operator("sci_mask_metrics")
def mask_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    p, t = F.col("v") > 127, F.col("_v") > 127
    c = _paired(pred, truth).groupBy("raster_id").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("raster_id", ratio(tp, tp + fp + fn).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@operator("sci_line_profile")
def line_profile(df: DataFrame, start: tuple[float, float], end: tuple[float, float], samples: int = 32) -> DataFrame:
    """(raster_id, i, v): bilinear values along a line between two points (x, y) in percent."""
    t = F.col("i") / (samples - 1)
    g = size_of(df).select("raster_id", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    g = g.withColumn("px", (start[0] + (end[0] - start[0]) * t) / 100 * (F.col("w") - 1)).withColumn("py", (start[1] + (end[1] - start[1]) * t) / 100 * (F.col("h") - 1))
    return bilinear(df, g, ["raster_id", "i"])


def bilinear(df: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Values of v at points(raster_id, px, py, keys): a join with the four neighbours, weighted; neighbours outside weigh nothing."""
    corners = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])).alias("c")
    p = points.select(*keys, "px", "py", *(["raster_id"] if "raster_id" not in keys else []), corners)
    p = p.withColumn("x", (F.floor("px") + F.col("c.dx")).cast("long")).withColumn("y", (F.floor("py") + F.col("c.dy")).cast("long"))
    weight = (1 - F.abs(F.col("px") - F.col("x"))) * (1 - F.abs(F.col("py") - F.col("y")))
    joined = p.withColumn("weight", weight).where("weight > 0").join(df.select("raster_id", F.col("y").cast("long"), F.col("x").cast("long"), "v").hint("merge"), KEY)  # points may have been made of few rows, and so be estimated as few
    return joined.groupBy(*keys).agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))


@operator("feat_mask_stats")
def mask_stats(mask: DataFrame) -> DataFrame:
    on = F.col("v") > 0
    pick = lambda c: F.when(on, F.col(c))
    return mask.groupBy("raster_id").agg(F.count_if(on).alias("area_px"), F.bround(100.0 * F.count_if(on) / F.count("*"), 4).alias("area_pct"), F.avg(pick("x")).alias("centroid_x"), F.avg(pick("y")).alias("centroid_y"), F.min(pick("x")).alias("xmin"), F.min(pick("y")).alias("ymin"), F.max(pick("x")).alias("xmax"), F.max(pick("y")).alias("ymax"))


@operator("image_moments")
def image_moments(df: DataFrame) -> DataFrame:
    """Raw moments m00, m10, m01, central moments of order 2, the centroid, and the orientation in degrees."""
    m = lambda p, q: F.sum(F.pow("x", F.lit(p)) * F.pow("y", F.lit(q)) * F.col("v"))
    d = df.groupBy("raster_id").agg(*[m(p, q).alias(f"m{p}{q}") for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))]).where("m00 > 0")
    d = d.withColumn("cx", F.col("m10") / F.col("m00")).withColumn("cy", F.col("m01") / F.col("m00"))
    d = d.withColumn("mu20", F.col("m20") - F.col("cx") * F.col("m10")).withColumn("mu02", F.col("m02") - F.col("cy") * F.col("m01")).withColumn("mu11", F.col("m11") - F.col("cx") * F.col("m01"))
    return d.withColumn("orientation", F.degrees(F.atan2(2 * F.col("mu11"), F.col("mu20") - F.col("mu02")) / 2)).select("raster_id", "m00", "m10", "m01", "cx", "cy", "mu20", "mu02", "mu11", "orientation")


@operator("sci_glcm")
def glcm(df: DataFrame, levels: int = 8, distance: int = 1, angle: float = 0.0, symmetric: bool = True) -> DataFrame:
    """Texture from the co-occurrence of grey levels at an offset: a self-join on shifted coordinates, then counts of level pairs."""
    dx, dy = math.floor(distance * math.cos(math.radians(angle)) + 0.5), math.floor(distance * math.sin(math.radians(angle)) + 0.5)
    q = df.select(*KEY, F.floor(F.col("v") / 255 * (levels - 1)).cast("int").alias("i"))
    moved = q.select("raster_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("i").alias("j"))
    pairs = q.join(moved, KEY).groupBy("raster_id", "i", "j").agg(F.count("*").alias("n"))
    if symmetric:
        pairs = pairs.unionByName(pairs.select("raster_id", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("raster_id", "i", "j").agg(F.sum("n").alias("n"))
    # sums of whole numbers, divided once, so that no order of adding shows
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    s = pairs.groupBy("raster_id").agg(
        F.sum("n").alias("t"), F.sum(n * (i - j) * (i - j)).alias("contrast"), F.sum(n * n).alias("energy"), F.array_sort(F.collect_list("n")).alias("counts"),
        F.sum(n * i).alias("mi"), F.sum(n * j).alias("mj"), F.sum(n * i * i).alias("ii"), F.sum(n * j * j).alias("jj"), F.sum(n * i * j).alias("ij"),
        *[F.sum(F.when(F.abs(i - j) == d, n).otherwise(0)).alias(f"_d{d}") for d in range(levels)],
    )  # at most levels * levels counts
    t = F.col("t")
    near = sum((F.col(f"_d{d}") / (1 + d) for d in range(levels)), F.lit(0.0)) / t
    entropy = F.aggregate("counts", F.lit(0.0), lambda a, c: a - c / t * F.log2(c / t))
    s = s.select("raster_id", (F.col("contrast") / t).alias("contrast"), near.alias("homogeneity"), (F.col("energy") / (t * t)).alias("energy"), entropy.alias("entropy"), *[(F.col(c) / t).alias(c) for c in ("mi", "mj", "ii", "jj", "ij")])
    spread = F.sqrt((F.col("ii") - F.col("mi") * F.col("mi")) * (F.col("jj") - F.col("mj") * F.col("mj")))
    return s.select("raster_id", "contrast", "homogeneity", "energy", "entropy", F.when(spread > 1e-12, (F.col("ij") - F.col("mi") * F.col("mj")) / spread).otherwise(1.0).alias("correlation"))


@operator("feat_spectral_index")
def spectral_index(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a - b) / (a + b + 1e-6) per pixel, with a mask over the threshold."""
    index = (F.col("v") - F.col("_v")) / (F.col("v") + F.col("_v") + 1e-6)
    return _paired(a, b).select(*KEY, index.alias("index")).withColumn("v", F.when(F.col("index") > threshold, 255.0).otherwise(0.0))


@operator("feat_ndwi")
def ndwi(green: DataFrame, nir: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per raster the share (in percent) of pixels whose water index is over the threshold."""
    return spectral_index(green, nir, threshold).groupBy("raster_id").agg(F.bround(100.0 * F.count_if(F.col("v") > 0) / F.count("*"), 4).alias("coverage"))


@operator("geo_spectral_indices")
def spectral_indices(bands: DataFrame) -> DataFrame:
    """bands(raster_id, y, x, nir, red, green, blue, swir) with ndvi, ndwi, evi, mndwi, nbr and bsi; a zero denominator gives null."""
    c = {n: F.col(n) for n in ("nir", "red", "green", "blue", "swir")}
    nd = lambda p, q: F.try_divide(p - q, p + q)
    return bands.withColumns({
        "ndvi": nd(c["nir"], c["red"]), "ndwi": nd(c["green"], c["nir"]), "mndwi": nd(c["green"], c["swir"]), "nbr": nd(c["nir"], c["swir"]),
        "evi": F.try_divide(2.5 * (c["nir"] - c["red"]), c["nir"] + 6 * c["red"] - 7.5 * c["blue"] + 1), "bsi": nd(c["swir"] + c["red"], c["nir"] + c["blue"]),
    })


@operator("geotiff_to_mask")
def band_mask(raster: DataFrame, band: str, threshold: float = 0.0) -> DataFrame:
    return raster.select(*KEY, F.when(F.col(band) > threshold, 255.0).otherwise(0.0).alias("v"))


@operator("geo_band_calc")
def band_calc(raster: DataFrame, expression: str, bands: list[str], clamp: tuple[float, float] | None = None) -> DataFrame:
    """An expression over B1, B2, ... (the bands in order)."""
    v = compile_expression(expression, {f"B{i + 1}": F.col(b) for i, b in enumerate(bands)}).cast("double")
    return raster.select(*KEY, (F.greatest(F.lit(float(clamp[0])), F.least(F.lit(float(clamp[1])), v)) if clamp else v).alias("v"))


@operator("sci_channel_expr")
def channel_expr(image: DataFrame, expression: str, clamp: tuple[float, float] | None = None) -> DataFrame:
    """An expression over R G B H S V L A_lab B_lab."""
    d = colour_space(image)
    names = {"R": "r", "G": "g", "B": "b", "H": "h", "S": "s", "V": "v", "L": "lab_l", "A_lab": "lab_a", "B_lab": "lab_b"}
    v = compile_expression(expression, {n: F.col(c) for n, c in names.items()}).cast("double")
    return d.select(*KEY, (F.greatest(F.lit(float(clamp[0])), F.least(F.lit(float(clamp[1])), v)) if clamp else v).alias("v"))


@operator("sci_region_color_stats")
def region_colour_stats(image: DataFrame, labels: DataFrame) -> DataFrame:
    d = image.join(labels.where("label > 0").select(*KEY, "label"), KEY)
    return d.groupBy("raster_id", "label").agg(F.count("*").alias("area"), *[f(c).alias(f"{n}_{c}") for c in BANDS for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@operator("sci_cluster_heatmap")
def cluster_heatmap(labels: DataFrame, regions: DataFrame, feature: str) -> DataFrame:
    """Each labelled pixel with its region's feature."""
    return labels.join(regions.select("raster_id", "label", F.col(feature).cast("double").alias("v")), ["raster_id", "label"]).select(*KEY, "v")


@operator("plugin_pixelate")
def pixelate(df: DataFrame, block: int = 4) -> DataFrame:
    """Each block at its mean."""
    cell = lambda d: d.withColumn("_by", F.floor(F.col("y") / block)).withColumn("_bx", F.floor(F.col("x") / block))
    means = cell(df).groupBy("raster_id", "_by", "_bx").agg(saturate(F.avg("v")).alias("v"))
    return cell(df.drop("v")).join(means, ["raster_id", "_by", "_bx"]).select(*KEY, "v")


def _unit(seed: int, salt: int) -> Column:
    return (F.pmod(F.xxhash64(*[F.col(c) for c in KEY], F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)


def _normal(seed: int) -> Column:
    return F.sqrt(-2 * F.log(_unit(seed, 1))) * F.cos(2 * math.pi * _unit(seed, 2))


@operator("filter_noise_gaussian")
def noise_gaussian(df: DataFrame, sigma: float = 25, seed: int = 42) -> DataFrame:
    return each_band(df, lambda c: saturate(c + sigma * _normal(seed)))


@operator("filter_noise_salt_pepper")
def noise_salt_pepper(df: DataFrame, amount: float = 5, seed: int = 42) -> DataFrame:
    p = amount / 100
    return each_band(df, lambda c: F.when(_unit(seed, 3) < p / 2, 0.0).when(_unit(seed, 3) > 1 - p / 2, 255.0).otherwise(c))


@operator("filter_noise_speckle")
def noise_speckle(df: DataFrame, intensity: float = 20, seed: int = 42) -> DataFrame:
    return each_band(df, lambda c: saturate(c * (1 + intensity / 100 * _normal(seed))))


@operator("filter_glitch")
def glitch(image: DataFrame, shift: int = 4, intensity: float = 0.2, seed: int = 42) -> DataFrame:
    """In a share of the rows, red moves right and blue left, wrapping around."""
    row = F.pmod(F.xxhash64("raster_id", "y", F.lit(seed)), F.lit(1000)) < int(intensity * 1000)
    d = with_size(image).withColumn("_s", F.when(row, shift).otherwise(0))
    plane = lambda c, k: d.select("raster_id", "y", F.pmod(F.col("x") + F.col("_s") * k, F.col("w")).alias("x"), F.col(c))
    return plane("b", -1).join(plane("g", 0), KEY).join(plane("r", 1), KEY).select(*KEY, *BANDS)


@operator("filter_auto_polarity")
def auto_polarity(df: DataFrame, border_pct: float = 5, target: float = 127) -> DataFrame:
    """Inverts a raster whose border's mean is not over the target."""
    d = with_size(df)
    bw, bh = F.greatest(F.lit(1), F.floor(F.col("w") * border_pct / 100)), F.greatest(F.lit(1), F.floor(F.col("h") * border_pct / 100))
    edge = (F.col("x") < bw) | (F.col("x") >= F.col("w") - bw) | (F.col("y") < bh) | (F.col("y") >= F.col("h") - bh)
    means = d.where(edge).groupBy("raster_id").agg((F.avg("v") <= target).alias("inverted"))
    return df.join(means, "raster_id").select(*KEY, F.when(F.col("inverted"), 255 - F.col("v")).otherwise(F.col("v")).alias("v"), "inverted")


@operator("gen_canvas")
def canvas(rasters: DataFrame, width: int, height: int, pattern: str = "solid", value_min: float = 0, value_max: float = 255, tiles: int = 4, seed: int = 42) -> DataFrame:
    """Patterns for each raster_id: solid, checker, stripes, gradient, rings, dots or noise."""
    px = rasters.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("raster_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    tx, ty = F.floor(F.col("x") * tiles / width), F.floor(F.col("y") * tiles / height)
    cx, cy = (F.col("x") + 0.5) / width - 0.5, (F.col("y") + 0.5) / height - 0.5
    t = {
        "solid": F.lit(1.0), "checker": ((tx + ty) % 2).cast("double"), "stripes": (tx % 2).cast("double"), "gradient": F.col("x") / max(1, width - 1),
        "rings": (F.floor(F.sqrt(cx * cx + cy * cy) * 2 * tiles) % 2).cast("double"), "noise": _unit(seed, 5),
        "dots": F.when(F.pow(F.pmod((F.col("x") + 0.5) * tiles / width, F.lit(1.0)) - 0.5, F.lit(2)) + F.pow(F.pmod((F.col("y") + 0.5) * tiles / height, F.lit(1.0)) - 0.5, F.lit(2)) < 0.0625, 1.0).otherwise(0.0),
    }[pattern]
    return px.withColumn("v", value_min + (value_max - value_min) * t)


@operator("input_solid_color")
def solid_colour(rasters: DataFrame, width: int, height: int, colour: tuple[float, float, float]) -> DataFrame:
    return canvas(rasters, width, height).select(*KEY, *[F.lit(float(v)).alias(c) for c, v in zip(BANDS, colour, strict=True)])


@operator("sci_spectral_gain")
def spectral_gain(magnitude: DataFrame, low: float, mid: float, high: float, low_mid: float = 0.15, mid_high: float = 0.5) -> DataFrame:
    """Gains by distance from the centre, as a share of the half diagonal."""
    d = with_size(magnitude)
    dy, dx = F.col("y") - F.col("h") / 2, F.col("x") - F.col("w") / 2
    r = F.sqrt(dx * dx + dy * dy) / F.sqrt((F.col("w") * F.col("w") + F.col("h") * F.col("h")) / 4)
    return d.select(*KEY, (F.col("v") * F.when(r < low_mid, low).when(r < mid_high, mid).otherwise(high)).alias("v"))


@operator("analysis_flow_viz")
def flow_colours(flow: DataFrame) -> DataFrame:
    """flow(dy, dx) to hue (0..180, direction) and value (0..255, length against the raster's largest)."""
    d = with_raster_stats(flow.withColumn("m", F.hypot("dx", "dy")), _top=F.max("m"))
    return d.select(*KEY, F.floor(F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0)) / 2).alias("h"), saturate(255 * F.coalesce(F.try_divide(F.col("m"), F.col("_top")), F.lit(0.0))).alias("v"))


@operator("geo_land_cover")
def land_cover(classes: DataFrame, land_class: int) -> DataFrame:
    """classes(raster_id, y, x, class) to a mask of one class with its share of the raster."""
    d = classes.withColumn("_hit", F.coalesce((F.col("class") == land_class).cast("double"), F.lit(0.0)))
    return with_raster_stats(d, coverage=F.avg("_hit")).select(*KEY, (F.col("_hit") * 255).alias("v"), "coverage")


@operator("geo_copernicus")
def composite(scenes: DataFrame, how: str = "median") -> DataFrame:
    """scenes(raster_id, band, y, x, scene_ts, v) to one value per pixel: median, mean, min, max or first, missing values left out. Fetching scenes is out of scope without a network."""
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    form = {"median": F.median(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "first": F.min_by(v, F.when(v.isNotNull(), F.col("scene_ts")))}[how]
    return scenes.groupBy("raster_id", "band", "y", "x").agg(form.alias("v"))
