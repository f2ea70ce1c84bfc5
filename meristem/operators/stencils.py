"""Neighbourhood operators on (raster_id, y, x, v).

A stencil pads each raster by mirrored rows and columns (the edge pixel itself is not repeated), emits
every value to the places that it contributes to, and aggregates by place: one shuffle, with partial
sums or extremes before it. Separable means and extremes use two window passes instead, whose cost does
not grow with the window. Border places need the raster's height and width, one small aggregate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from .pixels import KEY, saturate, size_of, with_raster_stats


def _mirrored(name: str, size: str, p: int) -> Column:
    """All places in -p .. size + p - 1 at which a coordinate appears after mirroring."""
    c, last = F.col(name), F.col(size) - 1
    places = F.array(c, F.when((c >= 1) & (c <= p), -c), F.when((c <= last - 1) & (c >= last - p), 2 * last - c))
    return F.explode(F.array_distinct(F.array_compact(places)))


def padded(df: DataFrame, p: int) -> DataFrame:
    """Adds mirrored borders of width p (less than the raster's size); keeps h and w."""
    d = df.join(size_of(df), "raster_id")
    rest = [c for c in df.columns if c not in KEY]
    rows = d.select("raster_id", _mirrored("y", "h", p).alias("y"), "x", *rest, "h", "w")
    return rows.select("raster_id", "y", _mirrored("x", "w", p).alias("x"), *rest, "h", "w")


def stencil(df: DataFrame, kernel: np.ndarray, **aggregates: Column) -> DataFrame:
    """For each pixel, aggregates over its neighbours; `v` is a neighbour's value and `k` the kernel's weight there. Weights that are nan are left out."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    cells = [(i - ry, j - rx, float(kernel[i, j])) for i in range(kernel.shape[0]) for j in range(kernel.shape[1]) if not math.isnan(kernel[i, j])]
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("k")) for dy, dx, w in cells])).alias("o")
    d = padded(df, max(ry, rx)).select("raster_id", "y", "x", "v", "h", "w", offsets)
    d = d.select("raster_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "v", F.col("o.k").alias("k"), "h", "w")
    inside = (F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w"))
    return d.where(inside).groupBy(*KEY).agg(*[c.alias(n) for n, c in aggregates.items()])


def convolve(df: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Correlation with the kernel (zero weights cost nothing)."""
    k = np.where(kernel == 0, np.nan, kernel)
    k[kernel.shape[0] // 2, kernel.shape[1] // 2] = kernel[kernel.shape[0] // 2, kernel.shape[1] // 2]
    return stencil(df, k, v=F.sum(F.col("v") * F.col("k")))


def _passes(df: DataFrame, size: int, form) -> DataFrame:
    """An aggregate over size x size neighbours, rows first and then columns."""
    r = size // 2
    d = padded(df, r)
    across = Window.partitionBy("raster_id", "y").orderBy("x").rowsBetween(-r, r)
    down = Window.partitionBy("raster_id", "x").orderBy("y").rowsBetween(-r, r)
    d = d.withColumn("v", form(F.col("v")).over(across)).where((F.col("x") >= 0) & (F.col("x") < F.col("w")))
    return d.withColumn("v", form(F.col("v")).over(down)).where((F.col("y") >= 0) & (F.col("y") < F.col("h"))).select(*KEY, "v")


def box_mean(df: DataFrame, size: int = 3) -> DataFrame:
    return _passes(df, size | 1, F.avg)


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    size |= 1
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return np.outer(k, k) / k.sum() ** 2


def gaussian_blur(df: DataFrame, size: int = 5, sigma: float = 0.0) -> DataFrame:
    k = gaussian_kernel(size, sigma)
    row = k.sum(axis=0)[None, :]
    return convolve(convolve(df, row), row.T)


SOBEL_X = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
SCHARR_X = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)


@operator("filter_blur")
def blur(df: DataFrame, size: int = 5, method: str = "gaussian", sigma: float = 0.0) -> DataFrame:
    size |= 1
    if method == "gaussian":
        out = gaussian_blur(df, size, sigma)
    elif method == "median":
        out = stencil(df, np.ones((size, size)), v=F.percentile("v", F.lit(0.5)))
    elif method == "bilateral":
        return bilateral(df, size)
    else:
        out = box_mean(df, size)
    return out.withColumn("v", saturate(F.col("v")))


@operator("feat_bilateral")
def bilateral(df: DataFrame, diameter: int = 5, sigma_color: float = 50, sigma_space: float = 50) -> DataFrame:
    """Weights fall with the distance in space and in value from the centre, which is joined to its neighbours' rows."""
    r = diameter // 2
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    k = np.where(yy**2 + xx**2 <= r * r, np.exp(-(yy**2 + xx**2) / (2 * sigma_space**2)), np.nan)
    near = stencil(df, k, _n=F.collect_list(F.struct("v", "k")))
    d = near.join(df, KEY)
    w = lambda n: n["k"] * F.exp(-F.pow(n["v"] - F.col("v"), F.lit(2)) / (2 * sigma_color**2))
    total = F.aggregate("_n", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, n: F.struct((a["s"] + w(n) * n["v"]).alias("s"), (a["w"] + w(n)).alias("w")), lambda a: a["s"] / a["w"])
    return d.select(*KEY, saturate(total).alias("v"))


def gradients(df: DataFrame, kernel: np.ndarray = SOBEL_X) -> DataFrame:
    """(dx, dy): correlations with the kernel and with its transpose, in one pass; places that only one of them reaches have none."""
    r, size = kernel.shape[0] // 2, kernel.shape[0]
    weight = lambda k, i, j: F.lit(float(k[i, j]) if k[i, j] or i == j == r else None).cast("double")
    cells = [F.struct(F.lit(i - r).alias("dy"), F.lit(j - r).alias("dx"), weight(kernel, i, j).alias("kx"), weight(kernel.T, i, j).alias("ky")) for i in range(size) for j in range(size) if kernel[i, j] or kernel[j, i] or i == j == r]
    d = padded(df, r).select("raster_id", "y", "x", "v", "h", "w", F.explode(F.array(*cells)).alias("o"))
    d = d.select("raster_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "v", "o.kx", "o.ky", "h", "w")
    inside = (F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w"))
    sums = d.where(inside).groupBy(*KEY).agg(F.sum(F.col("v") * F.col("kx")).alias("dx"), F.sum(F.col("v") * F.col("ky")).alias("dy"), F.count("kx").alias("_x"), F.count("ky").alias("_y"))
    return sums.where("_x > 0 and _y > 0").drop("_x", "_y")


def stretched(df: DataFrame) -> DataFrame:
    """v to 0..255 by the raster's least and largest."""
    d = with_raster_stats(df, _lo=F.min("v"), _hi=F.max("v"))
    return d.withColumn("v", saturate(255 * F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))).drop("_lo", "_hi")


@operator("plugin_sobel")
def sobel(df: DataFrame, x_dir: bool = True, y_dir: bool = True) -> DataFrame:
    g = gradients(df)
    form = F.hypot("dx", "dy") if x_dir and y_dir else F.abs("dx") if x_dir else F.abs("dy")
    return stretched(g.select(*KEY, form.alias("v")))


@operator("plugin_gradient")
def gradient(df: DataFrame, method: str = "sobel") -> DataFrame:
    return gradients(df, SOBEL_X if method == "sobel" else SCHARR_X).withColumn("magnitude", F.hypot("dx", "dy")).withColumn("angle", F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0)))


LAPLACIANS = {
    "four": np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float),
    "eight": np.array([[1, 1, 1], [1, -8, 1], [1, 1, 1]], float),
    "diffusion": np.array([[0.05, 0.2, 0.05], [0.2, -1, 0.2], [0.05, 0.2, 0.05]]),
}


@operator("filter_laplacian")
def laplacian(df: DataFrame, kernel: str = "four", scale: float = 1.0) -> DataFrame:
    return convolve(df.withColumn("v", F.col("v") / 255), LAPLACIANS[kernel]).withColumn("v", F.col("v") * scale)


@operator("filter_low_pass")
def low_pass(df: DataFrame, size: int = 5, sigma: float = 0.0) -> DataFrame:
    return gaussian_blur(df, size, sigma).withColumn("v", saturate(F.col("v")))


@operator("filter_high_pass")
def high_pass(df: DataFrame, size: int = 5, gain: float = 1.0, bias: bool = True) -> DataFrame:
    low = gaussian_blur(df, size).withColumnRenamed("v", "_low")
    return df.join(low, KEY).select(*KEY, saturate((F.col("v") - F.col("_low")) * gain + (128 if bias else 0)).alias("v"))


def gabor_kernel(size: int, sigma: float, theta: float, wavelength: float, gamma: float, psi: float) -> np.ndarray:
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    a = math.radians(theta)
    xr, yr = x * math.cos(a) + y * math.sin(a), -x * math.sin(a) + y * math.cos(a)
    return np.exp(-(xr**2 + gamma**2 * yr**2) / (2 * sigma**2)) * np.cos(2 * math.pi * xr / wavelength + math.radians(psi))


@operator("filter_gabor")
def gabor(df: DataFrame, size: int = 5, sigma: float = 2.0, theta_deg: float = 0.0, wavelength: float = 4.0, gamma: float = 0.5, psi_deg: float = 0.0) -> DataFrame:
    return stretched(convolve(df, gabor_kernel(size, sigma, theta_deg, wavelength, gamma, psi_deg)))


@operator("feat_gabor_bank")
def gabor_bank(df: DataFrame, n_theta: int = 4, wavelength: float = 4.0, sigma: float = 2.0, size: int = 5) -> DataFrame:
    """(raster_id, i, energy): the mean squared response at each orientation."""
    out = None
    for i in range(n_theta):
        e = convolve(df, gabor_kernel(size, sigma, 180 * i / n_theta, wavelength, 0.5, 0)).groupBy("raster_id").agg(F.avg(F.col("v") * F.col("v")).alias("energy")).withColumn("i", F.lit(i))
        out = e if out is None else out.unionByName(e)
    return out


@operator("filter_dog")
def difference_of_gaussians(df: DataFrame, sigma: float = 1.0, ratio: float = 1.6, size: int = 7) -> DataFrame:
    return convolve(df, gaussian_kernel(size, sigma) - gaussian_kernel(size, sigma * ratio))


@operator("filter_local_stats")
def local_stats(df: DataFrame, window: int = 3, statistic: str = "mean") -> DataFrame:
    mean = box_mean(df, window)
    if statistic == "mean":
        return mean
    square = box_mean(df.withColumn("v", F.col("v") * F.col("v")), window).withColumnRenamed("v", "_s")
    var = F.greatest(F.lit(0.0), F.col("_s") - F.col("v") * F.col("v"))
    return mean.join(square, KEY).select(*KEY, (F.sqrt(var) if statistic == "std" else var).alias("v"))


@operator("cv_adaptive_threshold")
def adaptive_threshold(df: DataFrame, block_size: int = 5, c: float = 2, method: str = "mean", invert: bool = False) -> DataFrame:
    local = (box_mean(df, block_size) if method == "mean" else gaussian_blur(df, block_size)).withColumnRenamed("v", "_m")
    over = F.col("v") > saturate(F.col("_m")) - c
    return df.join(local, KEY).select(*KEY, F.when(~over if invert else over, 255.0).otherwise(0.0).alias("v"))


def _shape(size: int, shape: str) -> np.ndarray:
    size |= 1
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    on = {"rect": np.ones((size, size), bool), "cross": (x == 0) | (y == 0), "ellipse": x**2 + y**2 <= (r + 0.5) ** 2 if r else np.ones((1, 1), bool)}[shape]
    return np.where(on, 1.0, np.nan)


def dilate(df: DataFrame, size: int = 3, shape: str = "rect") -> DataFrame:
    return _passes(df, size | 1, F.max) if shape == "rect" else stencil(df, _shape(size, shape), v=F.max("v"))


def erode(df: DataFrame, size: int = 3, shape: str = "rect") -> DataFrame:
    return _passes(df, size | 1, F.min) if shape == "rect" else stencil(df, _shape(size, shape), v=F.min("v"))


@operator("feat_morphology_adv")
def morphology(df: DataFrame, operation: str = "open", size: int = 3, shape: str = "rect", iterations: int = 1) -> DataFrame:
    """dilate, erode, open, close, gradient, tophat or blackhat."""

    def many(d: DataFrame, f) -> DataFrame:
        for _ in range(iterations):
            d = f(d, size, shape)
        return d

    minus = lambda a, b: a.join(b.withColumnRenamed("v", "_b"), KEY).select(*KEY, (F.col("v") - F.col("_b")).alias("v"))
    opened, closed = lambda: many(many(df, erode), dilate), lambda: many(many(df, dilate), erode)
    return {
        "dilate": lambda: many(df, dilate), "erode": lambda: many(df, erode), "open": opened, "close": closed,
        "gradient": lambda: minus(many(df, dilate), many(df, erode)), "tophat": lambda: minus(df, opened()), "blackhat": lambda: minus(closed(), df),
    }[operation]()


@operator("filter_morphology")
def simple_morphology(df: DataFrame, operation: str = "erode", size: int = 3) -> DataFrame:
    return morphology(df, operation, size)


@operator("filter_directional_morphology")
def directional_morphology(df: DataFrame, axis: str = "x", operation: str = "dilate", size: int = 5) -> DataFrame:
    """Extremes along one axis, within the raster."""
    r, other = size // 2, "y" if axis == "x" else "x"
    w = Window.partitionBy("raster_id", other).orderBy(axis).rowsBetween(-r, r)
    step = lambda d, f: d.withColumn("v", f("v").over(w))
    return {"dilate": lambda: step(df, F.max), "erode": lambda: step(df, F.min), "open": lambda: step(step(df, F.min), F.max), "close": lambda: step(step(df, F.max), F.min)}[operation]()


@operator("mask_outline")
def outline(mask: DataFrame, thickness: int = 3) -> DataFrame:
    return morphology(mask, "gradient", thickness, "ellipse")


@operator("feat_water_refine")
def water_refine(mask: DataFrame, close_size: int = 3, open_size: int = 3, min_area: int = 1) -> DataFrame:
    from .labels import filter_area

    return filter_area(morphology(morphology(mask, "close", close_size, "ellipse"), "open", open_size, "ellipse"), min_area)


@operator("cv_lbp")
def local_binary_pattern(df: DataFrame) -> DataFrame:
    """The 8-neighbour pattern: a bit for each neighbour not under the centre, clockwise from the upper left."""
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    k = np.full((3, 3), np.nan)
    for bit, (dy, dx) in enumerate(ring):
        k[dy + 1, dx + 1] = 1 << bit
    near = stencil(df, k, _n=F.collect_list(F.struct("v", "k")))
    code = F.aggregate("_n", F.lit(0.0), lambda a, n: a + F.when(n["v"] >= F.col("v"), n["k"]).otherwise(F.lit(0.0)))
    return near.join(df, KEY).select(*KEY, code.alias("v"))


@operator("feat_structure_tensor")
def structure_tensor(df: DataFrame, window: int = 3, k_harris: float = 0.04) -> DataFrame:
    """Eigenvalues of the windowed gradient products, and the corner response."""
    g = gradients(df)
    part = lambda c, n: box_mean(g.select(*KEY, c.alias("v")), window).withColumnRenamed("v", n)
    d = part(F.col("dx") * F.col("dx"), "xx").join(part(F.col("dy") * F.col("dy"), "yy"), KEY).join(part(F.col("dx") * F.col("dy"), "xy"), KEY)
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.col("xy") * F.col("xy"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return d.select(*KEY, (half + root).alias("lambda1"), (half - root).alias("lambda2"), (det - k_harris * 4 * half * half).alias("harris"))


@operator("feat_harris")
def harris(df: DataFrame, k: float = 0.04, threshold: float = 0.01) -> DataFrame:
    """Corners: local maxima of the response over a share of the raster's largest."""
    r = structure_tensor(df, 3, k).select(*KEY, F.col("harris").alias("v"))
    d = r.join(dilate(r, 3).withColumnRenamed("v", "_d"), KEY)
    d = with_raster_stats(d, _top=F.max("v"))
    return d.where((F.col("v") == F.col("_d")) & (F.col("v") > threshold * F.col("_top"))).select(*KEY, "v")


@operator("feat_hog")
def hog(df: DataFrame, orientations: int = 8, cell: int = 4) -> DataFrame:
    """(raster_id, cy, cx, bin, weight): gradient magnitudes by unsigned direction in cells."""
    g = gradients(df)
    angle = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    at = F.least(F.lit(orientations - 1), F.floor(angle * orientations / 180 + 1e-9)).cast("int")
    return g.groupBy("raster_id", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"), at.alias("bin")).agg(F.sum(F.hypot("dx", "dy")).alias("weight"))


@operator("sci_focus_metric")
def focus_metric(df: DataFrame) -> DataFrame:
    """Variance of the Laplacian."""
    return convolve(df, LAPLACIANS["four"]).groupBy("raster_id").agg(F.var_pop("v").alias("score"))


@operator("sci_noise_estimate")
def noise_estimate(df: DataFrame, window: int = 3) -> DataFrame:
    """Sigma from the median local variance, the signal-to-noise ratio in decibels, and the fit variance = gain * mean + read."""
    d = local_stats(df, window, "mean").join(local_stats(df, window, "var").withColumnRenamed("v", "var"), KEY)
    s = d.groupBy("raster_id").agg(F.sqrt(F.median("var")).alias("sigma"), F.avg("v").alias("_m"), F.regr_slope("var", "v").alias("gain_a"), F.regr_intercept("var", "v").alias("read_b"))
    return s.select("raster_id", "sigma", (20 * F.log10(F.try_divide(F.col("_m"), F.col("sigma")))).alias("snr_db"), "gain_a", "read_b")


@operator("cv_ssim")
def ssim(a: DataFrame, b: DataFrame, window: int = 3) -> DataFrame:
    """Mean structural similarity and peak signal-to-noise ratio per raster."""
    pair = a.join(b.withColumnRenamed("v", "w_"), KEY)
    part = lambda c, n: box_mean(pair.select(*KEY, c.alias("v")), window).withColumnRenamed("v", n)
    va, vb = F.col("v"), F.col("w_")
    d = part(va, "ma").join(part(vb, "mb"), KEY).join(part(va * va, "aa"), KEY).join(part(vb * vb, "bb"), KEY).join(part(va * vb, "ab"), KEY)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    s = (2 * ma * mb + c1) * (2 * (F.col("ab") - ma * mb) + c2) / ((ma * ma + mb * mb + c1) * (F.col("aa") - ma * ma + F.col("bb") - mb * mb + c2))
    mse = pair.groupBy("raster_id").agg(F.avg((va - vb) * (va - vb)).alias("mse"))
    return d.groupBy("raster_id").agg(F.avg(s).alias("ssim")).join(mse, "raster_id").select("raster_id", "ssim", F.when(F.col("mse") > 0, 10 * F.log10(255.0 * 255.0 / F.col("mse"))).alias("psnr"))


@operator("cv_shadow_highlight")
def shadow_highlight(df: DataFrame, shadows: float = 30, highlights: float = 30, radius: int = 5) -> DataFrame:
    """Lifts what is dark in a blurred copy and lowers what is bright there."""
    d = df.join(gaussian_blur(df, radius).select(*KEY, (F.col("v") / 255).alias("_m")), KEY)
    lift = shadows / 100 * F.pow(1 - F.col("_m"), F.lit(2)) * (255 - F.col("v"))
    drop = highlights / 100 * F.pow(F.col("_m"), F.lit(2)) * F.col("v")
    return d.select(*KEY, saturate(F.col("v") + lift - drop).alias("v"))


@operator("pbr_material_gen")
def material_maps(df: DataFrame, normal_strength: float = 1.0, roughness_window: int = 3, ao_window: int = 5) -> DataFrame:
    """Normal vector, roughness (local deviation) and ambient occlusion (how far a pixel lies under its surroundings) from a height raster."""
    g = gradients(df)
    nx, ny = -F.col("dx") / 255 * normal_strength, -F.col("dy") / 255 * normal_strength
    n = F.sqrt(nx * nx + ny * ny + 1)
    d = g.select(*KEY, (nx / n).alias("nx"), (ny / n).alias("ny"), (1 / n).alias("nz"))
    rough = local_stats(df, roughness_window, "std").withColumnRenamed("v", "roughness")
    ao = df.join(box_mean(df, ao_window).withColumnRenamed("v", "_m"), KEY).select(*KEY, (1 - F.greatest(F.lit(0.0), F.col("_m") - F.col("v")) / 255).alias("ao"))
    return d.join(rough, KEY).join(ao, KEY)


@operator("gen_gray_scott")
def gray_scott(fields: DataFrame, f: float = 0.055, k: float = 0.062, du: float = 1.0, dv: float = 0.5, iterations: int = 2) -> DataFrame:
    """fields(raster_id, y, x, u, v): reaction-diffusion steps with a wrapping 5-point Laplacian. A step is one shuffle; lineage is cut every eighth."""
    from ..session import cut

    d = fields.join(size_of(fields), "raster_id")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in ((0, 0, -1.0), (0, 1, 0.25), (0, -1, 0.25), (1, 0, 0.25), (-1, 0, 0.25))])).alias("o")
    for i in range(iterations):
        e = d.select("raster_id", "y", "x", "u", "v", F.col("h").alias("h_"), F.col("w").alias("w_"), near)
        e = e.select("raster_id", F.pmod(F.col("y") + F.col("o.dy"), F.col("h_")).alias("y"), F.pmod(F.col("x") + F.col("o.dx"), F.col("w_")).alias("x"), (F.col("u") * F.col("o.w")).alias("lu"), (F.col("v") * F.col("o.w")).alias("lv"), F.when(F.col("o.w") < 0, F.col("u")).alias("u"), F.when(F.col("o.w") < 0, F.col("v")).alias("v"), "h_", "w_")
        s = e.groupBy(*KEY).agg(F.sum("lu").alias("lu"), F.sum("lv").alias("lv"), F.max("u").alias("u"), F.max("v").alias("v"), F.max("h_").alias("h"), F.max("w_").alias("w"))
        uvv = F.col("u") * F.col("v") * F.col("v")
        d = s.select(*KEY, (F.col("u") + du * F.col("lu") - uvv + f * (1 - F.col("u"))).alias("u"), (F.col("v") + dv * F.col("lv") + uvv - (f + k) * F.col("v")).alias("v"), "h", "w")
        if i % 8 == 7:
            d = cut(d)
    return d.select(*KEY, "u", "v")


@operator("remove_vignette")
def remove_vignette(df: DataFrame, dark_threshold: float = 10, fill: float = 0.0) -> DataFrame:
    """Masks what lies outside the circle about the lit pixels' centroid with their area."""
    lit = df.where(F.col("v") > dark_threshold).groupBy("raster_id").agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"), (F.count("*") / math.pi).alias("_r2"))
    d = df.join(lit, "raster_id", "left")
    inside = F.coalesce(F.pow(F.col("y") - F.col("_cy"), F.lit(2)) + F.pow(F.col("x") - F.col("_cx"), F.lit(2)) <= F.col("_r2"), F.lit(False))
    return d.select(*KEY, F.when(inside, F.col("v")).otherwise(F.lit(float(fill))).alias("v"), inside.alias("inside"))


@operator("feat_clahe")
def local_equalise(df: DataFrame, grid: int = 2, clip_limit: float = 4.0) -> DataFrame:
    """Histogram equalisation by tile, with counts clipped at clip_limit times the mean and the excess spread evenly. Tiles are not blended."""
    d = df.join(size_of(df), "raster_id").withColumn("_ty", F.floor(F.col("y") * grid / F.col("h"))).withColumn("_tx", F.floor(F.col("x") * grid / F.col("w"))).withColumn("_b", F.rint("v").cast("int"))
    tile = ["raster_id", "_ty", "_tx"]
    h = d.groupBy(*tile, "_b").agg(F.count("*").cast("double").alias("n"))
    whole = Window.partitionBy(*tile)
    limit = clip_limit * F.sum("n").over(whole) / 256
    h = h.withColumn("_t", F.sum("n").over(whole)).withColumn("_c", F.least(F.col("n"), F.greatest(F.lit(1.0), limit)))
    h = h.withColumn("_excess", F.col("_t") - F.sum("_c").over(whole)).withColumn("_run", F.sum("_c").over(whole.orderBy("_b")))
    value = saturate(255 * (F.col("_run") + F.col("_excess") * (F.col("_b") + 1) / 256) / F.col("_t"))
    return d.join(h.select(*tile, "_b", value.alias("_new")), [*tile, "_b"]).select(*KEY, F.col("_new").alias("v"))
