"""Raster, label and geometry operators over the embeddings as 8 x 8 rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as M
from ..operators import graphics as G
from ..operators import labels as L
from ..operators import pixels as P
from ..operators import statistics as A
from ..operators import stencils as N
from .base import COLOUR, GRAY, MASK, case, colour, gray, mask, r6
from .raster_sql import SQL

K = "raster_id, y, x"
SAT = "greatest(0.0::double, least(255.0, round_even({}, 0)))"


def px(name: str, build, sql: str | None, source: str = "gray", digits: int = 6) -> None:
    """A query over one kind of raster; sql is a SELECT list over it."""
    make = {"gray": gray, "colour": colour, "mask": mask}[source]
    base = {"gray": GRAY, "colour": COLOUR, "mask": MASK}[source]
    text = SQL.get(name) if sql is None else f"with {base} {sql}" if sql.lstrip().startswith((",", "select")) else f"with {base} select {K}, {sql} from {source}"
    case(name, text)(lambda spark, d: r6(build(make(spark, d)), digits))


px("filter_gray", P.gray, SAT.format("0.114 * b + 0.587 * g + 0.299 * r") + " as v", "colour")
px("filter_threshold", P.threshold, "case when v > 127 then 255.0::double else 0.0 end as v")
px("plugin_invert", P.invert, "255 - b as b, 255 - g as g, 255 - r as r", "colour")
px("plugin_invert_mask", P.invert_mask, "255 - v as v", "mask")
px("plugin_brightness_contrast", lambda d: P.brightness_contrast(d, 10, 30), SAT.format("v * 1.3::double + 10") + " as v")
px("cv_gamma", lambda d: P.gamma(d, 2.0), SAT.format("power(v / 255, 0.5) * 255") + " as v")
px("cv_levels", lambda d: P.levels(d, 20, 220, 1.0, 10, 240), SAT.format("10 + greatest(0, least(1, (v - 20) / 200)) * 230") + " as v")
px("cv_colorspace", lambda d: P.colour_space(d).select("raster_id", "y", "x", "v", "s"), "greatest(b, g, r) as v, case when greatest(b, g, r) = 0 then 0.0::double else " + SAT.format("255 * (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r)") + " end as s", "colour")
px("cv_white_balance", P.white_balance, ", m as (select raster_id, avg(b) as mb, avg(g) as mg, avg(r) as mr from colour group by 1) select raster_id, y, x, " + ", ".join(SAT.format(f"{c} * ((mb + mg + mr) / 3) / greatest(m{c}, 1e-6)") + f" as {c}" for c in "bgr") + " from colour join m using (raster_id)", "colour")
px("filter_img_clamp", lambda d: P.clamp(d, 50, 200), "greatest(50.0::double, least(200.0, v)) as v")
px("plugin_channel_split", lambda d: P.channel_split(d, "g"), "g as v", "colour")
px("plugin_channel_merge", lambda d: P.channel_merge(P.channel_split(d, "b"), P.channel_split(d, "g"), P.channel_split(d, "r")), "b, g, r", "colour")
px("plugin_blend_modes", lambda d: P.blend(d, P.invert(d), "screen", 0.5), SAT.format("v * 0.5 + (255 - (255 - v) * v / 255) * 0.5") + " as v")
px("util_image_math", lambda d: P.image_power(d, 2.0), SAT.format("power(v / 255, 2) * 255") + " as v")
px("sci_colormap", lambda d: P.colour_map(d, "gray", False), "v as b, v as g, v as r")
px("util_colormap", lambda d: P.simple_colour_map(d, "gray"), ", m as (select raster_id, min(v) as lo, max(v) as hi from gray group by 1) select raster_id, y, x, " + ", ".join(SAT.format("(v - lo) / (hi - lo) * 255") + f" as {c}" for c in "bgr") + " from gray join m using (raster_id)")
px("filter_color_mask", lambda d: P.colour_mask(d, (120, 120, 120), 90), "case when sqrt(power(b - 120, 2) + power(g - 120, 2) + power(r - 120, 2)) <= 90 then 255.0::double else 0.0 end as v", "colour")
px("filter_float_threshold", lambda d: P.float_threshold(d, 100, 150), "case when v between 100 and 150 then 255.0::double else 0.0 end as v")
px("plugin_image_to_mask", P.image_to_mask, "v", "mask")
px("plugin_mask_to_image", P.mask_to_image, "v as b, v as g, v as r", "mask")
px("mask_operations", lambda d: P.mask_operation(d, P.float_threshold(d, 100, 300), 1), "case when v = 255 and not v between 100 and 300 then 255.0::double else 0.0 end as v", "mask")
px("util_mask_blend", lambda d: P.mask_blend(d, P.invert(d), P.threshold(d, 140)), "case when v > 140 then 255 - v else v end as v")
px("util_image_masking", lambda d: P.image_masking(d, P.threshold(d, 140), 7), "case when v > 140 then v else 7.0::double end as v")
px("draw_tint_mask", lambda d: P.tint_mask(d, P.channel_split(d, "b").transform(P.threshold, 140)), "case when b > 140 then " + SAT.format("b * 0.5") + " else b end as b, case when b > 140 then " + SAT.format("g * 0.5") + " else g end as g, case when b > 140 then " + SAT.format("r * 0.5 + 127.5") + " else r end as r", "colour")
px("util_mask_band", lambda d: P.mask_band(d, "x", 25, 75), "case when x * 100.0 / 8 >= 25 and x * 100.0 / 8 < 75 then v else 0.0::double end as v")
px("util_split_half", lambda d: P.split_half(d, "y", 50, False), "case when y >= 4 then v else 0.0::double end as v")
px("util_compose", lambda d: P.compose(d, P.invert(d), "checker", block=2), "case when (x // 2 + y // 2) % 2 = 0 then v else 255 - v end as v")
px("output_display", lambda d: P.display(d, P.invert(d), "side"), "select raster_id, y, x, v from gray union all select raster_id, y, x + 8, 255 - v from gray")
px("mask_circle", lambda d: P.mask_circle(d), "case when sqrt(power((x - 4) / 2.0, 2) + power((y - 4) / 2.0, 2)) <= 1 then 255.0::double else 0.0 end as v")
px("mask_point_query", lambda d: P.mask_point_query(d, d.where("x = y").select("raster_id", "y", "x")), f"select {K}, v > 0 as inside from mask where x = y", "mask")
_OTSU = ", h as (select raster_id, v::int as bin, count(*) as n from gray group by 1, 2), c as (select raster_id, bin, sum(n) over (partition by raster_id order by bin) as n0, sum(bin * n) over (partition by raster_id order by bin) as s0, sum(n) over (partition by raster_id) as nn, sum(bin * n) over (partition by raster_id) as ss from h), o as (select raster_id, bin::double as level from c qualify row_number() over (partition by raster_id order by coalesce(round_even(n0 * (nn - n0) * power(s0 / n0 - (ss - s0) / nullif(nn - n0, 0), 2) / (nn * nn), 6), 0) desc, bin) = 1)"
px("feat_threshold_adv", lambda d: P.threshold_adv(d, "otsu"), _OTSU + f" select {K}, case when v > level then 255.0::double else 0.0 end as v, level from gray join o using (raster_id)")
px("sci_histogram", lambda d: P.raster_histogram(d, 16), "select raster_id, floor(v * 16 / 256)::int as bin, count(*)::double as n from gray group by 1, 2")
px("sci_first_order_stats", P.first_order_stats, ", h as (select raster_id, v as bin, count(*) / 64.0::double as p from gray group by 1, 2) select raster_id, round(sum(bin * p), 6) as mean, round(sum(bin * bin * p) - power(sum(bin * p), 2), 6) as variance, round(-sum(p * log2(p)), 6) as entropy, round(sum(p * p), 6) as uniformity from h group by 1")
px("sci_normalizer", P.normalise, "round((v - min(v) over (partition by raster_id)) / (max(v) over (partition by raster_id) - min(v) over (partition by raster_id)), 6) as v")
px("sci_roi_stats", lambda d: P.roi_stats(d, 2, 2, 4, 4), "select raster_id, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, min(v) as min, max(v) as max, count(*) as count from gray where x between 2 and 5 and y between 2 and 5 group by 1")
px("sci_color_distance", lambda d: P.colour_distance(d, (100, 100, 100), "l1"), "abs(b - 100) + abs(g - 100) + abs(r - 100) as distance, case when abs(b - 100) + abs(g - 100) + abs(r - 100) <= 50 then 255.0::double else 0.0 end as v", "colour")
px("sci_delta_e", lambda d: P.delta_e(d, P.invert(d)), None, "colour")
px("sci_mask_metrics", lambda d: P.mask_metrics(P.threshold(d, 140), P.threshold(d, 120)), ", c as (select raster_id, count(*) filter (v > 140) as tp, count(*) filter (v > 120 and v <= 140) as fn from gray group by 1) select raster_id, round_even(coalesce(tp / nullif(tp + fn, 0), 0), 4) as iou, round_even(coalesce(2 * tp / nullif(2 * tp + fn, 0), 0), 4) as dice, case when tp > 0 then 1.0::double else 0 end as precision, round_even(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall, round_even(coalesce(2 * tp / nullif(2 * tp + fn, 0), 0), 4) as f1 from c")
px("sci_line_profile", lambda d: P.line_profile(d, (0, 0), (100, 100), 8), "select raster_id, x as i, v from gray where x = y")
px("feat_mask_stats", P.mask_stats, "select raster_id, count(*) filter (v > 0) as area_px, round_even(100.0 * count(*) filter (v > 0) / count(*), 4) as area_pct, round(avg(x) filter (v > 0), 6) as centroid_x, round(avg(y) filter (v > 0), 6) as centroid_y, min(x) filter (v > 0) as xmin, min(y) filter (v > 0) as ymin, max(x) filter (v > 0) as xmax, max(y) filter (v > 0) as ymax from mask group by 1", "mask")
px("image_moments", lambda d: P.image_moments(d).select("raster_id", "m00", "m10", "m01", "cx", "cy"), "select raster_id, sum(v) as m00, sum(x * v) as m10, sum(y * v) as m01, round(sum(x * v) / sum(v), 6) as cx, round(sum(y * v) / sum(v), 6) as cy from gray group by 1")
px("sci_glcm", P.glcm, ", q as (select raster_id, y, x, floor(v / 255 * 7)::bigint as i from gray), p as (select a.raster_id, a.i, b.i as j from q a join q b on a.raster_id = b.raster_id and a.y = b.y and b.x = a.x + 1), s as (select raster_id, i, j from p union all select raster_id, j, i from p), c as (select raster_id, i, j, count(*) as n from s group by 1, 2, 3), m as (select raster_id, sum(n * (i - j) * (i - j)) / 112 as contrast, sum(n::double / (1 + abs(i - j))) / 112 as homogeneity, sum(n * n) / 12544 as energy, -sum(n / 112 * log2(n / 112)) as entropy, sum(n * i) / 112 as mi, sum(n * j) / 112 as mj, sum(n * i * i) / 112 as ii, sum(n * j * j) / 112 as jj, sum(n * i * j) / 112 as ij from c group by 1) select raster_id, round(contrast, 6) as contrast, round(homogeneity, 6) as homogeneity, round(energy, 6) as energy, round(entropy, 6) as entropy, round(case when sqrt((ii - mi * mi) * (jj - mj * mj)) > 1e-12 then (ij - mi * mj) / sqrt((ii - mi * mi) * (jj - mj * mj)) else 1.0::double end, 6) as correlation from m")
px("feat_spectral_index", lambda d: P.spectral_index(P.channel_split(d, "b"), P.channel_split(d, "g")), "round((b - g) / (b + g + 1e-6), 6) as index, case when (b - g) / (b + g + 1e-6) > 0 then 255.0::double else 0.0 end as v", "colour")
px("feat_ndwi", lambda d: P.ndwi(P.channel_split(d, "b"), P.channel_split(d, "g")), "select raster_id, round_even(100.0 * count(*) filter (b > g) / count(*), 4) as coverage from colour group by 1", "colour")
px("geo_spectral_indices", lambda d: P.spectral_indices(d.select("raster_id", "y", "x", F.col("r").alias("nir"), F.col("g").alias("red"), F.col("b").alias("green"), F.col("b").alias("blue"), F.col("g").alias("swir"))).select("raster_id", "y", "x", "ndvi"), "round((r - g) / nullif(r + g, 0), 6) as ndvi", "colour")
px("geotiff_to_mask", lambda d: P.band_mask(d, "r", 100), "case when r > 100 then 255.0::double else 0.0 end as v", "colour")
px("geo_band_calc", lambda d: P.band_calc(d, "(B1 - B2) / (B1 + B2 + 1)", ["r", "g"], (-0.5, 0.5)), "round(greatest(-0.5, least(0.5, (r - g) / (r + g + 1))), 6) as v", "colour")
px("sci_channel_expr", lambda d: P.channel_expr(d, "sqrt(R) + max(G, B)"), "round(sqrt(r) + greatest(g, b), 6) as v", "colour")
px("plugin_pixelate", lambda d: P.pixelate(d, 4), SAT.format("avg(v) over (partition by raster_id, y // 4, x // 4)") + " as v")
for _n, _f in (("filter_noise_gaussian", P.noise_gaussian), ("filter_noise_salt_pepper", P.noise_salt_pepper), ("filter_noise_speckle", P.noise_speckle)):
    px(_n, _f, None)
px("filter_glitch", P.glitch, None, "colour")
px("filter_auto_polarity", lambda d: P.auto_polarity(d, 5), ", b as (select raster_id, avg(v) <= 127 as inverted from gray where x in (0, 7) or y in (0, 7) group by 1) select raster_id, y, x, case when inverted then 255 - v else v end as v, inverted from gray join b using (raster_id)")
px("gen_canvas", lambda d: P.canvas(d.select("raster_id").distinct(), 8, 8, "checker", tiles=4), "case when (x // 2 + y // 2) % 2 = 1 then 255.0::double else 0.0 end as v")
px("input_solid_color", lambda d: P.solid_colour(d.select("raster_id").distinct(), 8, 8, (1, 2, 3)), "1.0::double as b, 2.0::double as g, 3.0::double as r")
px("sci_spectral_gain", lambda d: P.spectral_gain(d, 1, 2, 3), "round(v * case when sqrt(power(x - 4, 2) + power(y - 4, 2)) / sqrt(32) < 0.15 then 1 when sqrt(power(x - 4, 2) + power(y - 4, 2)) / sqrt(32) < 0.5 then 2 else 3 end, 6) as v")
px("analysis_flow_viz", lambda d: P.flow_colours(d.select("raster_id", "y", "x", F.col("b").alias("dy"), F.col("g").alias("dx"))).select("raster_id", "y", "x", "h"), "floor(degrees(atan2(b, g)) / 2)::bigint as h", "colour")
px("geo_land_cover", lambda d: P.land_cover(d.select("raster_id", "y", "x", (F.col("v") % 4).cast("int").alias("class")), 2), "case when v % 4 = 2 then 255.0::double else 0.0 end as v, round(avg((v % 4 = 2)::int) over (partition by raster_id), 6) as coverage")
px("geo_copernicus", lambda d: P.composite(d.select((F.col("raster_id") % 20).alias("raster_id"), F.lit("B1").alias("band"), "y", "x", F.col("raster_id").alias("scene_ts"), "v")), "select raster_id % 20 as raster_id, 'B1' as band, y, x, median(v) as v from gray group by 1, 2, 3, 4")

# Stencils: the SQL pads by mirrored places and joins neighbours.


def near_sql(kernel: list[tuple[int, int, float]], agg: str, source: str = "gray") -> str:
    cells = ", ".join(f"({dy}, {dx}, {w!r}::double)" for dy, dx, w in kernel)
    m = lambda c, d: f"(7 - abs(7 - abs({c} + {d})))"
    return f", k(dy, dx, k) as (values {cells}) select a.raster_id, a.y, a.x, {agg} as v from {source} a, k join {source} b on b.raster_id = a.raster_id and b.y = {m('a.y', 'dy')} and b.x = {m('a.x', 'dx')} group by 1, 2, 3"


BOX = [(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
_k5 = N.gaussian_kernel(5)
GAUSS = [(i - 2, j - 2, float(_k5[i, j])) for i in range(5) for j in range(5)]
LAP = [(0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)]
CROSS = [(0, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)]

px("filter_blur", lambda d: N.blur(d, 3, "box"), near_sql(BOX, SAT.format("avg(b.v)")))
px("filter_blur_median", lambda d: N.blur(d, 3, "median"), near_sql(BOX, "median(b.v)"))
px("filter_low_pass", lambda d: N.low_pass(d, 5), None)
px("filter_low_pass_raw", lambda d: N.gaussian_blur(d, 5), near_sql(GAUSS, "round(sum(b.v * k.k), 4)"), digits=4)
px("filter_high_pass", N.high_pass, None)
px("feat_bilateral", N.bilateral, None)
px("filter_laplacian", N.laplacian, near_sql(LAP, "round(sum(b.v / 255 * k.k), 6) + 0.0"))
px("plugin_sobel", N.sobel, None)
px("plugin_gradient", lambda d: N.gradient(d).select("raster_id", "y", "x", F.col("dx").alias("v")), near_sql([(i, j, float(N.SOBEL_X[i + 1, j + 1])) for i in (-1, 0, 1) for j in (-1, 0, 1)], "sum(b.v * k.k)"))
px("filter_gabor", N.gabor, None)
px("feat_gabor_bank", lambda d: N.gabor_bank(d, 2), None, digits=3)
px("filter_dog", N.difference_of_gaussians, None)
px("filter_local_stats", lambda d: N.local_stats(d, 3, "var"), near_sql(BOX, "round(greatest(0, avg(b.v * b.v) - power(avg(b.v), 2)), 4)"), digits=4)
px("cv_adaptive_threshold", lambda d: N.adaptive_threshold(d, 3), near_sql(BOX, "case when any_value(a.v) > " + SAT.format("avg(b.v)") + " - 2 then 255.0::double else 0.0 end"))
px("feat_morphology_adv", lambda d: N.morphology(d, "gradient", 3), near_sql(BOX, "max(b.v) - min(b.v)"))
px("filter_morphology", lambda d: N.simple_morphology(d, "erode", 3), near_sql(BOX, "min(b.v)", "mask"), "mask")
px("filter_directional_morphology", lambda d: N.directional_morphology(d, "x", "dilate", 5), "max(v) over (partition by raster_id, y order by x rows between 2 preceding and 2 following) as v", "mask")
px("mask_outline", lambda d: N.outline(d, 3), None, "mask")
px("feat_water_refine", lambda d: N.water_refine(d), None, "mask")
px("cv_lbp", N.local_binary_pattern, near_sql([(-1, -1, 1.0), (-1, 0, 2.0), (-1, 1, 4.0), (0, 1, 8.0), (1, 1, 16.0), (1, 0, 32.0), (1, -1, 64.0), (0, -1, 128.0)], "sum(case when b.v >= a.v then k.k else 0 end)"))
px("feat_structure_tensor", lambda d: N.structure_tensor(d).withColumn("harris", F.col("harris") / 1e6), None, digits=2)
px("feat_harris", lambda d: N.harris(d).withColumn("v", F.col("v") / 1e6), None, digits=2)
px("feat_hog", N.hog, None, digits=4)
px("sci_focus_metric", N.focus_metric, near_sql(LAP, "sum(b.v * k.k)").replace(", k(dy", ", f as (with k(dy", 1) + ") select raster_id, round(var_pop(v), 4) as score from f group by 1", digits=4)
px("sci_noise_estimate", N.noise_estimate, None, digits=4)
px("cv_ssim", lambda d: N.ssim(d, P.brightness_contrast(d, 5, 0)), None)
px("cv_shadow_highlight", N.shadow_highlight, None)
px("pbr_material_gen", N.material_maps, None, digits=3)
px("gen_gray_scott", lambda d: N.gray_scott(d.select("raster_id", "y", "x", F.lit(1.0).alias("u"), (F.col("v") / 255).alias("v"))), None)
px("remove_vignette", N.remove_vignette, None)
px("feat_clahe", N.local_equalise, None)

# Labels and regions

px("feat_connected_components", L.connected, None, "mask")
_CC = f"""with recursive {MASK}, s as (select raster_id, y, x, y * 8 + x as id from mask where v > 0),
  e as (select a.raster_id, a.id as a, b.id as b from s a join s b on a.raster_id = b.raster_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
  r as (select raster_id, id, id as root from s union select r.raster_id, e.b, r.root from r join e on e.raster_id = r.raster_id and e.a = r.id),
  c as (select raster_id, id, min(root) as root from r group by 1, 2), n as (select raster_id, root, row_number() over (partition by raster_id order by root) as label, count(*) as area from c group by 1, 2)"""
case("component_labels", _CC + " select c.raster_id, id // 8 as y, id % 8 as x, label::int as label from c join n using (raster_id, root)")(lambda spark, d: L.component_labels(mask(spark, d)).select("raster_id", F.col("y").cast("long"), F.col("x").cast("long"), "label"))
case("sci_connected_components", _CC + " select n.raster_id, label::int as label, area, round(avg(id // 8), 6) as cy, round(avg(id % 8), 6) as cx from n join c using (raster_id, root) where area >= 3 group by all")(lambda spark, d: r6(L.components_by_area(gray(spark, d), 140, min_area=3)))
case("mask_keep_largest", _CC + ", b as (select *, row_number() over (partition by raster_id order by area desc, label) as k from n), o as (select raster_id, id from c join b using (raster_id, root) where k = 1) select m.raster_id, m.y, m.x, case when o.id is null then 0.0::double else 255.0 end as v from mask m left join o on o.raster_id = m.raster_id and o.id = m.y * 8 + m.x")(lambda spark, d: L.keep_largest(mask(spark, d)))
case("mask_filter_area", _CC + ", o as (select raster_id, id from c join n using (raster_id, root) where area >= 5) select m.raster_id, m.y, m.x, case when o.id is null then 0.0::double else 255.0 end as v from mask m left join o on o.raster_id = m.raster_id and o.id = m.y * 8 + m.x")(lambda spark, d: L.filter_area(mask(spark, d), 5))
case("mask_select_by_marker", _CC + ", t as (select distinct raster_id, root from c where id // 8 = 0), o as (select c.raster_id, id from c join t using (raster_id, root)) select m.raster_id, m.y, m.x, case when o.id is null then 0.0::double else 255.0 end as v from mask m left join o on o.raster_id = m.raster_id and o.id = m.y * 8 + m.x")(lambda spark, d: L.select_by_marker(mask(spark, d), mask(spark, d).where("y = 0")))


def _measures(d, *more):
    """Region measures without those that are noise where a region's axes are equal, or that need intensities."""
    cols = ["raster_id", "label", "area", "eq_diameter", "cy", "cx", "ymin", "ymax", "xmin", "xmax", "extent", "perimeter", "circularity"]
    return d.select(*cols, F.round("major_axis", 4).alias("major_axis"), *more)


def _labels(spark, d):
    """Label maps of four grey ranges."""
    return gray(spark, d).select("raster_id", "y", "x", F.floor(F.col("v") / 64).cast("int").alias("label"))


LABELS = f"with {GRAY}, labels as (select raster_id, y, x, floor(v / 64)::int as label, v from gray)"
_AREA = ", a as (select raster_id, label, count(*) as area from labels where label > 0 group by 1, 2)"
case("feat_marker_filter", LABELS + _AREA + ", k as (select raster_id, label, row_number() over (partition by raster_id order by label)::int as n from a where area >= 20) select raster_id, y, x, coalesce(n, 0) as label from labels left join k using (raster_id, label)")(lambda spark, d: L.marker_filter(_labels(spark, d), 20))
case("sci_marker_filter", LABELS + _AREA + " select raster_id, y, x, case when area between 20 and 30 then label else 0 end as label from labels left join a using (raster_id, label)")(lambda spark, d: L.marker_area_filter(_labels(spark, d), 20, 30))
case("util_label_filter_area", LABELS + _AREA + " select raster_id, y, x, case when area >= 19.2 then 255.0::double else 0.0 end as v from labels left join a using (raster_id, label)")(lambda spark, d: L.label_filter_area(_labels(spark, d), 5, 30))
case("sci_marker_analysis", LABELS + " select raster_id, label, round(avg(x), 6) as cx, round(avg(y), 6) as cy, count(*) as area from labels where label > 0 group by 1, 2")(lambda spark, d: r6(L.marker_analysis(_labels(spark, d))))
case("feat_visual_size_gate", LABELS + _AREA + " select raster_id, label, area, median_area, area between median_area * 0.5 and median_area * 1.5 as kept from a join (select raster_id, median(area) as median_area from a group by 1) using (raster_id)")(lambda spark, d: L.size_gate(_labels(spark, d)))
case("sci_region_props", LABELS + " select raster_id, label, count(*) as area, round(sqrt(4 * count(*) / pi()), 6) as eq_diameter, round(avg(y), 6) as cy, round(avg(x), 6) as cx, min(y) as ymin, max(y) as ymax, min(x) as xmin, max(x) as xmax, round(avg(v), 6) as mean_intensity from labels where label > 0 group by 1, 2")(lambda spark, d: r6(L.region_props(_labels(spark, d), gray(spark, d)).select("raster_id", "label", "area", "eq_diameter", "cy", "cx", "ymin", "ymax", "xmin", "xmax", "mean_intensity")))
case("sci_region_color_stats", f"with {COLOUR}, l as (select *, floor(b / 64)::int as label from colour) select raster_id, label, count(*) as area, " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(stddev_pop({c}), 6) as std_{c}" for c in "bgr") + " from l where label > 0 group by 1, 2")(lambda spark, d: r6(P.region_colour_stats(colour(spark, d), _labels(spark, d))))
case("sci_cluster_heatmap", LABELS + _AREA + " select raster_id, y, x, area::double as v from labels join a using (raster_id, label)")(lambda spark, d: P.cluster_heatmap(_labels(spark, d), L.areas(_labels(spark, d)), "area"))
case("sci_zone_stats", LABELS + ", r as (select raster_id, label, count(*) as area, floor(avg(y) + 0.5)::int as y, floor(avg(x) + 0.5)::int as x from labels where label > 0 group by 1, 2) select r.raster_id, case when r.x < 4 then 'left' else 'right' end as zone, count(*) as count, round(avg(area), 6) as mean_area, sum(area)::bigint as total_area from r group by 1, 2")(lambda spark, d: r6(A.zone_stats(_labels(spark, d), _labels(spark, d).select("raster_id", "y", "x", F.when(F.col("x") < 4, "left").otherwise("right").alias("zone")))))
for _n, _f in {
    "fill_holes": L.fill_holes, "util_fill_holes": L.fill_all_holes, "mask_region_sealer": L.region_sealer, "filter_morphology_smart": L.smart_morphology, "feat_shape_gate": lambda d: _measures(L.shape_gate(d, 2, 0.3), "aspect", "kept"),
    "filter_blob_filter": lambda d: L.blob_filter(d, 3), "obj_extractor": lambda d: _measures(L.object_extractor(d, 3)), "sci_hausdorff": lambda d: L.hausdorff(d, P.invert(d)), "sci_boundary_f1": lambda d: L.boundary_f1(d, N.dilate(d)),
    "feat_seeds_from_boundaries": L.seeds, "feat_watershed": lambda d: L.watershed(L.connected(N.erode(d)), d), "feat_find_contours": lambda d: L.find_contours(d).select("raster_id", "label", "area", "perimeter", "circularity", "cy", "cx"), "mask_to_svg": L.mask_to_svg,
    "mask_depth_bands": lambda d: L.depth_bands(d, d.where("x between 3 and 4")),
}.items():
    px(_n, _f, None, "mask")
px("sci_robust_bbox", lambda d: L.robust_bbox(d, 10), "select raster_id, round(x0, 6) as box_x, round(y0, 6) as box_y, round(x1 - x0, 6) as box_w, round(y1 - y0, 6) as box_h, count(*) filter (not (x between x0 and x1 and y between y0 and y1)) as n_rejected from mask join (select raster_id, quantile_cont(x, 0.1) as x0, quantile_cont(x, 0.9) as x1, quantile_cont(y, 0.1) as y0, quantile_cont(y, 0.9) as y1 from mask where v > 0 group by 1) using (raster_id) where v > 0 group by raster_id, x0, x1, y0, y1", "mask")
px("sci_curve_trace", L.curve_trace, "select raster_id, x, median(y)::double as y from mask where v > 0 group by 1, 2", "mask")
px("sci_axis_calibration", lambda d: L.axis_calibration(d.where("v > 0").select("raster_id", "y", "x"), (0, 7), (0.0, 70.0), (7, 0), (0.0, 14.0)), f"select {K}, x * 10.0::double as x_value, (y - 7) / -7.0::double * 14 as y_value from mask where v > 0", "mask", 4)
px("feat_distance_transform", L.distance_transform, ", n as (select raster_id, y, x from mask where v <= 0) select m.raster_id, m.y, m.x, round(case when any_value(m.v) <= 0 then 0.0::double else min(sqrt(power(m.y - n.y, 2) + power(m.x - n.x, 2))) end, 6) as v from mask m left join n using (raster_id) group by 1, 2, 3", "mask")
px("feat_peak_markers", L.peak_markers, None)
px("sci_general_segmenter", L.general_segmenter, None)
case("export_crops", f"with {GRAY} select raster_id, 1 as crop_id, y - 2 as y, x - 1 as x, v from gray where y between 2 and 4 and x between 1 and 6")(lambda spark, d: L.export_crops(gray(spark, d), gray(spark, d).select("raster_id").distinct().selectExpr("raster_id", "1 as crop_id", "2 as ymin", "4 as ymax", "1 as xmin", "6 as xmax")))
case("sci_export_particles", LABELS + ", b as (select raster_id, label, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from labels where label > 0 group by 1, 2) select g.raster_id, b.label as crop_id, g.y - y0 as y, g.x - x0 as x, g.v from gray g join b on g.raster_id = b.raster_id and g.y between y0 and y1 and g.x between x0 and x1")(lambda spark, d: L.export_particles(gray(spark, d), _labels(spark, d)))
case("merge_points", SQL["merge_points"])(lambda spark, d: r6(L.merge_points(mask(spark, d).where("v > 0").selectExpr("raster_id", "y * 8 + x as point_id", "x", "y"), 1.2)))
case("sci_hist_compare", f"with {GRAY}, h as (select raster_id, floor(v * 16 / 256)::int as bin, count(*) / 64.0::double as p from gray group by 1, 2), i as (select raster_id, floor((255 - v) * 16 / 256)::int as bin, count(*) / 64.0::double as q from gray group by 1, 2) select raster_id, round(sum(coalesce(power(coalesce(p, 0) - coalesce(q, 0), 2) / nullif(coalesce(p, 0) + coalesce(q, 0), 0), 0) order by bin) / 2, 6) as distance from h full join i using (raster_id, bin) group by 1")(lambda spark, d: r6(A.histogram_distance(gray(spark, d), P.invert(gray(spark, d)), ["raster_id"], "chi2", 16)))

# Geometry

px("geom_flip", M.flip, "select raster_id, y, 7 - x as x, v from gray")
px("geom_resize", lambda d: M.resize(d, scale=0.5, method="area"), "select raster_id, y // 2 as y, x // 2 as x, avg(v) as v from gray group by 1, 2, 3")
px("geom_crop_rect", lambda d: M.crop_rect(d, 2, 3, 4, 4), "select raster_id, y - 3 as y, x - 2 as x, v from gray where x between 2 and 5 and y between 3 and 6")
px("geom_cropper", lambda d: M.crop_box(d, d.select("raster_id").distinct().selectExpr("raster_id", "0.25 as xmin", "0.25 as ymin", "0.5 as width", "0.5 as height")), "select raster_id, (y - 2)::bigint as y, (x - 2)::bigint as x, v from gray where x between 2 and 5 and y between 2 and 5")
px("plugin_rotate", lambda d: M.rotate(d, 90), "select raster_id, 7 - x as y, y as x, v from gray")
px("geom_rotate_no_crop", lambda d: M.rotate_expanded(d, 90), "select raster_id, 7 - x as y, y as x, v from gray")
px("plugin_offset", lambda d: M.offset(d, 2, 0), "select raster_id, y, x, case when x >= 2 then lag(v, 2) over (partition by raster_id, y order by x) else 0.0::double end as v from gray")
px("geom_warp_affine", lambda d: M.warp_affine(d, [[1, 0, 1], [0, 1, 0]]), "select raster_id, y, x, case when x >= 1 then lag(v) over (partition by raster_id, y order by x) else 0.0::double end as v from gray")
px("geom_perspective", lambda d: M.perspective(d, [(2, 2), (5, 2), (5, 5), (2, 5)], 4, 4), "select raster_id, y - 2 as y, x - 2 as x, v from gray where x between 2 and 5 and y between 2 and 5")
px("cv_undistort", lambda d: M.undistort(d), "v")
px("geom_obb", M.oriented_box, None, "mask", 4)
case("geom_fit_shape_least", f"with {MASK}, p as (select raster_id, y, x from mask where v > 0), d as (select distinct a.raster_id, round(degrees(atan2(b.y - a.y, b.x - a.x)) + 180, 9) % 90 as t from p a join p b on a.raster_id = b.raster_id and (a.y, a.x) <> (b.y, b.x)), e as (select raster_id, t, (max(x * cos(radians(t)) + y * sin(radians(t))) - min(x * cos(radians(t)) + y * sin(radians(t)))) * (max(y * cos(radians(t)) - x * sin(radians(t))) - min(y * cos(radians(t)) - x * sin(radians(t)))) as area from d join p using (raster_id) group by 1, 2) select raster_id, abs(round(min(area), 4)) as area from e group by 1")(lambda spark, d: r6(M.least_rectangle(mask(spark, d).where("v > 0")).select("raster_id", F.abs(F.col("width") * F.col("height")).alias("area")), 4))
px("geom_fit_shape", lambda d: M.fit_shape(d.where("v > 0")), "select raster_id, min(x) - 0.0::double as xmin, min(y) - 0.0::double as ymin, max(x) + 0.0::double as xmax, max(y) + 0.0::double as ymax from mask where v > 0 group by 1", "mask")
px("util_roi_polygon", lambda d: M.roi_polygon(d, [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]), "case when x between 2 and 5 and y between 2 and 5 then 255.0::double else 0.0 end as v")
px("feat_fill_contours", lambda d: M.fill_contours(d, [[(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]]), "case when x < 4 and y < 4 then 255.0::double else 0.0 end as v")
px("util_coord_to_mask", lambda d: M.boxes_to_mask(d, d.select("raster_id").distinct().selectExpr("raster_id", "1 as ymin", "3 as ymax", "2 as xmin", "4 as xmax")), "case when y between 1 and 3 and x between 2 and 4 then 255.0::double else 0.0 end as v")
px("points_to_mask", lambda d: M.points_to_mask(d, d.where("x = 3 and y = 3").select("raster_id", "y", "x"), 2), "case when power(x - 3, 2) + power(y - 3, 2) <= 4 then 255.0::double else 0.0 end as v")
px("transform_eye_crop", lambda d: M.eye_crop(d, d.select("raster_id").distinct().selectExpr("raster_id", "'left' as eye", "3.5D as cx", "3.5D as cy", "3.5D as half", "0D as angle")), "select raster_id, 'left' as eye, y, x, v from gray")
_TURN = "2 * pi() * ((u.y + 4) % 8 * g.y + (u.x + 4) % 8 * g.x) / 8"
_PLACES = "(select a.i as y, b.i as x from (select unnest(range(8)) as i) a, (select unnest(range(8)) as i) b) u"
px("sci_fft", lambda d: M.fft(d).select("raster_id", "y", "x", "re", "im", "magnitude"), f", f as (select raster_id, u.y::int as y, u.x::int as x, sum(v * cos({_TURN})) as re, -sum(v * sin({_TURN})) as im from gray g, {_PLACES} group by 1, 2, 3) select {K}, round(re, 4) + 0.0 as re, round(im, 4) + 0.0 as im, round(sqrt(re * re + im * im), 4) as magnitude from f", digits=4)
px("sci_ifft", lambda d: M.ifft(M.fft(d)), "v", digits=4)
px("sci_dct", M.dct, f", f as (select raster_id, u.y::int as y, u.x::int as x, sum(v * cos(pi() * (2 * g.y + 1) * u.y / 16) * cos(pi() * (2 * g.x + 1) * u.x / 16)) * sqrt(case when u.y = 0 then 0.125 else 0.25 end) * sqrt(case when u.x = 0 then 0.125 else 0.25 end) as v from gray g, {_PLACES} group by raster_id, u.y, u.x) select {K}, round(v, 4) + 0.0 as v from f", digits=4)
px("draw_overlay", lambda d: G.draw_overlay(d.where("x = 0 and y = 0").select("raster_id", G.draw_point(F.col("x"), F.col("y")).alias("draw"))).select("raster_id", "layer"), "select raster_id, 0 as layer from gray where x = 0 and y = 0")
px("viz_compare_grid", lambda d: G.compare_grid(d, P.invert(d)), f"select {K}, v, 0 as panel from gray union all select {K}, 255 - v, 1 from gray")
px("sci_index_painter", lambda d: G.index_painter(d, d.where("v > 140").selectExpr("raster_id", "y", "x", "1 as order", "3 as class")), "case when v > 140 then 3 else 0 end as label")
px("image_legend", lambda d: G.image_legend(d.selectExpr("raster_id", "if(v > 128, 'high', 'low') as label", "'#fff' as color")).select("raster_id", F.size("legend").alias("n")), "select raster_id, count(distinct v > 128)::int as n from gray group by 1")
px("sci_scale_bar", lambda d: G.scale_bar(P.size_of(d), 2.0, 1.0).select("raster_id", F.col("draw.label").alias("label")), "select distinct raster_id, '1 mm' as label from gray")
px("util_draw_contours", lambda d: G.draw_contours(L.find_contours(d)).select("raster_id", F.col("draw.shape").alias("shape")), None, "mask")
case("tool_annotator", "select vec_id as raster_id, 'rect' as shape from embeddings")(lambda spark, d: G.annotations(gray(spark, d).where("x = 0 and y = 0").selectExpr("raster_id", """'[{"shape": "rect", "label": "a", "pts": []}]' as j"""), "j").select("raster_id", "shape"))
