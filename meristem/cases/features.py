"""Edges, lines, corners, flow and disparity over the embeddings as 8 x 8 rasters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import keypoints as N
from ..operators import labels as L
from ..operators import pixels as P
from ..operators import prints as R
from ..operators import segmentation as S
from .base import FRAMES, GRAY, MASK, case, frames, gray, mask, mosaic, r6
from .rasters import _OTSU
from .raster_sql import BOX, cells, components, gradients, near

K = "raster_id, y, x"


def _ring(name: str, source: str, column: str, places: tuple) -> str:
    """Common table of source with n0, n1, ...: the column at each of the places around a pixel."""
    reach = max(max(abs(a), abs(b)) for a, b in places)
    picks = ", ".join(f"max(case when b.y = a.y + {dy} and b.x = a.x + {dx} then b.{column} end) as n{i}" for i, (dy, dx) in enumerate(places))
    return f"{name} as (select a.raster_id, a.y, a.x, any_value(a.{column}) as c, {picks} from {source} a join {source} b on b.raster_id = a.raster_id and abs(b.y - a.y) <= {reach} and abs(b.x - a.x) <= {reach} group by 1, 2, 3)"


def _canny() -> str:
    n = [f"coalesce(n{i}, 0)" for i in range(8)]
    flat, steep = math.tan(math.pi / 8), math.tan(3 * math.pi / 8)
    ridge = f"""case when abs(dy) < abs(dx) * {flat!r}::double then m > {n[6]} and m >= {n[2]} when abs(dy) > abs(dx) * {steep!r}::double then m > {n[0]} and m >= {n[4]}
      when (dx >= 0) = (dy >= 0) then m > {n[7]} and m > {n[3]} else m > {n[1]} and m > {n[5]} end"""
    return f"""with recursive {GRAY}, {gradients()}, gm as (select *, abs(dx) + abs(dy) as m from g), {_ring('r', 'gm', 'm', X.RING)},
      w as (select {K}, m, 1 as v from gm join r using ({K}) where m > 200 and {ridge}), {components('e', 'w', 'v > 0')},
      k as (select distinct pe.raster_id, label from pe join w using ({K}) where m > 500), o as (select {K} from pe join k using (raster_id, label))
      select a.raster_id, a.y, a.x, case when o.raster_id is null then 0.0::double else 255.0 end as v from gray a left join o using ({K})"""


case("filter_canny", _canny())(lambda spark, d: r6(X.canny(gray(spark, d), 200, 500)))



def _segments(source: str, condition: str, threshold: int, length: float, gap: float) -> str:
    """Common tables of the accumulator at 15 degrees, its peaks, and the segments seg along them."""
    return f"""ht as (select unnest(range(12)) as t), hv as (select {K}, t, floor(round(x * cos(radians(t * 15)) + y * sin(radians(t * 15)), 6) + 0.5)::int as r from {source}, ht where {condition}),
  hc as (select raster_id, t as y, r as x, count(*) as votes from hv group by 1, 2, 3), {_ring('hn', 'hc', 'votes', ((0, -1), (-1, 0), (0, 1), (1, 0)))},
  hp as (select raster_id, y as t, x as r, c as votes from hn where c >= {threshold} and c > coalesce(n0, 0) and c > coalesce(n1, 0) and c >= coalesce(n2, 0) and c >= coalesce(n3, 0)),
  hs as (select hv.*, votes, round(y * cos(radians(hv.t * 15)) - x * sin(radians(hv.t * 15)), 6) as s from hv join hp using (raster_id, t, r)),
  hb as (select *, coalesce((s - lag(s) over (partition by raster_id, t, r order by s, y, x) > {gap})::int, 0) as cut from hs),
  hq as (select *, sum(cut) over (partition by raster_id, t, r order by s, y, x) as part from hb),
  he as (select raster_id, t, r, votes, part, min({{'s': s, 'y': y, 'x': x}}) as a, max({{'s': s, 'y': y, 'x': x}}) as z from hq group by all),
  seg as (select raster_id, t * 15.0::double as theta, r * 1.0::double as rho, votes, a.x as x1, a.y as y1, z.x as x2, z.y as y2 from he where z.s - a.s >= {length})"""


def _near_segments(name: str, segments: str, thickness: float) -> str:
    """Common table of the pixels within half the thickness of a segment."""
    t = "greatest(0.0, least(1.0, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::double / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0)))"
    return f"{name} as (select distinct g.raster_id, g.y, g.x from gray g join {segments} using (raster_id) where round(power(x - x1 - {t} * (x2 - x1), 2) + power(y - y1 - {t} * (y2 - y1), 2), 9) <= {thickness * thickness / 4!r}::double)"


_DARK = f"{GRAY}{_OTSU}"
case("feat_hough_lines", f"with {MASK}, {_segments('mask', 'v > 0', 6, 3, 2)} select * from seg")(lambda spark, d: r6(X.hough_lines(mask(spark, d), 1.0, 15.0, 6, 3, 2)))
case("filter_linearity", f"with {_DARK}, k as (select {K} from gray join o using (raster_id) where v <= level), {_segments('k', 'true', 6, 4, 2)}, {_near_segments('z', 'seg', 1)} select g.raster_id, g.y, g.x, case when z.raster_id is null then 0.0::double else 255.0 end as v from gray g left join z using ({K})")(
    lambda spark, d: r6(X.linearity(gray(spark, d), 4, 6, 1, 15.0))
)
_LONGER = "seg2 as (select raster_id, floor(round(x1 - ex, 6) + 0.5) as x1, floor(round(y1 - ey, 6) + 0.5) as y1, floor(round(x2 + ex, 6) + 0.5) as x2, floor(round(y2 + ey, 6) + 0.5) as y2 from (select *, (x2 - x1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as ex, (y2 - y1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as ey, abs((round(degrees(atan2(y2 - y1, x2 - x1)), 6) + 360) % 180 - 90) as off from seg) where least(off, 180 - off) <= 20)"
case("filter_linear_direction", f"with {_DARK}, k as (select {K} from gray join o using (raster_id) where v > level), {_segments('k', 'true', 5, 4, 2)}, {_LONGER}, {_near_segments('z', 'seg2', 1)} select g.raster_id, g.y, g.x, case when k.raster_id is not null and z.raster_id is null then 255.0::double else 0.0 end as v from gray g left join k using ({K}) left join z using ({K})")(
    lambda spark, d: r6(X.linear_direction(gray(spark, d), 90.0, 20, 4, 1.0, 1, True, 5, 15.0))
)
case("geom_approx_poly")(lambda spark, d: X.approx_poly(L.find_contours(mask(spark, d)), 5.0).select("raster_id", "label", F.size("pts").alias("corners"), "pts"))

_PICK = "('0x' || substr(md5('42|' || raster_id || '|' || i || '|{}'), 1, 12))::bigint % n_points"
_RANSAC = f"""with {MASK}, p as (select {K}, row_number() over (partition by raster_id order by y, x) - 1 as i from mask where v > 0), n as (select raster_id, count(*) as n_points from p group by 1),
  d as (select raster_id, i, {_PICK.format(0)} as p0, {_PICK.format(1)} as p1 from n, (select unnest(range(50)) as i)),
  l as (select d.raster_id, d.i, a.y as y0, a.x as x0, b.y - a.y as dy, b.x - a.x as dx from d join p a on a.raster_id = d.raster_id and a.i = p0 join p b on b.raster_id = d.raster_id and b.i = p1 where p0 <> p1),
  v as (select raster_id, l.i, dy, dx, count(*) as inliers from p join l using (raster_id) where round(abs((x - x0) * dy - (y - y0) * dx) / sqrt((dy * dy + dx * dx)::double), 9) <= 1 group by all)
  select raster_id, round((round(degrees(atan2(dy, dx)), 6) + 360) % 180, 4) as angle, inliers, n_points from v join n using (raster_id) qualify row_number() over (partition by raster_id order by inliers desc, v.i) = 1"""
case("feat_ransac_line", _RANSAC)(lambda spark, d: r6(X.ransac_line(mask(spark, d).where("v > 0")), 4))


def _fast() -> str:
    ring = "[" + ", ".join(f"n{i % 16}" for i in range(24)) + "]"
    run = lambda form: f"len(list_filter(range(16), lambda i: len(list_filter({ring}[i + 1:i + 9], lambda e: {form})) = 9)) > 0"
    score = " + ".join(f"greatest(0.0, abs(n{i} - c) - 10)" for i in range(16))
    n = [f"coalesce(n{i}, -1)" for i in range(8)]
    best = " and ".join(f"c {'>=' if i in (2, 3, 4, 5) else '>'} {n[i]}" for i in range(8))
    return f"""with {GRAY}, {_ring('r', 'gray', 'v', X.CIRCLE)}, f as (select {K}, {score} as score from r where {' and '.join(f'n{i} is not null' for i in range(16))} and ({run('e > c + 10')} or {run('e < c - 10')})),
      {_ring('m', 'f', 'score', X.RING)} select {K}, round(c, 6) as score from m where {best}"""


case("feat_fast", _fast())(lambda spark, d: r6(X.fast(gray(spark, d), 10)))

_G8 = [(i, j, float(k)) for i, j, k in cells(np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8)]


def _flow(corners: bool) -> str:
    """Frames have a name of their own here, so that the stencils keep them apart."""
    base = f"f as (select raster_id + 20 * tick as raster_id, y, x, v from frames), {near('gx', 'f', _G8, gx='sum(b.v * k.k)')}, {near('gy', 'f', [(j, i, k) for i, j, k in _G8], gy='sum(b.v * k.k)')}, g as (select * from gx join gy using ({K}))"
    moved = f"h as (select g.*, n.v - f.v as gt from g join f using ({K}) join f n on n.raster_id = f.raster_id + 20 and n.y = f.y and n.x = f.x), {near('s', 'h', BOX, xx='avg(b.gx * b.gx)', yy='avg(b.gy * b.gy)', xy='avg(b.gx * b.gy)', xt='avg(b.gx * b.gt)', yt='avg(b.gy * b.gt)')}"
    z = f"z as (select raster_id % 20 as raster_id, raster_id // 20 + 1 as tick, y, x, case when xx * yy - xy * xy > 1e-6 then (xy * yt - yy * xt) / (xx * yy - xy * xy) else 0.0::double end as dx, case when xx * yy - xy * xy > 1e-6 then (xy * xt - xx * yt) / (xx * yy - xy * xy) else 0.0::double end as dy from s)"
    if not corners:
        return f"with {FRAMES}, {base}, {moved}, {z} select raster_id, tick, y, x, round(dx, 3) + 0.0 as dx, round(dy, 3) + 0.0 as dy, round(sqrt(dx * dx + dy * dy), 3) as magnitude from z"
    e = f"{near('t', 'g', BOX, xx='avg(b.gx * b.gx)', yy='avg(b.gy * b.gy)', xy='avg(b.gx * b.gy)')}, e as (select {K}, round((xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy), 6) as v from t), {near('m', 'e', BOX, d='max(b.v)')}, o as (select raster_id, max(v) as top from e group by 1), c as (select raster_id % 20 as raster_id, raster_id // 20 + 1 as tick, y, x from e join m using ({K}) join o using (raster_id) where v = d and v > 0.1 * top)"
    return f"with {FRAMES}, {base}, {moved}, {z}, {e} select raster_id, tick, y, x, round(dx, 3) + 0.0 as dx, round(dy, 3) + 0.0 as dy from z join c using (raster_id, tick, y, x)"


case("analysis_flow", _flow(False))(lambda spark, d: r6(X.dense_flow(frames(spark, d)).drop("angle"), 3))
case("optical_flow_lk", _flow(True))(lambda spark, d: r6(X.corner_flow(frames(spark, d)), 3))
case("cv_directional_dilate", f"with {MASK}, {near('m', 'mask', [(i, i, 1.0) for i in (-1, 0, 1)], v='max(b.v)')} select {K}, v from m")(lambda spark, d: r6(X.line_dilate(mask(spark, d), 3, 45)))

_STEREO = f"""with {GRAY}, c as (select a.raster_id + 100000 * d as raster_id, a.y, a.x, coalesce(abs(a.v - (255 - b.v)), 255) as v from gray a cross join (select unnest(range(4)) as d) left join gray b on b.raster_id = a.raster_id and b.y = a.y and b.x = a.x - d),
  {near('m', 'c', BOX, v='round(avg(b.v), 6)')} select raster_id % 100000 as raster_id, y, x, (raster_id // 100000)::int as disparity from m qualify row_number() over (partition by raster_id % 100000, y, x order by v, raster_id // 100000) = 1"""
case("cv_stereo", _STEREO)(lambda spark, d: X.disparity(gray(spark, d), P.invert(gray(spark, d))))


def _shifts(rounds: int) -> str:
    out = ["s0 as (select raster_id, y, x, y::double as cy, x::double as cx, v as cv from gray)"]
    for i in range(1, rounds + 1):
        out.append(f"s{i} as (select s.raster_id, s.y, s.x, coalesce(round(avg(b.y), 6), any_value(cy)) as cy, coalesce(round(avg(b.x), 6), any_value(cx)) as cx, coalesce(round(avg(b.v), 6), any_value(cv)) as cv from s{i - 1} s left join gray b on b.raster_id = s.raster_id and power(b.y - floor(cy + 0.5), 2) + power(b.x - floor(cx + 0.5), 2) <= 4 and abs(b.v - cv) <= 30 group by 1, 2, 3)")
    return f"with {GRAY}, " + ", ".join(out) + f" select {K}, round(cv, 4) as v from s{rounds}"


case("cv_mean_shift", _shifts(3))(lambda spark, d: r6(X.mean_shift(gray(spark, d), 2, 30, 3), 4))
case("cv_directional_dilate_oriented")(lambda spark, d: X.oriented_dilate(mosaic(spark, d).withColumn("v", F.when(F.col("v") > 150, 255.0).otherwise(0.0)), 7))
case("feat_sift")(lambda spark, d: r6(N.sift(mosaic(spark, d), octaves=2, contrast=0.02, tile=32), 3))
case("feat_orb")(lambda spark, d: r6(N.orb(mosaic(spark, d), 40, n_levels=3, threshold=15, tile=32), 3))
case("feat_active_contour")(lambda spark, d: S.active_contour(mosaic(spark, d), mosaic(spark, d).withColumn("v", F.when(F.hypot(F.col("y") - 32, F.col("x") - 32) < 14, 255.0).otherwise(0.0)), iterations=12, pre_blur=1.0))
case("feat_grabcut")(lambda spark, d: S.grabcut(_coloured(mosaic(spark, d)), mosaic(spark, d).withColumn("v", F.when(F.hypot(F.col("y") - 32, F.col("x") - 32) < 4, 1).when(F.hypot(F.col("y") - 32, F.col("x") - 32) < 20, 3).otherwise(0)), 1))
case("cv_skeletonize")(lambda spark, d: X.skeletonize(mask(spark, d))[0])
case("feat_skeleton")(lambda spark, d: r6(X.skeleton(mask(spark, d))[1]))
case("feat_hough_circles")(lambda spark, d: X.hough_circles(gray(spark, d)))


def _coloured(df):
    v = F.col("v")
    return df.select("raster_id", "y", "x", v.alias("b"), ((v * 3) % 256).alias("g"), ((v * 7 + 13) % 256).alias("r"))


_BAR = f"""with {GRAY}, s as (select raster_id, y, x, dark, case when dark = 1 then 255 - v else v end as v from gray, (values (0), (1)) as k(dark)),
  c as (select a.raster_id, a.dark, a.y, a.x from s a left join s u on u.raster_id = a.raster_id and u.dark = a.dark and u.x = a.x and u.y = a.y - 2 left join s l on l.raster_id = a.raster_id and l.dark = a.dark and l.x = a.x and l.y = a.y + 2 where greatest(coalesce(a.v - u.v, 0), coalesce(a.v - l.v, 0)) >= 25),
  g as (select *, x - row_number() over (partition by raster_id, dark, y order by x) as k from c), n as (select raster_id, dark, y, min(x) as x0, max(x) as x1 from g group by raster_id, dark, y, k having count(*) >= 3)
  select raster_id, dark, y, x0, x1 from n"""


@case("sci_scale_bar_runs", _BAR)
def _bar_runs(spark, d):
    """What bars are made of: runs of three pixels or more that stand out from the rows two above or below."""
    return R.stand_out(gray(spark, d), F.lit(2), 3).select("raster_id", "dark", "y", "x0", "x1")


@case("sci_scale_bar_detect")
def _bars(spark, d):
    """Rasters of 64 x 64 with a bar of their own length, dark in every other one."""
    m = mosaic(spark, d)
    bar = (F.col("y").between(40, 41)) & F.col("x").between(4, 34 + F.col("raster_id") % 20)
    return r6(R.scale_bar(m.withColumn("v", F.when(bar, F.when(F.col("raster_id") % 2 == 0, 255.0).otherwise(0.0)).otherwise(F.col("v"))), 2.0, "um"))


@case("forensic_footprint", """with """ + MASK + """, p as (select m.raster_id, m.y, m.x, g.v as p from mask m join gray g using (raster_id, y, x) where m.v > 127),
  e1 as (select raster_id, max(x) - min(x) > max(y) - min(y) as lying from p group by 1),
  t1 as (select raster_id, case when lying then x else y end as y, case when lying then 7 - y else x end as x, p from p join e1 using (raster_id)),
  b1 as (select raster_id, min(y) as y0, max(y) as y1 from t1 group by 1), c1 as (select raster_id, y from (select raster_id, y, count(*) as n from t1 group by 1, 2) qualify row_number() over (partition by raster_id order by n desc, y) = 1),
  t2 as (select raster_id, case when c1.y - y0 > (y1 - y0 + 1) / 2.0 then 7 - t1.y else t1.y end as y, case when c1.y - y0 > (y1 - y0 + 1) / 2.0 then 7 - t1.x else t1.x end as x, p from t1 join b1 using (raster_id) join c1 using (raster_id)),
  b as (select raster_id, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, greatest(1, max(y) - min(y)) as fh, greatest(1, max(x) - min(x)) as fw from t2 group by 1),
  z as (select t2.*, b.* exclude (raster_id), case when x >= x1 then null when y >= y0 + 3 * fh // 4 then case when y < y1 then 3 end when y >= y0 + 2 * fh // 4 then 2 when y >= y0 + fh // 4 then 1 else 0 end as zone from t2 join b using (raster_id)),
  a as (select raster_id, any_value(y0) as y0, any_value(x0) as x0, any_value(fh) as fh, any_value(fw) as fw, count(*) as total, count(*) filter (zone = 0) as toes, count(*) filter (zone = 1) as forefoot, count(*) filter (zone = 2) as arch, count(*) filter (zone = 3) as heel,
    count(*) filter (x < (x0 + x1) // 2) as l, count(*) filter (x >= (x0 + x1) // 2 and x < x1) as r, floor(sum(p * x) / sum(p) + 0.5) as cx, floor(sum(p * y) / sum(p) + 0.5) as cy from z group by 1),
  w as (select raster_id, zone, across from (select raster_id, zone, y, count(*) as n, max(x) - min(x) as across from z where zone is not null group by 1, 2, 3) qualify row_number() over (partition by raster_id, zone order by n desc, y) = 1),
  v as (select raster_id, max(across) filter (zone = 1) as forefoot_width_px, max(across) filter (zone = 3) as heel_width_px from w group by 1),
  s as (select *, floor(arch / greatest(1, forefoot + arch) * 1000 + 0.5) / 1000 as staheli from a left join v using (raster_id))
  select raster_id, floor(1000 * toes / total + 0.5) / 10 as toes_area_pct, floor(1000 * forefoot / total + 0.5) / 10 as forefoot_area_pct, floor(1000 * arch / total + 0.5) / 10 as arch_area_pct, floor(1000 * heel / total + 0.5) / 10 as heel_area_pct, staheli,
    case when staheli < 0.21 then 'Cavus' when staheli < 0.26 then 'Normal' else 'Flat' end as arch_type, floor(abs(l - r) / greatest(l + r, 1) * 1000 + 0.5) / 1000 as asymmetry, floor(1000 * (cx - x0) / fw + 0.5) / 10 as centroid_x_pct, floor(1000 * (cy - y0) / fh + 0.5) / 10 as centroid_y_pct,
    total as total_area_px, forefoot_width_px, heel_width_px, case when forefoot_width_px > 0 then floor(coalesce(heel_width_px, 0) / forefoot_width_px * 1000 + 0.5) / 1000 end as heel_forefoot_ratio from s""")
def _footprints(spark, d):
    return r6(R.footprint(mask(spark, d).join(gray(spark, d).withColumnRenamed("v", "p"), ["raster_id", "y", "x"])))


@case("cv_ransac")
def _matches(spark, d):
    """Pixels matched with their places under one map, but for dark ones, which are matched elsewhere."""
    wrong = F.when(F.col("v") < 90, F.col("v") + 40).otherwise(0.0)
    m = gray(spark, d).selectExpr("raster_id", "y * 8 + x as match_id", "double(x) as x1", "double(y) as y1", "v").withColumn("x2", 2 * F.col("x1") + F.col("y1") + 1 + wrong).withColumn("y2", F.col("y1") - F.col("x1") + 3 - wrong)
    return X.ransac_matches(m.drop("v"), ["raster_id"], 0.5, 40)[0].select("raster_id", "inliers")
