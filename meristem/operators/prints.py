"""Measures read off a raster: the length of a scale bar, and the zones of a foot print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import cut
from .labels import component_labels, runs
from .pixels import KEY, size_of

#: Millimetres of a unit, and what a bar has to be: its least length (pixels, share of the width), largest thickness (share of the
#: height), least share of its box, step in grey from the rows beside it, length by thickness, and largest deviation along its middle row.
MILLIMETRES = {"um": 1e-3, "mm": 1.0, "nm": 1e-6, "cm": 10.0}
LENGTH, LENGTH_SHARE, THICKNESS_SHARE, FILL, STEP, ASPECT, DEVIATION = 30, 0.04, 0.015, 0.8, 25, 12, 30.0


def _both(df: DataFrame) -> DataFrame:
    """Each raster twice, bright and dark (inverted), under names (raster_id, dark) of their own."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("dark"), F.col("v").alias("v")), F.struct(F.lit(1).alias("dark"), (255 - F.col("v")).alias("v")))).alias("s")
    return df.select(*KEY, "shift", sides).select(F.struct("raster_id", "s.dark").alias("raster_id"), "y", "x", "shift", "s.v")


def _steps(d: DataFrame) -> DataFrame:
    """(raster_id, y, x0, x1): runs of pixels that are brighter than those `shift` rows above or below."""
    moved = lambda by, name: d.select("raster_id", (F.col("y") + by * F.col("shift")).cast("int").alias("y"), "x", F.col("v").alias(name))
    near = d.join(moved(1, "above"), KEY, "left").join(moved(-1, "below"), KEY, "left")
    step = F.greatest(F.coalesce(F.col("v") - F.col("above"), F.lit(0.0)), F.coalesce(F.col("v") - F.col("below"), F.lit(0.0))) >= STEP
    return runs(near.where(step).select(*KEY, F.lit(1.0).alias("v")))


def stand_out(df: DataFrame, shift: Column, least: int) -> DataFrame:
    """(raster_id, dark, y, x0, x1): the runs of `least` pixels or more that bars may be made of."""
    found = _steps(_both(df.withColumn("shift", shift))).where(F.col("x1") - F.col("x0") + 1 >= least)
    return found.select("raster_id.raster_id", "raster_id.dark", "y", "x0", "x1")


@operator("sci_scale_bar_detect")
def scale_bar(df: DataFrame, bar_length: float = 1.0, unit: str = "mm", length: int = LENGTH, fallback_px_per_mm: float | None = None) -> DataFrame:
    """(raster_id, x, y, w, h, length_px, dark, px_per_mm) of grey rasters (raster_id, y, x, v): the longest bright bar, or the longest dark one where there is no bright one.

    A bar is made of runs, `length` pixels long at least, of pixels that are brighter than those a few
    rows above or below; runs that touch are one. Rasters without a bar have null places, and the
    fallback's scale if there is one.
    """
    size = size_of(df).withColumn("least", F.greatest(F.lit(length), F.floor(F.col("w") * LENGTH_SHARE))).withColumn("thick", F.greatest(F.lit(3), F.floor(F.col("h") * THICKNESS_SHARE)))
    size = size.withColumn("shift", F.greatest(F.lit(2), F.floor(F.col("thick") / 3)).cast("int"))
    d = cut(_both(df.join(size.select("raster_id", "shift"), "raster_id")))
    long_runs = _steps(d).withColumn("_id", F.col("raster_id.raster_id")).join(size.withColumnRenamed("raster_id", "_id"), "_id").where("x1 - x0 + 1 >= least")
    parts = component_labels(long_runs.select("raster_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(1.0).alias("v")))
    boxes = parts.groupBy("raster_id", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"))
    limits = size.select(F.col("raster_id").alias("_id"), "least", "thick")
    boxes = boxes.withColumn("_id", F.col("raster_id.raster_id")).join(limits, "_id")
    boxes = boxes.where((F.col("w") >= F.col("least")) & (F.col("h") <= F.col("thick")) & (F.col("w") >= ASPECT * F.col("h")) & (F.col("area") >= FILL * F.col("w") * F.col("h")))
    middle = boxes.withColumn("_y", F.col("y") + F.floor(F.col("h") / 2)).join(d.select("raster_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "v"), ["raster_id", "_y"])
    even = middle.where("_x >= x and _x < x + w").groupBy("_id", "raster_id", "label", "x", "y", "w", "h").agg((F.avg(F.col("v") * F.col("v")) - F.pow(F.avg("v"), F.lit(2))).alias("spread"))
    best = even.where(F.col("spread") <= DEVIATION**2).withColumn("dark", F.col("raster_id.dark")).withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("dark", F.desc("w"), "label"))).where("_r = 1")
    found = size.select("raster_id").join(best.drop("raster_id").withColumnRenamed("_id", "raster_id"), "raster_id", "left")
    scale = F.col("w") / (bar_length * MILLIMETRES[unit])
    return found.select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")], F.col("w").cast("int").alias("length_px"), (F.col("dark") == 1).alias("dark"), F.coalesce(scale, F.lit(fallback_px_per_mm).cast("double")).alias("px_per_mm"))


def _extents(on: DataFrame) -> DataFrame:
    return on.groupBy("raster_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def _turned(df: DataFrame, turns: DataFrame) -> DataFrame:
    """Pixels (raster_id, y, x, ...) of rasters turned clockwise (1) or half round (2), as turns(raster_id, turn, h, w) has it."""
    t = df.join(turns, "raster_id")
    y = F.when(F.col("turn") == 1, F.col("x")).when(F.col("turn") == 2, F.col("h") - 1 - F.col("y")).otherwise(F.col("y"))
    x = F.when(F.col("turn") == 1, F.col("h") - 1 - F.col("y")).when(F.col("turn") == 2, F.col("w") - 1 - F.col("x")).otherwise(F.col("x"))
    return t.select("raster_id", y.alias("y"), x.alias("x"), *[c for c in df.columns if c not in KEY])


@operator("forensic_footprint")
def footprint(df: DataFrame, zones: int = 4, weighted: bool = True, px_per_mm: float | None = None) -> DataFrame:
    """Zones of the foot print that each mask holds: df(raster_id, y, x, v the mask, p the grey level).

    Prints are stood upright first: a foot is longer than wide, and its widest row lies in the toes'
    half. The box of the print is cut into toes (of four zones), forefoot, arch and heel. Columns: zone
    areas in percent, the arch's share (staheli) and its type, the sides' asymmetry, the centroid (by
    grey level) in percent of the box, widths, and with a scale the lengths in millimetres. Last rows and
    columns of the box are outside the zones. Rasters without set pixels have no row.
    """
    names = (["toes"] if zones == 4 else []) + ["forefoot", "arch", "heel"]
    on = cut(df.where("v > 127").select(*KEY, "p"))
    size = size_of(df)
    lying = _extents(on).join(size, "raster_id").select("raster_id", F.when(F.col("x1") - F.col("x0") > F.col("y1") - F.col("y0"), 1).otherwise(0).alias("turn"), "h", "w")
    on = _turned(on, lying)
    size = lying.select("raster_id", F.when(F.col("turn") == 1, F.col("w")).otherwise(F.col("h")).alias("h"), F.when(F.col("turn") == 1, F.col("h")).otherwise(F.col("w")).alias("w"))
    box = _extents(on)
    widest = on.groupBy("raster_id", "y").agg(F.count("*").alias("n")).groupBy("raster_id").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("row"))
    upside = box.join(widest, "raster_id").join(size, "raster_id").select("raster_id", F.when(F.col("row") - F.col("y0") > (F.col("y1") - F.col("y0") + 1) / 2, 2).otherwise(0).alias("turn"), "h", "w")
    on = cut(_turned(on, upside))
    box = _extents(on).withColumn("fh", F.greatest(F.lit(1), F.col("y1") - F.col("y0"))).withColumn("fw", F.greatest(F.lit(1), F.col("x1") - F.col("x0")))
    d = on.join(box, "raster_id")
    bound = lambda i: F.col("y0") + F.floor(F.lit(i) * F.col("fh") / len(names)) if i < len(names) else F.col("y1")
    zone = F.lit(None).cast("int")
    for i in range(len(names)):
        zone = F.when((F.col("y") >= bound(i)) & (F.col("y") < bound(i + 1)) & (F.col("x") < F.col("x1")), F.lit(i)).otherwise(zone)
    d = d.withColumn("zone", zone).withColumn("mid", F.floor((F.col("x0") + F.col("x1")) / 2))
    left = (F.col("x") < F.col("mid"))
    area = lambda i: F.count_if(F.col("zone") == i)
    by = ["raster_id", "y0", "y1", "x0", "x1", "fh", "fw"]
    m = d.groupBy(*by).agg(
        F.count("*").alias("total"), *[area(i).alias(n) for i, n in enumerate(names)], F.count_if(left).alias("left"), F.count_if(~left & (F.col("x") < F.col("x1"))).alias("right"),
        F.sum("p").alias("weight"), F.sum(F.col("p") * F.col("x")).alias("px"), F.sum(F.col("p") * F.col("y")).alias("py"),
    )
    half_up = lambda c, digits: F.floor(c * 10**digits + 0.5) / 10**digits
    share = F.col("arch") / F.greatest(F.lit(1), F.col("forefoot") + F.col("arch"))
    centre = lambda p, lo, hi: F.when((F.col("weight") > 0) & F.lit(weighted), F.floor(F.col(p) / F.col("weight") + 0.5)).otherwise(F.floor((F.col(lo) + F.col(hi)) / 2 + 0.5))
    rows = d.where(F.col("zone").isNotNull()).groupBy("raster_id", "zone", "y").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("across"))
    across = rows.groupBy("raster_id", "zone").agg(F.max_by("across", F.struct("n", -F.col("y"))).alias("across"))
    wide = lambda name: F.max(F.when(F.col("zone") == names.index(name), F.col("across"))).alias(f"{name}_width_px")
    m = m.join(across.groupBy("raster_id").agg(wide("forefoot"), wide("heel")), "raster_id", "left")
    staheli = half_up(share, 3)
    out = m.select(
        "raster_id", *[half_up(100 * F.col(n) / F.col("total"), 1).alias(f"{n}_area_pct") for n in names], staheli.alias("staheli"),
        F.when(staheli < 0.21, "Cavus").when(staheli < 0.26, "Normal").otherwise("Flat").alias("arch_type"),
        half_up(F.abs(F.col("left") - F.col("right")) / F.greatest(F.col("left") + F.col("right"), F.lit(1)), 3).alias("asymmetry"),
        half_up(100 * (centre("px", "x0", "x1") - F.col("x0")) / F.col("fw"), 1).alias("centroid_x_pct"), half_up(100 * (centre("py", "y0", "y1") - F.col("y0")) / F.col("fh"), 1).alias("centroid_y_pct"),
        F.col("total").alias("total_area_px"), "forefoot_width_px", "heel_width_px", "fh", "fw",
        F.when(F.col("forefoot_width_px") > 0, half_up(F.coalesce(F.col("heel_width_px"), F.lit(0)) / F.col("forefoot_width_px"), 3)).alias("heel_forefoot_ratio"),
    )
    if px_per_mm:
        mm = lambda c, name: half_up(F.col(c) / px_per_mm, 1).alias(name)
        out = out.select("*", mm("fh", "foot_length_mm"), mm("fw", "foot_width_mm"), mm("forefoot_width_px", "forefoot_width_mm"), mm("heel_width_px", "heel_width_mm"))
    return out.drop("fh", "fw")
