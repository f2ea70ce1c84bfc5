"""Graphic operators: they give rows that describe what to draw. Nothing is rasterised, for that is a viewer's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import operator


def _graphic(kind: str, points: list[tuple[Column, Column]], color: str, thickness: int, **rest) -> Column:
    pts = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])
    return F.struct(F.lit(kind).alias("shape"), pts.alias("pts"), F.lit(color).alias("color"), F.lit(thickness).alias("thickness"), *[F.lit(v).alias(k) for k, v in rest.items()])


@operator("draw_arrow", "column")
def draw_arrow(x1: Column, y1: Column, x2: Column, y2: Column, color: str = "#ff0000", thickness: int = 2, tip_length: float = 0.1) -> Column:
    return _graphic("arrow", [(x1, y1), (x2, y2)], color, thickness, tip_length=tip_length)


@operator("draw_line", "column")
def draw_line(x1: Column, y1: Column, x2: Column, y2: Column, color: str = "#ff0000", thickness: int = 2) -> Column:
    return _graphic("line", [(x1, y1), (x2, y2)], color, thickness)


@operator("draw_point", "column")
def draw_point(x: Column, y: Column, color: str = "#ff0000", thickness: int = 2) -> Column:
    return _graphic("point", [(x, y)], color, thickness)


@operator("draw_rect", "column")
def draw_rect(x: Column, y: Column, w: Column, h: Column, color: str = "#ff0000", thickness: int = 2, fill: bool = False) -> Column:
    return _graphic("rect", [(x, y), (x + w, y + h)], color, thickness, fill=fill)


@operator("draw_ellipse", "column")
def draw_ellipse(x: Column, y: Column, rx: Column, ry: Column, color: str = "#ff0000", thickness: int = 2, fill: bool = False) -> Column:
    return _graphic("ellipse", [(x, y), (rx, ry)], color, thickness, fill=fill)


@operator("draw_text", "column")
def draw_text(text: Column, x: Column, y: Column, color: str = "#ff0000", font_scale: float = 1.0) -> Column:
    return F.struct(F.lit("text").alias("shape"), text.cast("string").alias("text"), F.struct(x.alias("x"), y.alias("y")).alias("at"), F.lit(color).alias("color"), F.lit(font_scale).alias("font_scale"))


@operator("draw_overlay")
def draw_overlay(*graphics: DataFrame) -> DataFrame:
    """All graphics in drawing order: rows(raster_id, draw) of each table with its layer."""
    out = None
    for i, g in enumerate(graphics):
        one = g.select("raster_id", F.to_json("draw").alias("draw"), F.lit(i).alias("layer"))
        out = one if out is None else out.unionByName(one)
    return out


@operator("util_draw_contours")
def draw_contours(contours: DataFrame, color: str = "#00ff00", thickness: int = 1) -> DataFrame:
    return contours.select("raster_id", F.struct(F.lit("polygon").alias("shape"), "pts", F.lit(color).alias("color"), F.lit(thickness).alias("thickness")).alias("draw"))


@operator("image_legend")
def image_legend(entries: DataFrame) -> DataFrame:
    """entries(raster_id, label, color) as one ordered legend per raster."""
    return entries.groupBy("raster_id").agg(F.array_sort(F.collect_set(F.struct("label", "color"))).alias("legend"))


@operator("sci_scale_bar")
def scale_bar(rasters: DataFrame, pixels_per_unit: float, bar_length: float, unit: str = "mm") -> DataFrame:
    """rasters(raster_id, h, w): the bar's ends at the lower left."""
    px = pixels_per_unit * bar_length
    return rasters.select("raster_id", _graphic("line", [(F.lit(4.0), F.col("h") - 4), (F.lit(4.0 + px), F.col("h") - 4)], "#ffffff", 2, label=f"{bar_length:g} {unit}").alias("draw"))


@operator("viz_compare_grid")
def compare_grid(*images: DataFrame) -> DataFrame:
    """All images' pixels with their panel."""
    out = None
    for i, d in enumerate(images):
        one = d.withColumn("panel", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@operator("tool_annotator")
def annotations(text: DataFrame, column: str) -> DataFrame:
    """JSON annotation lists as rows."""
    schema = "array<struct<shape:string,label:string,pts:array<struct<x:double,y:double>>>>"
    return text.select("raster_id", F.explode(F.from_json(column, schema)).alias("a")).select("raster_id", "a.*")


@operator("sci_index_painter")
def index_painter(pixels: DataFrame, strokes: DataFrame) -> DataFrame:
    """strokes(raster_id, y, x, order, class) painted over pixels(raster_id, y, x): the last stroke's class at each pixel, else 0."""
    last = strokes.groupBy("raster_id", "y", "x").agg(F.max_by("class", "order").alias("label"))
    return pixels.select("raster_id", "y", "x").join(last, ["raster_id", "y", "x"], "left").fillna(0, ["label"])


@operator("data_inspector")
def data_inspector(df: DataFrame) -> DataFrame:
    return df


@operator("reroute")
def reroute(df: DataFrame) -> DataFrame:
    return df


@operator("note")
def note(df: DataFrame | None = None) -> DataFrame | None:
    return df


@operator("canvas_frame")
def canvas_frame(df: DataFrame | None = None) -> DataFrame | None:
    return df
