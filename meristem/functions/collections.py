"""Operators on lists and dictionaries as Columns over arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import operator


@operator("data_list_ops", "column")
def list_op(items: Column, operation: str, value: Column | None = None, start: int = 0, end: int | None = None, step: int = 1) -> Column:
    """sort (nulls last), sort_desc (nulls first), reverse, unique, flatten, slice, append, length or contains."""
    if operation == "sort":
        return F.array_sort(items)
    if operation == "sort_desc":
        return F.reverse(F.array_sort(items))
    if operation == "reverse":
        return F.reverse(items)
    if operation == "unique":
        return F.array_distinct(items)
    if operation == "flatten":
        return F.flatten(items)
    if operation == "slice":
        n = F.size(items)
        place = lambda p: F.lit(p) if p >= 0 else n + p
        a, b = F.greatest(F.lit(0), place(start)), F.least(n, place(end)) if end is not None else n
        return F.filter(items, lambda x, i: (i >= a) & (i < b) & ((i - a) % step == 0))
    if operation == "append":
        return F.array_append(items, value)
    if operation == "length":
        return F.size(items)
    if operation == "contains":
        return F.array_contains(items, value)
    raise ValueError(f"unknown list operation {operation}")


@operator("data_list_selector", "column")
def list_selector(items: Column, index: int) -> Column:
    """The item at a place from 0, null outside."""
    return F.get(items, F.lit(index)) if index >= 0 else F.lit(None)


@operator("sci_scalar_list", "column")
def scalar_list(text: Column) -> Column:
    """struct(list, count): the finite numbers in text separated by commas, semicolons or white space."""
    numbers = F.transform(F.split(F.trim(text), r"[,;\s]+"), lambda s: s.try_cast("double"))
    finite = F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.struct(finite.alias("list"), F.size(finite).alias("count"))


@operator("util_filter_label", "column")
def filter_label(items: Column, query: str) -> Column:
    """struct(list, item, labels): items whose label contains the query in any case, the first of them, and all labels sorted."""
    hit = F.filter(items, lambda x: F.contains(F.lower(x["label"]), F.lit(query.lower())))
    return F.struct(hit.alias("list"), F.get(hit, F.lit(0)).alias("item"), F.array_sort(F.array_distinct(F.transform(items, lambda x: x["label"]))).alias("labels"))


def _box_area(b: Column) -> Column:
    return b["width"] * b["height"]


@operator("list_region_select", "column")
def region_select(items: Column, min_area: float = 0.0, sort_by: str = "area", index: int = 0) -> Column:
    """struct(item, list, count): boxes of an area of min_area or more, largest (or most certain) first."""
    kept = F.filter(items, lambda b: _box_area(b) >= min_area)
    key = _box_area if sort_by == "area" else (lambda b: b["score"])
    ordered = F.array_sort(kept, lambda a, b: F.when(key(a) > key(b), -1).when(key(a) < key(b), 1).otherwise(0))
    return F.struct(F.get(ordered, F.lit(index)).alias("item"), ordered.alias("list"), F.size(ordered).alias("count"))


@operator("box_selection", "column")
def box_selection(items: Column, mode: str = "index", index: int = 0) -> Column:
    """A box by index, or the largest, smallest or best scored (the first of equals)."""
    if mode == "index":
        return F.get(items, F.lit(index))
    key = {"largest": lambda b: -_box_area(b), "smallest": _box_area, "best": lambda b: -b["score"]}[mode]
    least = F.array_min(F.transform(items, key))
    return F.get(F.filter(items, lambda b: key(b) == least), F.lit(0))


@operator("bbox_transform", "column")
def bbox_transform(items: Column, grow: float = 0.0, clamp: bool = True, min_size: float = 0.0, max_size: float = float("inf")) -> Column:
    """Boxes grown (or shrunk) by a share of their size about their centre, clamped to 0..1, filtered by size and renumbered from 0."""

    def scaled(b: Column) -> Column:
        lo = lambda p, s: b[p] - b[s] * (grow / 2)
        hi = lambda p, s: b[p] + b[s] * (1 + grow / 2)
        fit = (lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))) if clamp else (lambda c: c)
        x, y = fit(lo("xmin", "width")), fit(lo("ymin", "height"))
        return F.struct(x.alias("xmin"), y.alias("ymin"), (fit(hi("xmin", "width")) - x).alias("width"), (fit(hi("ymin", "height")) - y).alias("height"), b["score"].alias("score"))

    size = lambda b: F.greatest(b["width"], b["height"])
    kept = F.filter(F.transform(items, scaled), lambda b: (size(b) >= min_size) & (size(b) <= max_size))
    return F.transform(kept, lambda b, i: F.struct(i.alias("id"), *[b[n].alias(n) for n in ("xmin", "ymin", "width", "height", "score")]))


@operator("util_coord_center", "column")
def coord_center(box: Column) -> Column:
    return F.struct((box["xmin"] + box["width"] / 2).alias("cx"), (box["ymin"] + box["height"] / 2).alias("cy"))


@operator("util_landmark_selector", "column")
def landmark_selector(points: Column, indices: list[int]) -> Column:
    """The points at some places with their bounding box; places outside are left out."""
    some = F.filter(F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(points, i)), lambda p: p.isNotNull())
    xs, ys = F.transform(some, lambda p: p["x"]), F.transform(some, lambda p: p["y"])
    return F.struct(some.alias("points"), F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


@operator("util_on_each", "column")
def on_each(items: Column, template: Column, text: str = "index") -> Column:
    """The template at each item's place, with the item's index, label or score as text."""
    of = {"index": lambda x, i: i.cast("string"), "label": lambda x, i: x["label"], "score": lambda x, i: x["score"].cast("string")}[text]
    return F.transform(items, lambda x, i: F.struct(x["xmin"].alias("x"), x["ymin"].alias("y"), template.alias("template"), of(x, i).alias("text")))


@operator("util_manual_points", "column")
def manual_points_of(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@operator("manual_points", "column")
def manual_points(text: Column) -> Column:
    """struct(points, count) of a JSON list of x, y."""
    points = F.from_json(text, "array<struct<x:double,y:double>>")
    return F.struct(points.alias("points"), F.greatest(F.size(points), F.lit(0)).alias("count"))


@operator("geom_track_point", "column")
def track_point(points: Column, index: int, width: float = 1.0, height: float = 1.0) -> Column:
    p = F.get(points, F.lit(index))
    return F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))


@operator("geom_track_line", "column")
def track_line(points: Column, a: int, b: int, width: float = 1.0, height: float = 1.0) -> Column:
    p, q = F.get(points, F.lit(a)), F.get(points, F.lit(b))
    return F.hypot((p["x"] - q["x"]) * width, (p["y"] - q["y"]) * height)


@operator("geom_track_polygon", "column")
def track_polygon(points: Column, indices: list[int], width: float = 1.0, height: float = 1.0) -> Column:
    """Shoelace area of the points at some places."""
    pts = [F.get(points, F.lit(i)) for i in indices]
    total = F.lit(0.0)
    for p, q in zip(pts, [*pts[1:], pts[0]], strict=True):
        total = total + (p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(total) / 2 * (width * height)


@operator("feat_contour_props", "column")
def contour_props(contour: Column) -> Column:
    return F.struct(*[contour[n].alias(n) for n in ("area", "circularity", "elongation")], contour["center"]["x"].alias("center_x"), contour["center"]["y"].alias("center_y"))


@operator("feat_filter_contours", "column")
def filter_contours(contours: Column, min_area: float = 0.0, max_area: float = float("inf"), min_circularity: float = 0.0, max_circularity: float = 1.0, min_elongation: float = 0.0) -> Column:
    return F.filter(contours, lambda c: c["area"].between(min_area, max_area) & c["circularity"].between(min_circularity, max_circularity) & (c["elongation"] >= min_elongation))


# Dictionaries


@operator("plugin_dict_get", "column")
def dict_get(d: Column, *keys: str) -> Column:
    """struct(val_1..., scalar_1): values of keys, and the first as a number."""
    values = [F.try_element_at(d, F.lit(k)) for k in keys]
    return F.struct(*[v.alias(f"val_{i + 1}") for i, v in enumerate(values)], values[0].try_cast("double").alias("scalar_1"))


@operator("dict_builder", "column")
def dict_builder(**inputs: Column) -> Column:
    """A map of the inputs that aren't null."""
    pairs = [x for k, v in inputs.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


@operator("util_dict_merge", "column")
def dict_merge(*maps: Column) -> Column:
    """One map; of equal keys the last given wins. Null maps are left out."""
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array()) for m in maps]))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


@operator("data_group_dicts", "column")
def group_dicts(*maps: Column) -> Column:
    return F.array_compact(F.array(*maps))


@operator("data_coord_combine", "column")
def coord_combine(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@operator("data_coord_splitter", "column")
def coord_splitter(d: Column) -> Column:
    return F.struct(d["x"].alias("a"), d["y"].alias("b"))


@operator("dict_scale", "column")
def dict_scale(d: Column, factor: float, power: int = 1, operation: str = "multiply", skip_keys: tuple[str, ...] = (), digits: int | None = None) -> Column:
    by = factor**power
    scaled = (lambda v: v * by) if operation == "multiply" else (lambda v: v / by)
    rounded = (lambda v: F.bround(scaled(v), digits)) if digits is not None else scaled
    return F.transform_values(d, lambda k, v: F.when(k.isin(*skip_keys), v).otherwise(rounded(v)) if skip_keys else rounded(v))


@operator("dict_report_panel", "column")
def report_panel(d: Column, groups: list[str]) -> Column:
    """Entries in the order of groups; * stands for all keys not named."""
    named = [g for g in groups if g != "*"]
    entries = F.map_entries(d)

    def part(group: str) -> Column:
        return F.filter(entries, lambda e: ~e["key"].isin(*named) if group == "*" else e["key"] == group)

    return F.flatten(F.array(*[part(g) for g in groups]))


@operator("sci_calibration", "column")
def calibration(value: Column, factor: float, dimension: str = "length") -> Column:
    by = factor**2 if dimension == "area" else factor
    return value / by


@operator("sci_analysis_report", "column")
def analysis_report(d: Column) -> Column:
    return d


@operator("sci_interactive_calibration", "column")
def interactive_calibration(x1: Column, y1: Column, x2: Column, y2: Column, real_length: float) -> Column:
    px = F.hypot(x1 - x2, y1 - y2)
    return F.struct((px / real_length).alias("factor"), (F.lit(1000.0 * real_length) / F.nullif(px, F.lit(0.0))).alias("um_per_px"))


@operator("sci_visual_measure", "column")
def visual_measure(x1: Column, y1: Column, x2: Column, y2: Column, factor: float = 1.0) -> Column:
    """struct(length in units, angle in degrees, counter-clockwise with y down)."""
    return F.struct((F.hypot(x1 - x2, y1 - y2) / factor).alias("length"), F.degrees(F.atan2(y1 - y2, x2 - x1)).alias("angle"))


@operator("geo_bbox", "column")
def geo_bbox(lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> Column:
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in (("lon_min", lon_min), ("lat_min", lat_min), ("lon_max", lon_max), ("lat_max", lat_max))])
