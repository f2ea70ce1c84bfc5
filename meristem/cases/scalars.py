"""Scalar, text, logic, list and dictionary operators over lineitem, part, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import scalars as S
from ..functions.expressions import math_expr
from .base import case, r6, table


def _columns():
    return [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")]


LINE = {
    "math_add": (lambda Q, P, D, T, N: S.math_add(Q, T), "l_quantity + l_tax"),
    "math_sub": (lambda Q, P, D, T, N: S.math_sub(Q, T), "l_quantity - l_tax"),
    "math_mul": (lambda Q, P, D, T, N: S.math_mul(Q, D), "l_quantity * l_discount"),
    "math_div": (lambda Q, P, D, T, N: S.math_div(P, N - 2), "case when l_linenumber = 2 then 0.0::double else l_extendedprice / (l_linenumber - 2) end"),
    "math_mod": (lambda Q, P, D, T, N: S.math_mod(Q - 25, N - 2), "case when l_linenumber = 2 then 0.0::double else (l_quantity - 25) % (l_linenumber - 2)::double end"),
    "math_min": (lambda Q, P, D, T, N: S.math_min(Q, N.cast("double") * 7), "least(l_quantity, l_linenumber::double * 7)"),
    "math_max": (lambda Q, P, D, T, N: S.math_max(Q, N.cast("double") * 7), "greatest(l_quantity, l_linenumber::double * 7)"),
    "math_pow": (lambda Q, P, D, T, N: S.math_pow(1 + D, N), "power(1 + l_discount, l_linenumber)"),
    "math_abs": (lambda Q, P, D, T, N: S.math_abs(Q - 25), "abs(l_quantity - 25)"),
    "math_round": (lambda Q, P, D, T, N: S.math_round((Q - 25) / 2), "floor((l_quantity - 25) / 2 + 0.5)::bigint"),
    "math_sin": (lambda Q, P, D, T, N: S.math_sin(Q), "sin(l_quantity)"),
    "math_cos": (lambda Q, P, D, T, N: S.math_cos(Q), "cos(l_quantity)"),
    "math_clamp": (lambda Q, P, D, T, N: S.math_clamp(Q, 10, 40), "greatest(10.0::double, least(40.0, l_quantity))"),
    "math_distance": (lambda Q, P, D, T, N: S.math_distance(Q, N, T, D), "sqrt(power(l_quantity - l_tax, 2) + power(l_linenumber - l_discount, 2))"),
    "math_expr": (lambda Q, P, D, T, N: math_expr("clamp(a * 2 - b ** 2, 0, 50) + sqrt(abs(c)) if b > 2 else a / (b - 1)", a=Q, b=N, c=D), "case when l_linenumber > 2 then greatest(0, least(50, l_quantity * 2 - power(l_linenumber, 2))) + sqrt(abs(l_discount)) when l_linenumber = 1 then 0.0::double else l_quantity / (l_linenumber - 1) end"),
    "math_map_range": (lambda Q, P, D, T, N: S.math_map_range(Q, 10, 40, 0, 1, clamp=True), "greatest(0.0::double, least(1.0, (l_quantity - 10) / 30))"),
    "math_operation": (lambda Q, P, D, T, N: S.math_operation(Q, N - 2, 3), "case when l_linenumber = 2 then 0.0::double else l_quantity / (l_linenumber - 2) end"),
    "scalar_input": (lambda Q, P, D, T, N: S.scalar_input(2.5, 0), "3.0::double"),
    "string_input": (lambda Q, P, D, T, N: S.string_input("a text"), "'a text'"),
    "color_input": (lambda Q, P, D, T, N: S.color_input("#ff8800"), "'#ff8800'"),
    "canvas_note": (lambda Q, P, D, T, N: S.canvas_note("note"), "'note'"),
    "logic_compare": (lambda Q, P, D, T, N: S.logic_compare(Q, N * 5, ">="), "l_quantity >= l_linenumber * 5"),
    "logic_presence": (lambda Q, P, D, T, N: S.logic_presence(F.nullif(N, F.lit(3)) - 2), "coalesce(nullif(l_linenumber, 3) - 2 <> 0, false)"),
    "logic_switch": (lambda Q, P, D, T, N: S.logic_switch(F.nullif(N, F.lit(3)) > 1, Q, T), "case when coalesce(nullif(l_linenumber, 3) > 1, false) then l_quantity else l_tax end"),
    "logic_gate": (lambda Q, P, D, T, N: S.logic_gate(Q > 25, F.nullif(N, F.lit(3)) > 1, "xor"), "(l_quantity > 25) <> coalesce(nullif(l_linenumber, 3) > 1, false)"),
    "string_concat": (lambda Q, P, D, T, N: S.string_concat(F.col("l_returnflag"), F.col("l_linestatus"), "-"), "l_returnflag || '-' || l_linestatus"),
    "sci_calibration": (lambda Q, P, D, T, N: C.calibration(Q, 2.0, "area"), "l_quantity / 4.0"),
    "sci_interactive_calibration": (lambda Q, P, D, T, N: C.interactive_calibration(Q, T, D, N, 2.0)["factor"], "sqrt(power(l_quantity - l_discount, 2) + power(l_tax - l_linenumber, 2)) / 2.0"),
    "sci_visual_measure": (lambda Q, P, D, T, N: C.visual_measure(Q, T, D, N, 4.0)["length"], "sqrt(power(l_quantity - l_discount, 2) + power(l_tax - l_linenumber, 2)) / 4.0"),
    "math_3d_to_screen": (lambda Q, P, D, T, N: S.project_to_screen(Q, T, N - 2, flip=(True, False))["x"], "l_quantity * 1.0 / (case when abs(l_linenumber - 2) < 1e-4 then 1e-4 else l_linenumber - 2 end) * 1.0 * -1.0 + 0.5"),
    "ml_loss_explorer": (lambda Q, P, D, T, N: S.loss_and_gradient(D * 5 + 0.1, (N > 2).cast("double"), "smooth_l1")["loss"], "case when abs(l_discount * 5 + 0.1 - (l_linenumber > 2)::int) < 1 then 0.5 * power(l_discount * 5 + 0.1 - (l_linenumber > 2)::int, 2) else abs(l_discount * 5 + 0.1 - (l_linenumber > 2)::int) - 0.5 end"),
    "data_coord_combine": (lambda Q, P, D, T, N: C.coord_combine(Q, T, D, N)["h"], "l_linenumber"),
    "data_coord_splitter": (lambda Q, P, D, T, N: C.coord_splitter(F.struct(Q.alias("x"), T.alias("y")))["b"], "l_tax"),
    "dict_builder": (lambda Q, P, D, T, N: F.size(C.dict_builder(a=Q, b=F.nullif(T, F.lit(0.0)))), "case when l_tax = 0 then 1 else 2 end"),
    "util_dict_merge": (lambda Q, P, D, T, N: C.dict_merge(F.create_map(F.lit("a"), Q, F.lit("b"), T), F.create_map(F.lit("b"), D))["b"], "l_discount"),
    "data_group_dicts": (lambda Q, P, D, T, N: F.size(C.group_dicts(F.create_map(F.lit("a"), Q), F.when(N > 2, F.create_map(F.lit("a"), T)))), "case when l_linenumber > 2 then 2 else 1 end"),
    "dict_scale": (lambda Q, P, D, T, N: C.dict_scale(F.create_map(F.lit("a"), Q, F.lit("b"), T), 2.0, 2, skip_keys=("b",))["a"], "l_quantity * 4.0"),
    "plugin_dict_get": (lambda Q, P, D, T, N: C.dict_get(F.create_map(F.lit("a"), Q), "a", "z")["val_1"], "l_quantity"),
    "dict_report_panel": (lambda Q, P, D, T, N: F.array_join(F.transform(C.report_panel(F.create_map(F.lit("a"), Q, F.lit("b"), T, F.lit("c"), D), ["c", "*"]), lambda e: e["key"]), ","), "'c,a,b'"),
    "sci_analysis_report": (lambda Q, P, D, T, N: C.analysis_report(F.create_map(F.lit("a"), Q))["a"], "l_quantity"),
    "util_coord_center": (lambda Q, P, D, T, N: C.coord_center(F.struct(Q.alias("xmin"), T.alias("ymin"), D.alias("width"), N.alias("height")))["cy"], "l_tax + l_linenumber / 2"),
    "geo_bbox": (lambda Q, P, D, T, N: C.geo_bbox(1, 2, 3, 4)["lat_max"], "4.0::double"),
    "util_manual_points": (lambda Q, P, D, T, N: F.size(C.manual_points_of([(0, 0), (1, 0), (1, 1), (0, 1)])), "4"),
    "manual_points": (lambda Q, P, D, T, N: C.manual_points(F.lit('[{"x": 1, "y": 2}]'))["count"], "1"),
    "draw_point": (lambda Q, P, D, T, N: F.lit("point"), "'point'"),
}


def _line(name: str, build, sql: str) -> None:
    @case(name, f"select l_orderkey, l_linenumber, {'round(' + sql + ', 6)' if _double(name) else sql} as result from lineitem")
    def query(spark, sf_dir):
        return r6(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", build(*_columns()).alias("result")))


def _double(name: str) -> bool:
    return name not in {
        "math_round", "string_input", "color_input", "canvas_note", "logic_compare", "logic_presence", "logic_gate", "string_concat", "data_coord_combine",
        "dict_builder", "data_group_dicts", "dict_report_panel", "util_manual_points", "manual_points", "draw_point",
    }


for _name, (_build, _sql) in LINE.items():
    if _name != "draw_point":
        _line(_name, _build, _sql)

PART = {
    "string_split": (lambda: S.string_split(F.col("p_type"), " ")["first"], "split_part(p_type, ' ', 1)"),
    "string_length": (lambda: S.string_length(F.col("p_name")), "length(p_name)::int"),
    "string_case": (lambda: S.string_case(F.col("p_name"), "upper"), "upper(p_name)"),
    "string_replace": (lambda: S.string_replace(F.col("p_name"), "a.", "<$0>", use_regex=True, case=False), r"regexp_replace(p_name, '(?i)a.', '<\0>', 'g')"),
}


def _part(name: str, build, sql: str) -> None:
    @case(name, f"select p_partkey, {sql} as result from part")
    def query(spark, sf_dir):
        return table(spark, sf_dir, "part").select("p_partkey", build().alias("result"))


for _name, (_build, _sql) in PART.items():
    _part(_name, _build, _sql)


def _whole():
    return F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))


X = "list_transform(embedding, lambda x: floor(x::double * 100)::bigint)"
LISTS = {
    "data_list_ops": (lambda: F.array_join(C.list_op(C.list_op(_whole(), "slice", start=-20, step=3), "sort_desc"), ","), f"array_to_string(list_reverse_sort(list_filter({X}[45:], lambda v, i: (i - 1) % 3 = 0)), ',')"),
    "data_list_selector": (lambda: C.list_selector(_whole(), 5), f"({X})[6]"),
    "sci_scalar_list": (lambda: C.scalar_list(F.concat_ws("; ", F.transform(_whole(), lambda v: v.cast("string"))))["count"], "64"),
    "util_landmark_selector": (lambda: F.round(C.landmark_selector(F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("x"), i.alias("y"))), [1, 5, 9])["width"], 6), "round(greatest(embedding[2], embedding[6], embedding[10])::double - least(embedding[2], embedding[6], embedding[10])::double, 6)"),
    "geom_track_line": (lambda: F.round(C.track_line(F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("x"), v.cast("double").alias("y"))), 0, 1), 6), "round(sqrt(2 * power(embedding[1]::double - embedding[2]::double, 2)), 6)"),
    "geom_track_point": (lambda: F.round(C.track_point(F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("x"), v.cast("double").alias("y"))), 3, 10, 10)["x"], 6), "round(embedding[4]::double * 10, 6)"),
    "geom_track_polygon": (lambda: F.round(C.track_polygon(F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("x"), (v.cast("double") * v.cast("double")).alias("y"))), [0, 1, 2]), 6), "round(abs(embedding[1]::double * power(embedding[2]::double, 2) - embedding[2]::double * power(embedding[1]::double, 2) + embedding[2]::double * power(embedding[3]::double, 2) - embedding[3]::double * power(embedding[2]::double, 2) + embedding[3]::double * power(embedding[1]::double, 2) - embedding[1]::double * power(embedding[3]::double, 2)) / 2, 6)"),
}


def _boxes():
    f = lambda i: F.abs(F.get("embedding", i).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(f(k * 4).alias("xmin"), f(k * 4 + 1).alias("ymin"), f(k * 4 + 2).alias("width"), f(k * 4 + 3).alias("height"), f(k * 4).alias("score"), F.concat(F.lit("Box"), (k % 3).cast("string")).alias("label")))


BOXES = "list_transform(range(0, 16), lambda k: {'xmin': abs(embedding[4 * k + 1]::double), 'ymin': abs(embedding[4 * k + 2]::double), 'width': abs(embedding[4 * k + 3]::double), 'height': abs(embedding[4 * k + 4]::double), 'label': 'Box' || (k % 3)})"
LISTS |= {
    "util_filter_label": (lambda: F.size(C.filter_label(_boxes(), "box1")["list"]), f"len(list_filter({BOXES}, lambda b: contains(lower(b.label), 'box1')))::int"),
    "list_region_select": (lambda: F.round(C.region_select(_boxes(), 0.001)["item"]["width"] * C.region_select(_boxes(), 0.001)["item"]["height"], 6), f"round(list_max(list_filter(list_transform({BOXES}, lambda b: b.width * b.height), lambda a: a >= 0.001)), 6)"),
    "box_selection": (lambda: F.round(C.box_selection(_boxes(), "smallest")["width"] * C.box_selection(_boxes(), "smallest")["height"], 6), f"round(list_min(list_transform({BOXES}, lambda b: b.width * b.height)), 6)"),
    "bbox_transform": (lambda: F.size(C.bbox_transform(_boxes(), 0.0, min_size=0.1)), f"len(list_filter({BOXES}, lambda b: greatest(least(1.0, b.xmin + b.width) - least(1.0, b.xmin), least(1.0, b.ymin + b.height) - least(1.0, b.ymin)) >= 0.1))::int"),
    "util_on_each": (lambda: F.get(C.on_each(_boxes(), F.lit("t"), "label"), F.lit(4))["text"], "'Box1'"),
}


def _list(name: str, build, sql: str) -> None:
    @case(name, f"select vec_id, {sql} as result from embeddings")
    def query(spark, sf_dir):
        return table(spark, sf_dir, "embeddings").select("vec_id", build().alias("result"))


for _name, (_build, _sql) in LISTS.items():
    _list(_name, _build, _sql)


@case("signal_generator", "select event_id, round(case when value * 0.1 - floor(value * 0.1) < 0.5 then 2.0 else -2.0 end + 1, 6) as square, round(2 * sin(value * 0.1 * 2 * pi()), 6) as sine from events")
def _generator(spark, sf_dir):
    from ..operators.signals import generator

    t = F.col("value")
    return r6(table(spark, sf_dir, "events").select("event_id", generator(t, "square", 0.1, 2.0, 1.0).alias("square"), generator(t, "sine", 0.1, 2.0).alias("sine")))
