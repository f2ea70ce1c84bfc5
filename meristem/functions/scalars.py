"""Scalar operators as Columns: arithmetic, logic and text.

Division and remainder by zero, and any non-finite result of an expression, give 0. Rounding is half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import operator


def _zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


@operator("math_add", "column")
def math_add(a: Column, b: Column) -> Column:
    return a + b


@operator("math_sub", "column")
def math_sub(a: Column, b: Column) -> Column:
    return a - b


@operator("math_mul", "column")
def math_mul(a: Column, b: Column) -> Column:
    return a * b


@operator("math_div", "column")
def math_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


@operator("math_mod", "column")
def math_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") % F.nullif(b.cast("double"), F.lit(0.0)))


@operator("math_min", "column")
def math_min(a: Column, b: Column) -> Column:
    return F.least(a, b)


@operator("math_max", "column")
def math_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


@operator("math_pow", "column")
def math_pow(a: Column, b: Column) -> Column:
    return F.pow(a, b)


@operator("math_abs", "column")
def math_abs(a: Column) -> Column:
    return F.abs(a)


@operator("math_round", "column")
def math_round(a: Column) -> Column:
    return F.floor(a + 0.5)


@operator("math_sin", "column")
def math_sin(a: Column) -> Column:
    return F.sin(a)


@operator("math_cos", "column")
def math_cos(a: Column) -> Column:
    return F.cos(a)


@operator("math_clamp", "column")
def math_clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(_lit(low), F.least(_lit(high), value))


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@operator("math_distance", "column")
def math_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


@operator("math_map_range", "column")
def math_map_range(value: Column, in_min: float, in_max: float, out_min: float, out_max: float, clamp: bool = False) -> Column:
    """Linear remap; an empty input range gives out_min."""
    if in_min == in_max:
        return F.when(value.isNotNull(), F.lit(float(out_min)))
    t = (value - in_min) / (in_max - in_min)
    t = math_clamp(t, 0.0, 1.0) if clamp else t
    return F.lit(float(out_min)) + t * (out_max - out_min)


@operator("math_operation", "column")
def math_operation(a: Column, b: Column, operation: int = 0) -> Column:
    """0 to 3: sum, difference, product, quotient (0 for a zero divisor); others give 0."""
    forms = {0: math_add, 1: math_sub, 2: math_mul, 3: math_div}
    return forms[operation](a, b) if operation in forms else F.lit(0.0)


@operator("math_3d_to_screen", "column")
def project_to_screen(x: Column, y: Column, z: Column, focal: float = 1.0, scale: tuple[float, float] = (1.0, 1.0), offset: tuple[float, float] = (0.5, 0.5), flip: tuple[bool, bool] = (False, False), clamp: bool = False) -> Column:
    """Pinhole projection to struct(x, y); depths under 1e-4 in size count as 1e-4."""
    depth = F.when(F.abs(z) < 1e-4, F.lit(1e-4)).otherwise(z)
    out = []
    for v, s, o, f in zip((x, y), scale, offset, flip, strict=True):
        p = v * focal / depth * s * (-1.0 if f else 1.0) + o
        out.append(math_clamp(p, 0.0, 1.0) if clamp else p)
    return F.struct(out[0].alias("x"), out[1].alias("y"))


@operator("scalar_input", "column")
def scalar_input(value: float, format: int = 1) -> Column:
    """A constant; format 0 rounds it half up."""
    return F.floor(F.lit(float(value)) + 0.5).cast("double") if format == 0 else F.lit(float(value))


@operator("string_input", "column")
def string_input(value: str) -> Column:
    return F.lit(value)


@operator("color_input", "column")
def color_input(value: str) -> Column:
    return F.lit(value)


@operator("canvas_note", "column")
def canvas_note(text: str) -> Column:
    return F.lit(text)


# Logic


@operator("logic_compare", "column")
def logic_compare(a: Column, b: Column, op: str = "==") -> Column:
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    x, y = a.cast("double"), b.cast("double")
    return F.coalesce({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op], F.lit(False))


@operator("logic_presence", "column")
def logic_presence(data: Column, kind: str = "number") -> Column:
    """Not null and, by kind, not zero (number) or not empty (list, text)."""
    filled = {"number": lambda: data != 0, "list": lambda: F.size(data) > 0, "text": lambda: data != "", "bool": lambda: data}[kind]()
    return F.coalesce(filled, F.lit(False))


@operator("logic_switch", "column")
def logic_switch(condition: Column, if_true: Column, if_false: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), if_true).otherwise(if_false)


@operator("logic_gate", "column")
def logic_gate(a: Column, b: Column | None = None, mode: str = "and") -> Column:
    a = F.coalesce(a, F.lit(False))
    b = F.coalesce(b, F.lit(False)) if b is not None else F.lit(False)
    return {"and": a & b, "or": a | b, "xor": a != b, "not": ~a}[mode]


# Text


@operator("string_concat", "column")
def string_concat(a: Column, b: Column, separator: str = "") -> Column:
    return F.concat_ws(separator, a.cast("string"), b.cast("string"))


@operator("string_split", "column")
def string_split(text: Column, separator: str = ",") -> Column:
    """struct(list, first); an empty separator splits into characters."""
    pattern = "(?!^)(?!$)" if separator == "" else "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(text, pattern)
    return F.struct(parts.alias("list"), F.get(parts, F.lit(0)).alias("first"))


@operator("string_length", "column")
def string_length(text: Column) -> Column:
    """Code points."""
    return F.length(text)


@operator("string_case", "column")
def string_case(text: Column, mode: str = "upper") -> Column:
    return F.upper(text) if mode == "upper" else F.lower(text)


@operator("string_replace", "column")
def string_replace(text: Column, search: str, replace: str, use_regex: bool = False, case: bool = True) -> Column:
    if search == "":
        return text
    if not use_regex and case:
        return F.replace(text, F.lit(search), F.lit(replace))
    pattern = search if use_regex else "\\Q" + search + "\\E"
    return F.regexp_replace(text, pattern if case else "(?i)" + pattern, replace if use_regex else replace.replace("\\", "\\\\").replace("$", "\\$"))


@operator("ml_loss_explorer", "column")
def loss_and_gradient(p: Column, y: Column, loss: str = "ce", gamma: float = 2.0, alpha: float = 0.25, beta: float = 1.0, tau: float = 0.1) -> Column:
    """struct(loss, grad) of a prediction and a target: ce, dice, focal (p is a probability), smooth_l1, infonce (p: similarity to the positive, y: to a negative)."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    if loss == "ce":
        value, grad = -(y * F.log(q) + (1 - y) * F.log(1 - q)), (q - y) / (q * (1 - q))
    elif loss == "dice":
        value, grad = 1 - 2 * p * y / (p + y + 1e-7), -2 * y * (y + 1e-7) / F.pow(p + y + 1e-7, F.lit(2))
    elif loss == "focal":
        pt, a = F.when(y == 1, q).otherwise(1 - q), F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
        value = -a * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)
        grad = a * (gamma * F.pow(1 - pt, F.lit(gamma - 1)) * F.log(pt) - F.pow(1 - pt, F.lit(gamma)) / pt) * F.when(y == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    elif loss == "smooth_l1":
        d = p - y
        value = F.when(F.abs(d) < beta, 0.5 * d * d / beta).otherwise(F.abs(d) - 0.5 * beta)
        grad = F.when(F.abs(d) < beta, d / beta).otherwise(F.signum(d))
    elif loss == "infonce":
        value = F.log1p(F.exp((y - p) / tau))
        grad = -1 / (tau * (1 + F.exp((p - y) / tau)))
    else:
        raise ValueError(f"unknown loss {loss}")
    return F.struct(value.alias("loss"), grad.alias("grad"))
