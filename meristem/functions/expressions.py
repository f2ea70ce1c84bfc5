"""Arithmetic expressions given as text, compiled from Python's syntax tree into Columns; nothing is evaluated."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import operator

_ONE: dict[str, Callable] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sqrt": F.sqrt, "exp": F.exp, "log": F.log,
    "log2": F.log2, "log10": F.log10, "floor": F.floor, "ceil": F.ceil, "abs": F.abs, "sign": F.signum, "deg": F.degrees, "rad": F.radians,
    "round": lambda x: F.floor(x + 0.5), "frac": lambda x: x - F.floor(x),
}
_MANY: dict[str, Callable] = {
    "pow": F.pow, "atan2": F.atan2, "min": F.least, "max": F.greatest,
    "clamp": lambda x, a, b: F.greatest(a, F.least(b, x)), "clip": lambda x, a, b: F.greatest(a, F.least(b, x)), "lerp": lambda a, b, t: a + (b - a) * t,
}
_NAMES = {"pi": math.pi, "e": math.e, "inf": math.inf}


def compile_expression(text: str, columns: Mapping[str, Column]) -> Column:
    """A Column for + - * / % ** comparisons, and/or/not, x if c else y, the functions above, df['name'] and df.name. Raises ValueError on anything else."""

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return build(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str, bool)):
            return F.lit(float(n.value)) if isinstance(n.value, (int, float)) and not isinstance(n.value, bool) else F.lit(n.value)
        if isinstance(n, ast.Name):
            if n.id in columns:
                return columns[n.id]
            if n.id in _NAMES:
                return F.lit(_NAMES[n.id])
            raise ValueError(f"unknown name {n.id}")
        if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant) and n.slice.value in columns:
            return columns[n.slice.value]
        if isinstance(n, ast.Attribute) and n.attr in columns:
            return columns[n.attr]
        if isinstance(n, ast.UnaryOp):
            x = build(n.operand)
            return {ast.USub: lambda: -x, ast.UAdd: lambda: x, ast.Not: lambda: ~x, ast.Invert: lambda: ~x}[type(n.op)]()
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            forms = {
                ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Mod: lambda: F.try_mod(a, b),
                ast.Pow: lambda: F.pow(a, b), ast.BitAnd: lambda: a & b, ast.BitOr: lambda: a | b, ast.FloorDiv: lambda: F.floor(F.try_divide(a, b)),
            }
            if type(n.op) in forms:
                return forms[type(n.op)]()
        if isinstance(n, ast.Compare):
            parts, left = [], build(n.left)
            for op, right in zip(n.ops, map(build, n.comparators), strict=True):
                parts.append({ast.Lt: left < right, ast.LtE: left <= right, ast.Gt: left > right, ast.GtE: left >= right, ast.Eq: left == right, ast.NotEq: left != right}[type(op)])
                left = right
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out
        if isinstance(n, ast.BoolOp):
            out = build(n.values[0])
            for v in n.values[1:]:
                out = out & build(v) if isinstance(n.op, ast.And) else out | build(v)
            return out
        if isinstance(n, ast.IfExp):
            return F.when(build(n.test), build(n.body)).otherwise(build(n.orelse))
        if isinstance(n, ast.Call) and not n.keywords:
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
            args = [build(a) for a in n.args]
            if name in _ONE and len(args) == 1:
                return _ONE[name](*args)
            if name in _MANY and args:
                return _MANY[name](*args)
            raise ValueError(f"unknown function {name}")
        raise ValueError(f"not supported: {ast.dump(n)[:60]}")

    return build(ast.parse(text, mode="eval"))


@operator("math_expr", "column")
def math_expr(expression: str, **inputs: Column) -> Column:
    """An expression over inputs a to z; a null or non-finite result gives 0, as does text that isn't an expression."""
    try:
        value = compile_expression(expression, inputs).cast("double")
    except (ValueError, SyntaxError, KeyError):
        return F.lit(0.0)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
