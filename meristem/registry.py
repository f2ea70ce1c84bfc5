"""Catalogue of operators by their graph type name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Operator:
    """kind: "table" takes and gives DataFrames, "column" takes and gives Columns, "source" and "sink" touch storage."""

    name: str
    kind: str
    build: Callable


OPERATORS: dict[str, Operator] = {}


def operator(name: str, kind: str = "table") -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        if name in OPERATORS:
            raise ValueError(f"operator {name} is registered twice")
        OPERATORS[name] = Operator(name, kind, f)
        return f

    return add


def get(name: str) -> Operator:
    load_all()
    return OPERATORS[name]


def load_all() -> dict[str, Operator]:
    """Imports every module that registers operators."""
    from . import functions, operators, sources  # noqa: F401
    from .functions import collections, expressions, scalars  # noqa: F401
    from .operators import features, geometry, graphics, keypoints, labels, learning, pixels, prints, relational, segmentation, signals, statistics, stencils, tracking, user_code  # noqa: F401
    from .sources import readers, writers  # noqa: F401

    return OPERATORS
