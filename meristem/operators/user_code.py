"""User code over tables. It runs as given: this is no sandbox, so only trusted code belongs here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression
from ..registry import operator


@operator("logic_python")
def run_python(df: DataFrame, body: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None) -> DataFrame:
    """A function of a pandas frame: over Arrow batches, or over whole groups where by is given (a group must fit in a task)."""
    if by:
        return df.groupBy(*by).applyInPandas(body, schema)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield body(p)

    return df.mapInPandas(batches, schema)


@operator("sci_region_classifier")
def classify_regions(regions: DataFrame, rules: list[tuple[str, str]], default: str = "other") -> DataFrame:
    """Adds class: the first rule (expression over the region's columns, name) that holds."""
    names = {c: F.col(f"`{c}`") for c in regions.columns}
    out = F.lit(default)
    for expression, name in reversed(rules):
        out = F.when(compile_expression(expression, names), F.lit(name)).otherwise(out)
    return regions.withColumn("class", out)
