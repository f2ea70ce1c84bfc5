"""Structured Streaming forms of the stateful operators: the state of each key lives in the state store between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(stream: DataFrame, key: str, order: str, value: str, state_schema: str, start: Callable[[float], tuple], step: Callable[[tuple, float], tuple], out: Callable[[tuple], Any], out_type: str = "double") -> DataFrame:
    """(key, order, value, filtered): a left fold over each key's values. Rows of one batch are taken in order; rows later than a batch count when they come."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        held = state.get if state.exists else None
        found = []
        for v in rows[value]:
            held = start(v) if held is None else step(held, v)
            found.append(out(held))
        if held is not None:
            state.update(tuple(held))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(), "filtered": found})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, filtered {out_type}"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def exponential_average(stream: DataFrame, key: str, order: str, value: str, alpha: float = 20) -> DataFrame:
    a = alpha / 100
    return fold_stream(stream, key, order, value, "s double", lambda v: (v,), lambda s, v: (a * v + (1 - a) * s[0],), lambda s: s[0])


def kalman(stream: DataFrame, key: str, order: str, value: str, q: float = 10, r: float = 10) -> DataFrame:
    q, r = q / 1000, r / 100

    def step(s: tuple, v: float) -> tuple:
        p = s[1] + q
        k = p / (p + r)
        return s[0] + k * (v - s[0]), (1 - k) * p

    return fold_stream(stream, key, order, value, "x double, p double", lambda v: (v, 1.0), step, lambda s: s[0])


def latch(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value that isn't zero."""
    return fold_stream(stream, key, order, value, "s double", lambda v: (v,), lambda s, v: (v if v else s[0],), lambda s: s[0])


def collect(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How many values a key has given so far."""
    return fold_stream(stream, key, order, value, "n long", lambda _: (1,), lambda s, _: (s[0] + 1,), lambda s: s[0], "long")


def collect_new_tables(stream: DataFrame, seq: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose sequence number was not seen before, within a watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([seq])


def windowed(stream: DataFrame, at: str, value: str, by: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Count, mean and sum by tumbling (or sliding) event-time window; rows later than the delay are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("sum")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "sum")


def sessions(stream: DataFrame, at: str, by: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
