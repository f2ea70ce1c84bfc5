"""Work in one order over a whole table, piece by piece.

Rows are dealt by ranges of their order into sorted partitions, which are written once. What a piece
needs from those before it is a few numbers, found in a first pass and carried over on the driver (a row
or two for each piece); a second pass then works on all pieces at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut

BLOCK = 256  # values whose trace in the state is summed at a time


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in the order, from 0."""
    rows = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).select("__p", "__o")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + F.col("__o")
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, place).drop("__p", "__o")


def filled(df: DataFrame, names: list[str], order: list[Column], forward: bool) -> DataFrame:
    """df with missing values of the named columns taken from the nearest row before (or after) that has one."""
    column = lambda n: F.col("`" + n.replace("`", "``") + "`")
    rows = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    inside, across = Window.partitionBy("__p").orderBy(*order), Window.orderBy("__p")
    if forward:
        inside, across, pick = inside.rowsBetween(Window.unboundedPreceding, 0), across.rowsBetween(Window.unboundedPreceding, -1), F.last
        in_order = F.max_by
    else:
        inside, across, pick = inside.rowsBetween(0, Window.unboundedFollowing), across.rowsBetween(1, Window.unboundedFollowing), F.first
        in_order = F.min_by
    at = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    marked = rows.withColumn("__i", at)
    own = marked.groupBy("__p").agg(*[in_order(column(n), F.when(column(n).isNotNull(), F.col("__i"))).alias(f"__v{i}") for i, n in enumerate(names)])  # a row for each piece
    carried = own.select("__p", *[pick(f"__v{i}", ignorenulls=True).over(across).alias(f"__c{i}") for i in range(len(names))])
    out = rows.join(F.broadcast(carried), "__p", "left")
    return out.withColumns({n: F.coalesce(pick(column(n), ignorenulls=True).over(inside), F.col(f"__c{i}")) for i, n in enumerate(names)}).select(*[column(c) for c in df.columns])


@dataclass(frozen=True)
class Linear:
    """A filter whose state, a tuple that begins as first(v), becomes step(state, v) with each value v, and gives its first number.

    step has to be linear: matrix s + gain v. So what a piece does to any state that comes into it is
    found from one number of values and the state that they leave of 0.
    """

    first: Callable[[float], tuple[float, ...]]
    step: Callable[[tuple[float, ...], float], tuple[float, ...]]
    matrix: np.ndarray
    gain: np.ndarray

    def reach(self) -> np.ndarray:
        """What a value has left in the state after 0 .. BLOCK - 1 steps more."""
        out = [self.gain]
        for _ in range(BLOCK - 1):
            out.append(self.matrix @ out[-1])
        return np.array(out)

    def run(self, values: np.ndarray, state: tuple | None) -> tuple[np.ndarray, tuple | None]:
        """Outputs of values (without missing ones), and the state after them, value by value."""
        out = []
        for v in values.tolist():
            state = self.first(v) if state is None else self.step(state, v)
            out.append(state[0])
        return np.array(out, float), state

    def after(self, values: np.ndarray, state: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The state after values, by blocks."""
        for k in range(0, len(values), len(reach)):
            v = values[k : k + len(reach)]
            state = np.linalg.matrix_power(self.matrix, len(v)) @ state + reach[: len(v)][::-1].T @ v
        return state


def linear_fold(df: DataFrame, value: str, order: str, by: list[str], model: Linear) -> DataFrame:
    """(by, order, value, filtered): the filter over each stream, whose length no task has to bear: a stream may lie in many pieces.

    A null value leaves the state as it is, and before the first value there is none. Of rows with equal
    keys and order the smaller value goes first.
    """
    names = list(dict.fromkeys([*by, order])) + [value]
    rows = df.select(*names[:-1], F.col(value).cast("double").alias(value))
    schema = StructType([*rows.schema.fields, StructField("filtered", DoubleType())])
    ready = cut(rows.repartitionByRange(*names).sortWithinPartitions(*names))
    places = list(range(len(by)))
    reach = model.reach()
    size = len(model.gain)

    def streams(batch: pa.RecordBatch) -> list[tuple[tuple, int, int]]:
        """(key, first row, end) of a sorted batch's streams."""
        n = batch.num_rows
        if not n:
            return []
        new = np.zeros(n, bool)
        new[0] = True
        for i in places:
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        at = np.append(np.flatnonzero(new), n).tolist()
        return [(tuple(batch.column(i)[a].as_py() for i in places), a, b) for a, b in zip(at[:-1], at[1:], strict=True)]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a piece's first and last stream: how many values it has here, and the state after them if it begins here, or begins with 0."""
        first = last = None
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            known, numbers = v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy()
            for key, a, b in streams(batch):
                if last is None or key != last[0]:
                    last = [key, 0, None, np.zeros(size)]
                    first = first or last
                    if last is not first and b < batch.num_rows:
                        continue  # it begins and ends inside the piece
                own = numbers[a:b][known[a:b]]
                last[2] = model.run(own, last[2])[1]
                last[3] = model.after(own, last[3], reach)
                last[1] += len(own)
        found = [] if last is None else [first] if first is last else [first, last]
        nothing = [0.0] * size
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array([f is last and f is not first for f in found], pa.bool_()), pa.array([f is first and f is last for f in found], pa.bool_()),
                pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] is not None for f in found], pa.bool_()), pa.array([nothing if f[2] is None else list(f[2]) for f in found], pa.list_(pa.float64())), pa.array([f[3].tolist() for f in found], pa.list_(pa.float64())),
                pa.array([repr(f[0]) for f in found], pa.string()),
            ],
            names=["p", "last", "only", "n", "begun", "fresh", "from_zero", "key"],
        )

    carried: dict[int, list[float]] = {}  # the state with which a piece's first stream goes on
    open_key, open_state = None, None
    summary = ready.mapInArrow(ends, "p int, last boolean, only boolean, n long, begun boolean, fresh array<double>, from_zero array<double>, key string").collect()  # two rows a piece at most
    for r in sorted(summary, key=lambda r: (r["p"], r["last"])):
        state = open_state if r["key"] == open_key and not r["last"] else None
        if state is not None:
            carried[r["p"]] = state.tolist()
            state = np.linalg.matrix_power(model.matrix, r["n"]) @ state + np.array(r["from_zero"])
        else:
            state = np.array(r["fresh"]) if r["begun"] else None
        open_key, open_state = r["key"], state
    shared = df.sparkSession.sparkContext.broadcast(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, first = None, None, True
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            known, numbers = v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy()
            out = np.full(batch.num_rows, np.nan)
            none = np.ones(batch.num_rows, bool)
            for key, a, b in streams(batch):
                if first or key != stream:
                    state = tuple(shared.value[TaskContext.get().partitionId()]) if first and TaskContext.get().partitionId() in shared.value else None
                    stream, first = key, False
                own = np.flatnonzero(known[a:b])
                before = None if state is None else state[0]
                filtered, state = model.run(numbers[a:b][own], state)
                # rows without a value have what the last one left
                upto = np.searchsorted(own, np.arange(b - a), side="right") - 1
                has = upto >= 0
                out[a:b][has] = filtered[upto[has]]
                if before is not None:
                    out[a:b][~has] = before
                    has = np.ones(b - a, bool)
                none[a:b] = ~has
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), mask=none)], names=schema.names)

    return ready.mapInArrow(run, schema)
