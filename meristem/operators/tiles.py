"""Rasters dealt out as square tiles with a halo, so that work on neighbourhoods runs on arrays.

A pixel goes once to its own tile and once to each tile whose halo it lies in. A tile's array ends at
the halo or at the raster's border, whichever comes first, so what is computed in the tile's core is
what the whole raster would give, as long as no value reaches further than the halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class Tile:
    """y0 and x0 are the raster's coordinates of the arrays' first pixel; the core is [top, bottom) x [left, right)."""

    y0: int
    x0: int
    top: int
    bottom: int
    left: int
    right: int
    planes: dict[str, np.ndarray]

    def in_core(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (y >= self.top) & (y < self.bottom) & (x >= self.left) & (x < self.right)


def _sent(df: DataFrame, columns: list[str], tile: int, halo: int, within: bool = False) -> DataFrame:
    """df's rows once for each tile (_ty, _tx) that holds or borders them; only for tiles that begin inside their raster if within, for which its size is found first."""
    last = lambda c: F.floor((F.col(c) + halo) / tile)
    if within:
        df = df.join(df.groupBy("raster_id").agg(*[F.floor(F.max(c) / tile).alias(f"_last_{c}") for c in ("y", "x")]), "raster_id")
        last = lambda c: F.least(F.floor((F.col(c) + halo) / tile), F.col(f"_last_{c}"))
    reach = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile)), last(c)))
    rows = df.withColumn("_ty", reach("y")).withColumn("_tx", reach("x"))
    return rows.select("raster_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in columns], "_ty", "_tx")


def widened(tile: int, halo: int) -> int:
    """The least multiple of a tile's side that is not under the halo: of smaller tiles, what is around them is sent and computed many times over."""
    return tile * max(1, -(-halo // tile))


def by_tiles(df: DataFrame, columns: list[str], compute: Callable[[Tile], dict[str, np.ndarray | pa.Array]], schema: str, tile: int = 512, halo: int = 16, within: bool = False) -> DataFrame:
    """(raster_id, *schema): compute's columns for each tile of df(raster_id, y, x, *columns). Pixels that a raster lacks are 0; of repeated ones the last counts. within: tiles beyond a raster's border, which only its halo reaches, are left out."""
    dealt = _sent(df, columns, tile, halo, within)
    kind = df.schema["raster_id"].dataType.simpleString()
    out = f"raster_id {kind}, {schema}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        ty, tx = key[1].as_py(), key[2].as_py()
        y0, x0 = int(y.min()), int(x.min())
        shape = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
        planes = {}
        for c in columns:
            planes[c] = np.zeros(shape)
            planes[c][y - y0, x - x0] = table.column(c).to_numpy()
        found = compute(Tile(y0, x0, ty * tile, (ty + 1) * tile, tx * tile, (tx + 1) * tile, planes))
        n = len(found[types.names[0]])
        cast = {f.name: found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name]).cast(f.type) for f in types}
        return pa.table({"raster_id": pa.array([key[0].as_py()] * n, table.column("raster_id").type), **cast})

    return dealt.groupBy("raster_id", "_ty", "_tx").applyInArrow(run, out)



AREA = 1 << 21  # places of a stack of more than one tile


@dataclass
class Stack:
    """Tiles one below the other, with empty rows between; a place is (row, col). Of each tile: its first row, that place's y and x in the raster, and the core's first y and x."""

    tile: int
    rows: np.ndarray
    y0: np.ndarray
    x0: np.ndarray
    top: np.ndarray
    left: np.ndarray
    planes: dict[str, np.ndarray]

    def of(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, row, side="right") - 1

    def y(self, row: np.ndarray) -> np.ndarray:
        n = self.of(row)
        return row - self.rows[n] + self.y0[n]

    def x(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return col + self.x0[self.of(row)]

    def in_core(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        n, y, x = self.of(row), self.y(row), self.x(row, col)
        return (y >= self.top[n]) & (y < self.top[n] + self.tile) & (x >= self.left[n]) & (x < self.left[n] + self.tile)


def _new(column: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it."""
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_new(c) for c in column.flatten()])
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False) | (missing[1:] != missing[:-1])


def by_stacks(df: DataFrame, columns: list[str], compute: Callable[[Stack], dict[str, np.ndarray | pa.Array]], schema: str, tile: int = 512, halo: int = 16) -> DataFrame:
    """by_tiles for compute that takes many tiles at once, stacked with halo + 1 empty rows between; it gives the row of each result as `row` besides the schema's columns. A task holds a batch of rows and the tile that it ends in."""
    dealt = _sent(df, columns, tile, halo).repartition("raster_id", "_ty", "_tx").sortWithinPartitions("raster_id", "_ty", "_tx")
    out = f"raster_id {df.schema['raster_id'].dataType.simpleString()}, {schema}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def stacked(t: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, x = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        low, high = ([f.reduceat(v, starts) for v in (y, x)] for f in (np.minimum, np.maximum))
        ends = np.append(starts[1:], len(y))
        tall, wide = high[0] - low[0] + 2 + halo, high[1] - low[1] + 1
        a = 0
        while a < len(starts):
            area = np.cumsum(tall[a:]) * np.maximum.accumulate(wide[a:])
            b = a + max(1, int(np.searchsorted(area, AREA, side="right")))
            rows = np.cumsum(tall[a:b]) - tall[a:b]
            own, n = slice(starts[a], ends[b - 1]), np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            place = rows[n] + y[own] - low[0][a:b][n], x[own] - low[1][a:b][n]
            planes = {c: np.zeros((int(tall[a:b].sum()), int(wide[a:b].max()))) for c in columns}
            for c in columns:
                planes[c][place] = t.column(c).to_numpy(zero_copy_only=False)[own]
            first = t.take(pa.array(starts[a:b]))
            s = Stack(tile, rows, low[0][a:b], low[1][a:b], first.column("_ty").to_numpy() * tile, first.column("_tx").to_numpy() * tile, planes)
            found = compute(s)
            ids = first.column("raster_id").take(pa.array(s.of(found["row"])))
            yield pa.RecordBatch.from_arrays([ids, *[found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name]).cast(f.type) for f in types]], names=["raster_id", *types.names])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the tile that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]) if held else batch
            new = np.flatnonzero(np.logical_or.reduce([_new(joined.column(c)) for c in ("raster_id", "_ty", "_tx")])) + (0 if held else 1)
            if not len(new):
                held.append(batch)
                continue
            ready = pa.concat_batches([*held, batch.slice(0, int(new[-1]))])
            before = sum(h.num_rows for h in held)
            yield from stacked(ready, np.unique(np.append(0, new[:-1] + before)))
            held = [batch.slice(int(new[-1]))]
        if held:
            yield from stacked(pa.concat_batches(held), np.array([0]))

    return dealt.mapInArrow(run, out)
