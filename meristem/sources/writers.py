"""Sinks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..registry import operator


@operator("df_export", "sink")
def export(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """csv (with a header; whole numbers in fractional columns keep .0, missing values are empty), json or parquet."""
    if format == "csv":
        text = [F.when(~F.isnan(c), F.col(f"`{c}`").cast("string")).alias(c) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else F.col(f"`{c}`") for c in df.columns]
        df.select(*text).write.mode(mode).csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
    elif format in ("json", "parquet", "orc"):
        df.write.mode(mode).format(format).save(path)
    else:
        raise ValueError(f"unknown format {format}")


def encode_png(px: np.ndarray) -> bytes:
    """A PNG of height x width (grey) or height x width x 3 (b, g, r) bytes."""
    colour = px.ndim == 3
    rows = (px[..., ::-1] if colour else px).astype(np.uint8).reshape(len(px), -1)
    body = zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 2 if colour else 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@operator("output_save_frame", "sink")
def encoded_frames(pixels: DataFrame) -> DataFrame:
    """(raster_id, png binary): one image per raster, which has to fit in a task."""
    bands = ["b", "g", "r"] if "b" in pixels.columns else ["v"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
        px = np.zeros((h, w, len(bands)), np.uint8)
        for i, b in enumerate(bands):
            px[rows["y"], rows["x"], i] = rows[b].clip(0, 255).fillna(0)
        return pd.DataFrame({"raster_id": [str(rows["raster_id"].iloc[0])], "png": [encode_png(px if len(bands) == 3 else px[..., 0])]})

    return pixels.select("raster_id", "y", "x", *bands).groupBy("raster_id").applyInPandas(run, "raster_id string, png binary")


def save_frames(frames: DataFrame, folder: str, column: str = "png", suffix: str = ".png") -> DataFrame:
    """Writes each row's bytes as a file named by its raster_id, a whole number, in a folder that all tasks reach; (raster_id, path). A file is written under another name and renamed."""
    import uuid
    from collections.abc import Iterator

    import pyarrow as pa

    from .datasources import opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, inner = opened(folder)
            fs.create_dir(inner, recursive=True)
            paths = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draft = f"{inner}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(data)
                paths.append(f"{inner}/{int(name):09d}{suffix}")
                fs.move(draft, paths[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["raster_id", "path"])

    return frames.select(F.col("raster_id").cast("string").alias("raster_id"), column).mapInArrow(run, "raster_id string, path string")


def encode_tiff(px: np.ndarray, rows: int = 16, tie: tuple[float, float] = (0.0, 0.0), scale: float = 1.0, nodata: float | None = None, deflate: bool = True, apart: bool = False) -> bytes:
    """A little-endian GeoTIFF of bands x height x width doubles in strips of some rows."""
    bands, h, w = px.shape
    cut = [(b, y) for b in (range(bands) if apart else [None]) for y in range(0, h, rows)]
    strips = [np.ascontiguousarray(px[b, y : y + rows] if apart else px[:, y : y + rows].transpose(1, 2, 0)).astype("<f8").tobytes() for b, y in cut]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    body = b"".join(strips)
    offsets = (8 + np.concatenate(([0], np.cumsum([len(s) for s in strips])[:-1]))).astype(int).tolist()
    text = f"{nodata}\0".encode() if nodata is not None else b""
    entries = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [64]), (259, 3, [8 if deflate else 1]), (273, 4, offsets), (277, 3, [bands]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (284, 3, [2 if apart else 1]), (339, 3, [3]),
        (33550, 12, [scale, scale, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *tie, 0.0]), *([(42113, 2, text)] if text else []),
    ]
    at, table, extra = 8 + len(body), b"", b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        data = values if kind == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *values)
        table += struct.pack("<HHI", tag, kind, len(values))
        table += data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(extra))
        extra += data if len(data) > 4 else b""
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(entries)) + table + b"\0\0\0\0" + extra


def encoded_tiffs(pixels: DataFrame, rows: int = 16) -> DataFrame:
    """(raster_id, tiff binary) of (raster_id, y, x, v): one file per raster, which has to fit in a task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        px = np.zeros((1, int(part["y"].max()) + 1, int(part["x"].max()) + 1))
        px[0, part["y"], part["x"]] = part["v"]
        return pd.DataFrame({"raster_id": [str(part["raster_id"].iloc[0])], "tiff": [encode_tiff(px, rows)]})

    return pixels.select("raster_id", "y", "x", "v").groupBy("raster_id").applyInPandas(run, "raster_id string, tiff binary")
