"""Sources: tables, text tables, images and frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..registry import operator

#: Texts that mean a missing value, in lower case.
MISSING = ("", "na", "n/a", "nan", "null", "none", "#n/a", "-")


@operator("ml_csv_reader", "source")
def read_csv(spark: SparkSession, path: str, separator: str = ",", max_rows: int | None = None) -> DataFrame:
    """A CSV file with a header. Missing-value texts are null; a column's type is inferred from all its values: long, double, boolean or text. Repeated names get .1, .2."""
    raw = spark.read.csv(path, header=False, sep=separator, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    head = spark.read.text(path).limit(1).first()
    if head is None:
        return raw
    names: list[str] = []
    first = raw.limit(1).first()
    for i, c in enumerate(first):
        base = (c or f"column{i}").strip()
        name, k = base, 0
        while name in names:
            k += 1
            name = f"{base}.{k}"
        names.append(name)
    text = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True, enforceSchema=True, schema=", ".join(f"c{i} string" for i in range(len(names)))).toDF(*names)
    text = text.select(*[F.when(~F.lower(F.trim(F.col(f"`{n}`"))).isin(*MISSING), F.col(f"`{n}`")).alias(n) for n in names])
    if max_rows is not None:
        text = text.limit(max_rows)
    return infer_types(text)


def infer_types(df: DataFrame) -> DataFrame:
    """Casts text columns to the narrowest of long (no nulls), double, boolean that all their values allow; one aggregate."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not names:
        return df
    checks = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        t = F.trim(c)
        checks += [
            F.count_if(c.isNotNull()).alias(f"n{i}"), F.count_if(c.isNull()).alias(f"m{i}"), F.count_if(t.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.count_if(t.rlike(r"^[+-]?\d{1,18}$")).alias(f"l{i}"), F.count_if(F.lower(t).isin("true", "false")).alias(f"b{i}"),
        ]
    s = df.agg(*checks).first()
    kinds = {}
    for i, n in enumerate(names):
        filled = s[f"n{i}"]
        kinds[n] = "string" if not filled else "boolean" if s[f"b{i}"] == filled else ("bigint" if not s[f"m{i}"] else "double") if s[f"l{i}"] == filled else "double" if s[f"d{i}"] == filled else "string"
    return df.select(*[F.trim(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns])


@operator("ml_sklearn_dataset", "source")
def named_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a catalogue folder of Parquet files; the bundled teaching tables are not part of this repository."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Scan lines (a filter byte and data) of a PNG to bytes."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    before = np.zeros(out.shape[1], np.int32)
    for i, line in enumerate(lines):
        kind, row = line[0], line[1:].astype(np.int32)
        if kind == 2:
            row = row + before
        elif kind == 1:
            for c in range(bpp):
                row[c::bpp] = np.cumsum(row[c::bpp])
        elif kind in (3, 4):
            for x in range(len(row)):
                a, b, c = (row[x - bpp] if x >= bpp else 0), before[x], (before[x - bpp] if x >= bpp else 0)
                if kind == 3:
                    row[x] = (row[x] + (a + b) // 2) & 255
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    row[x] = (row[x] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        out[i] = before = row & 255
        before = before.astype(np.int32)
    return out


def decode_image(data: bytes) -> np.ndarray:
    """Height x width x 3 (b, g, r) of a binary PPM or PGM, or of an 8-bit PNG without interlace."""
    if data[:2] in (b"P5", b"P6"):
        parts, at = [], 2
        while len(parts) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            parts.append(int(data[at:end]))
            at = end
        w, h, _ = parts
        px = np.frombuffer(data, np.uint8, h * w * (3 if data[:2] == b"P6" else 1), at + 1).reshape(h, w, -1)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at, body, head = 8, b"", None
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
            elif kind == b"IDAT":
                body += data[at + 8 : at + 8 + n]
            at += 12 + n
        w, h, depth, colour, _, _, interlace = head
        if depth != 8 or interlace or colour not in (0, 2, 4, 6):
            raise ValueError("only 8-bit grey or true colour without interlace")
        bpp = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        px = _unfilter(np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bpp), bpp).reshape(h, w, bpp)
        px = px[..., :1] if colour in (0, 4) else px[..., :3]
    else:
        raise ValueError("not a PNG, PPM or PGM image")
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px[..., ::-1]


@operator("input_image", "source")
def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files to (raster_id = path, y, x, b, g, r); files are split among tasks, one file's pixels by Arrow batches of rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                px = decode_image(data)
                for y in range(0, px.shape[0], 256):
                    part = px[y : y + 256]
                    yy, xx = np.indices(part.shape[:2])
                    flat = part.reshape(-1, 3).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array((yy.ravel() + y).astype(np.int32)), pa.array(xx.ravel().astype(np.int32)), *[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]], names=["raster_id", "y", "x", "b", "g", "r"])

    return files.mapInArrow(run, "raster_id string, y int, x int, b double, g double, r double")


@operator("input_movie", "source")
def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A folder of numbered frame images as pixels (raster_id = path, frame, y, x, b, g, r) with total_frames; a partition is one frame."""
    from . import datasources

    return datasources.frames(spark, path).withColumn("total_frames", F.lit(len(datasources.FrameReader(path).partitions())))


@operator("input_webcam", "source")
def frame_stream(spark: SparkSession, path: str | None = None, rate: int = 5) -> DataFrame:
    """A stream of a camera's frames from the folder that it fills; without a folder, a stream of ticks (tick, timestamp) that stands in for one."""
    from . import datasources

    if path is not None:
        return datasources.frame_stream(spark, path)
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("tick"), "timestamp")


_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
_TIFF_CODE = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


@operator("geo_geotiff_reader", "source")
def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """GeoTIFF files in strips, uncompressed or deflated, to (raster_id, band, y, x, lon, lat, v); coordinates of pixel centres from the tie point and scale, no-data values null. A filter on y or band reads its strips alone."""
    from . import datasources

    return datasources.geotiff(spark, path)
