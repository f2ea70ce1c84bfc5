"""Data sources that plan their own partitions: strips of GeoTIFF files, and numbered frame images as a table or a stream.

A GeoTIFF's header is read where the scan is planned; a task reads the bytes of its strips alone, and
rows outside a window of y, band or file are not planned at all. A stream of frames remembers how many
of the folder's frames it has given, and goes on from there after a restart.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .readers import _TIFF_CODE, _TIFF_SIZE, decode_image

PIXELS = 1 << 20  # that a partition holds about
BATCH = 1 << 16  # rows of a batch


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str, pattern: str) -> list[str]:
    """The file itself, or the files of a folder whose names match, in order of name."""
    fs, inner = opened(path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    found = fs.get_file_info(pyarrow.fs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == pyarrow.fs.FileType.File and re.search(pattern, f.base_name))


@dataclass
class Layout:
    """What a TIFF's tags say: size, where its strips lie, and how pixels are stored."""

    order: str
    tags: dict

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.tags.get(277, [1])[0], self.tags[257][0], self.tags[256][0]

    @property
    def rows(self) -> int:
        """Rows of a strip."""
        return min(self.tags.get(278, [self.shape[1]])[0], self.shape[1])

    @property
    def apart(self) -> bool:
        """Whether each band has strips of its own."""
        return self.tags.get(284, [1])[0] == 2 and self.shape[0] > 1

    @property
    def kind(self) -> np.dtype:
        form = {1: "u", 2: "i", 3: "f"}[self.tags.get(339, [1])[0]]
        return np.dtype(f"{self.order}{form}{self.tags.get(258, [8])[0] // 8}")

    def strip(self, number: int, data: bytes) -> np.ndarray:
        """Bands x rows x width of one strip's bytes; a strip of one band has that band alone."""
        packing = self.tags.get(259, [1])[0]
        if packing in (8, 32946):
            data = zlib.decompress(data)
        elif packing != 1:
            raise ValueError("this compression is not supported")
        bands, h, w = self.shape
        per_band = -(-h // self.rows)
        rows = min(self.rows, h - number % per_band * self.rows)
        px = np.frombuffer(data, self.kind, rows * w * (1 if self.apart else bands))
        return (px.reshape(1, rows, w) if self.apart else px.reshape(rows, w, bands).transpose(2, 0, 1)).astype(float)


def layout(path: str) -> Layout:
    """Reads a file's header and tags, and none of its pixels."""
    fs, inner = opened(path)
    with fs.open_input_file(inner) as f:
        head = f.read_at(8, 0)
        order = "<" if head[:2] == b"II" else ">"
        at = struct.unpack(order + "I", head[4:8])[0]
        count = struct.unpack(order + "H", f.read_at(2, at))[0]
        entries = f.read_at(12 * count, at + 2)
        tags: dict = {}
        for i in range(count):
            tag, kind, n = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
            size = _TIFF_SIZE.get(kind, 1) * n
            data = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else f.read_at(size, struct.unpack(order + "I", entries[12 * i + 8 : 12 * i + 12])[0])
            if kind == 2:
                tags[tag] = data.split(b"\0")[0].decode()
            elif kind in _TIFF_CODE:
                tags[tag] = list(struct.unpack(f"{order}{n}{_TIFF_CODE[kind]}", data[:size]))
    return Layout(order, tags)


@dataclass
class Strips(InputPartition):
    path: str
    layout: Layout
    numbers: list[int]


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.low, self.high, self.band = 0, None, None

    def pushFilters(self, filters):  # noqa: N802
        """Windows of y and one band narrow what is planned; Spark applies all filters again to the rows of the strips read."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("y",) and isinstance(value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = value - isinstance(f, LessThan)
                    self.high = end if self.high is None else min(self.high, end)
            elif name == ("band",) and isinstance(f, EqualTo):
                self.band = value
            yield f

    def partitions(self) -> list[Strips]:
        out = []
        for path in listed(self.path, r"(?i)\.tiff?$"):
            lay = layout(path)
            bands, h, w = lay.shape
            per_band = -(-h // lay.rows)
            wanted = []
            for n in range(per_band * (bands if lay.apart else 1)):
                y0 = n % per_band * lay.rows
                if y0 + lay.rows > self.low and (self.high is None or y0 <= self.high) and (self.band is None or not lay.apart or n // per_band == self.band):
                    wanted.append(n)
            step = max(1, PIXELS // (lay.rows * w * (1 if lay.apart else bands)))
            out += [Strips(path, lay, wanted[k : k + step]) for k in range(0, len(wanted), step)]
        return out

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        lay = partition.layout
        _, h, w = lay.shape
        per_band = -(-h // lay.rows)
        scale, tie = lay.tags.get(33550, [1.0, 1.0, 0.0]), lay.tags.get(33922, [0.0] * 6)
        nodata = float(lay.tags[42113]) if 42113 in lay.tags else None
        fs, inner = opened(partition.path)
        with fs.open_input_file(inner) as f:
            for n in partition.numbers:
                px = lay.strip(n, f.read_at(lay.tags[279][n], lay.tags[273][n]))
                yy, xx = np.indices(px.shape[1:])
                yy, xx = yy.ravel() + n % per_band * lay.rows, xx.ravel()
                for i, band in enumerate(px):
                    number = n // per_band if lay.apart else i
                    for k in range(0, len(yy), BATCH):
                        y, x, v = yy[k : k + BATCH], xx[k : k + BATCH], band.ravel()[k : k + BATCH]
                        missing = np.isnan(v) | (v == nodata if nodata is not None else False)
                        lon, lat = tie[3] + (x + 0.5 - tie[0]) * scale[0], tie[4] - (y + 0.5 - tie[1]) * scale[1]
                        columns = [pa.array([partition.path] * len(v)), pa.array(np.full(len(v), number, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(lon), pa.array(lat), pa.array(v, mask=missing)]
                        yield pa.RecordBatch.from_arrays(columns, names=["raster_id", "band", "y", "x", "lon", "lat", "v"])


class GeoTiff(DataSource):
    """Format meristem_geotiff: pixels of a GeoTIFF file or of a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "meristem_geotiff"

    def schema(self) -> str:
        return "raster_id string, band int, y int, x int, lon double, lat double, v double"

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"])


@dataclass
class Frame(InputPartition):
    path: str
    number: int


def frame_batches(frame: Frame) -> Iterator[pa.RecordBatch]:
    fs, inner = opened(frame.path)
    with fs.open_input_file(inner) as f:
        px = decode_image(f.read())
    rows = max(1, BATCH // max(1, px.shape[1]))
    for y in range(0, len(px), rows):
        part = px[y : y + rows]
        yy, xx = (i.ravel() for i in np.indices(part.shape[:2]))
        columns = [pa.array([frame.path] * len(yy)), pa.array(np.full(len(yy), frame.number, np.int32)), pa.array((yy + y).astype(np.int32)), pa.array(xx.astype(np.int32)), *[pa.array(np.ascontiguousarray(part[..., i]).ravel().astype(float)) for i in range(3)]]
        yield pa.RecordBatch.from_arrays(columns, names=["raster_id", "frame", "y", "x", "b", "g", "r"])


IMAGES = r"(?i)\.(png|ppm|pgm)$"


def _frames(path: str) -> list[str]:
    """A folder's images by the last number in their names, then by name."""
    number = lambda p: int((re.findall(r"\d+", p.rsplit("/", 1)[-1]) or ["0"])[-1])
    return sorted(listed(path, IMAGES), key=lambda p: (number(p), p))


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Frame]:
        return [Frame(p, i) for i, p in enumerate(_frames(self.path))]

    def read(self, partition: Frame) -> Iterator[pa.RecordBatch]:
        return frame_batches(partition)


class FrameStreamReader(DataSourceStreamReader):
    """Offsets count frames; files have to be added under rising numbers, and whole (by a rename)."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.given = path, most, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.given = min(len(_frames(self.path)), self.given + self.most)
        return {"frame": self.given}

    def partitions(self, start: dict, end: dict) -> list[Frame]:
        self.given = max(self.given, end["frame"])
        found = _frames(self.path)
        return [Frame(found[i], i) for i in range(start["frame"], end["frame"])]

    def read(self, partition: Frame) -> Iterator[pa.RecordBatch]:
        return frame_batches(partition)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    """Format meristem_frames: a folder's numbered images, as a table or, while a camera fills the folder, as a stream of at most framesPerTrigger frames a batch."""

    @classmethod
    def name(cls) -> str:
        return "meristem_frames"

    def schema(self) -> str:
        return "raster_id string, frame int, y int, x int, b double, g double, r double"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema) -> FrameStreamReader:  # noqa: N802
        return FrameStreamReader(self.options["path"], int(self.options.get("framesPerTrigger", 1 << 30)))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, with filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    spark.dataSource.register(Frames)


def geotiff(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("meristem_geotiff").option("path", path).load()


def frames(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("meristem_frames").option("path", path).load()


def frame_stream(spark: SparkSession, path: str, per_trigger: int = 1 << 30) -> DataFrame:
    register(spark)
    return spark.readStream.format("meristem_frames").option("path", path).option("framesPerTrigger", str(per_trigger)).load()
