"""Sources and sinks: shared tables written out and read back, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers as R
from ..sources import writers as W
from .base import GRAY, case, mosaic, table

#: A file holds a raster's whole rectangle, with 0 where the last raster has no pixels.
_MOSAIC = f"""with {GRAY}, part as (select raster_id // 64 as raster_id, (raster_id % 64 // 8 * 8 + y)::int as y, (raster_id % 8 * 8 + x)::int as x, v from gray),
  size as (select raster_id, max(y) as h, max(x) as w from part group by 1),
  place as (select raster_id, k // 64 as y, k % 64 as x from size, (select unnest(range(4096))::int as k) where k // 64 <= h and k % 64 <= w),
  mosaic as (select raster_id, y, x, coalesce(v, 0) as v from place left join part using (raster_id, y, x))"""


def _folder(spark) -> str:
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    return path.replace("file://", "", 1).replace("file:", "", 1)


_ORDERS = "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderkey) as first_key from orders group by 1"


def _summed(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first_key"))


@case("ml_csv_reader", _ORDERS)
def _csv(spark, d):
    """All orders as CSV, and back with types by their values."""
    path = _folder(spark)
    W.export(table(spark, d, "orders"), path)
    return _summed(R.read_csv(spark, path))


@case("df_export", _ORDERS)
def _export(spark, d):
    """All orders as JSON, and back."""
    path = _folder(spark)
    W.export(table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderkey"), path, "json")
    return _summed(spark.read.schema("o_orderstatus string, o_totalprice double, o_orderkey long").json(path))


def _number(df):
    return df.withColumn("raster_id", F.regexp_extract("raster_id", r"(\d+)\.\w+$", 1).cast("long"))


_PIXELS = f"{_MOSAIC} select raster_id, y, x, v from mosaic"


@case("output_save_frame", f"{_MOSAIC} select raster_id, count(*) as n from mosaic group by 1")
def _save(spark, d):
    """Rasters written as PNG files, and how many pixels the files hold."""
    path = _folder(spark)
    W.save_frames(W.encoded_frames(mosaic(spark, d)), path).count()
    return _number(R.read_images(spark, path)).groupBy("raster_id").agg(F.count("*").alias("n"))


@case("input_image", _PIXELS)
def _images(spark, d):
    path = _folder(spark)
    W.save_frames(W.encoded_frames(mosaic(spark, d)), path).count()
    return _number(R.read_images(spark, path)).select("raster_id", "y", "x", F.col("g").alias("v"))


@case("input_movie", f"{_MOSAIC} select raster_id as frame, y, avg(v) as v, (select count(distinct raster_id) from mosaic)::int as total_frames from mosaic group by 1, 2")
def _movie(spark, d):
    path = _folder(spark)
    W.save_frames(W.encoded_frames(mosaic(spark, d)), path).count()
    return R.read_frames(spark, path).groupBy(F.col("frame").cast("long").alias("frame"), "y", "total_frames").agg(F.avg("b").alias("v")).select("frame", "y", "v", "total_frames")


@case("geo_geotiff_reader", f"{_MOSAIC} select raster_id, y, x, v / 4 as v, x + 0.5::double as lon, -(y + 0.5::double) as lat from mosaic where y >= 20 and y < 37")
def _geotiff(spark, d):
    """A window of rasters written as GeoTIFF files in strips of 16 rows."""
    path = _folder(spark)
    W.save_frames(W.encoded_tiffs(mosaic(spark, d).withColumn("v", F.col("v") / 4)), path, "tiff", ".tif").count()
    return _number(R.read_geotiff(spark, path).where("y >= 20 and y < 37")).select("raster_id", "y", "x", "v", "lon", "lat")
