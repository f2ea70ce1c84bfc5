"""Registration of queries and the rasters and signals that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to some digits, as the SQL has them; a sum that rounds to -0.0 is 0.0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 grey raster of whole values 0..255. Rasters are dealt before each becomes 64 rows, so that its pixels lie together and no task holds more than its share."""
    e = dealt(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster_id"), "embedding"), "raster_id").select("raster_id", F.posexplode("embedding").alias("p", "e"))
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 256 * F.col("e").cast("double")).cast("double")))
    return e.select("raster_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), v.alias("v"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey rasters of 64 x 64, each of 64 embeddings' rasters in rows of eight."""
    n = F.col("raster_id") % 64
    return gray(spark, sf_dir).select(F.floor(F.col("raster_id") / 64).alias("raster_id"), (F.floor(n / 8) * 8 + F.col("y")).cast("int").alias("y"), ((n % 8) * 8 + F.col("x")).cast("int").alias("x"), "v")


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return gray(spark, sf_dir).select("raster_id", "y", "x", v.alias("b"), ((v * 3) % 256).alias("g"), ((v * 7 + 13) % 256).alias("r"))


def mask(spark: SparkSession, sf_dir: str, level: float = 140) -> DataFrame:
    return gray(spark, sf_dir).withColumn("v", F.when(F.col("v") > level, 255.0).otherwise(0.0))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of equal vec_id modulo 20 as one camera's frames."""
    return gray(spark, sf_dir).select((F.col("raster_id") % 20).alias("raster_id"), F.floor(F.col("raster_id") / 20).alias("tick"), "y", "x", "v")


GRAY = "gray as (select vec_id as raster_id, (p // 8)::int as y, (p % 8)::int as x, greatest(0, least(255, floor(128 + 256 * embedding[p + 1]::double)))::double as v from embeddings, (select unnest(range(64)) as p))"
COLOUR = GRAY + ", colour as (select raster_id, y, x, v as b, (v * 3) % 256 as g, (v * 7 + 13) % 256 as r from gray)"
MASK = GRAY + ", mask as (select raster_id, y, x, case when v > 140 then 255.0::double else 0.0 end as v from gray)"
FRAMES = GRAY + ", frames as (select raster_id % 20 as raster_id, raster_id // 20 as tick, y, x, v from gray)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
