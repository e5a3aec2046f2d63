"""Rasters made from relational tables, for queries and tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .header import Header
from .raster import Raster, RasterStack


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(pixels: DataFrame, width: int, key: DataFrame) -> Raster:
    height = (key.agg(F.max("y")).first()[0] or 0) + 1  # one row
    return Raster.of(pixels, Header(width, height, (0.0, 1.0, 0.0, float(height), 0.0, -1.0)))


def orders(spark: SparkSession, sf_dir: str) -> Raster:
    """50 columns; total price and customer key."""
    t = _table(spark, sf_dir, "orders")
    y, x = F.floor(F.col("o_orderkey") / 50).cast("int"), (F.col("o_orderkey") % 50).cast("int")
    return _sized(t.select(y.alias("y"), x.alias("x"), F.col("o_totalprice").alias("b1"), F.col("o_custkey").cast("double").alias("b2")), 50, t.select(y.alias("y")))


def parts(spark: SparkSession, sf_dir: str) -> Raster:
    """20 columns; retail price and size."""
    t = _table(spark, sf_dir, "part")
    y, x = F.floor(F.col("p_partkey") / 20).cast("int"), (F.col("p_partkey") % 20).cast("int")
    return _sized(t.select(y.alias("y"), x.alias("x"), F.col("p_retailprice").alias("b1"), F.col("p_size").cast("double").alias("b2")), 20, t.select(y.alias("y")))


def embeddings(spark: SparkSession, sf_dir: str) -> Raster:
    """64 columns; vector components."""
    t = _table(spark, sf_dir, "embeddings")
    return _sized(t.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "b1")), 64, t.select(F.col("vec_id").cast("int").alias("y")))


def events(spark: SparkSession, sf_dir: str) -> RasterStack:
    """Scenes of 20 columns, five full ones; event values. Where their number is no multiple of five, the last events are a sixth scene's first pixels."""
    t = _table(spark, sf_dir, "events")
    total = int(t.count())
    n = max(total // 5, 1)
    p = F.col("event_id") % n
    height = (n - 1) // 20 + 1
    header = Header(20, height, (0.0, 1.0, 0.0, float(height), 0.0, -1.0))
    cells = t.select(F.floor(F.col("event_id") / n).cast("int").alias("scene"), F.floor(p / 20).cast("int").alias("y"), (p % 20).cast("int").alias("x"), F.col("value").cast("double").alias("b1"))
    return RasterStack.of(cells, -(-total // n), header)


#: Polygons as fractions of width and height (halves of halves, so that pixel places are exact).
BOX = [[(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]]
TRIANGLE = [[(0.125, 0.875), (0.5, 0.125), (0.875, 0.875), (0.125, 0.875)]]
CONCAVE = [[(0.125, 0.125), (0.375, 0.125), (0.375, 0.625), (0.625, 0.625), (0.625, 0.125), (0.875, 0.125), (0.875, 0.875), (0.125, 0.875), (0.125, 0.125)]]
MULTI = BOX + [[(0.8125, 0.0), (1.0, 0.0), (1.0, 0.1875), (0.8125, 0.1875), (0.8125, 0.0)]]
OVERLAP = [[(0.125, 0.125), (0.625, 0.125), (0.625, 0.625), (0.125, 0.625), (0.125, 0.125)], [(0.375, 0.375), (0.875, 0.375), (0.875, 0.875), (0.375, 0.875), (0.375, 0.375)]]
QUADRANTS = [[(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.5, 0.5)]]
OUTSIDE = BOX + [[(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0), (2.0, 2.0)]]


def geojson(rings: list, header: Header, kind: str = "MultiPolygon") -> str:
    """Polygons in fractions of the raster as GeoJSON in its own coordinates."""
    shapes = [[[list(header.to_geo(fx * header.width, fy * header.height)) for fx, fy in ring]] for ring in rings]
    if kind == "GeometryCollection":
        return json.dumps({"type": kind, "geometries": [{"type": "Polygon", "coordinates": s} for s in shapes]})
    return json.dumps({"type": "Polygon", "coordinates": shapes[0]} if len(shapes) == 1 else {"type": "MultiPolygon", "coordinates": shapes})
