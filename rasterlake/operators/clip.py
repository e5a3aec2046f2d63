"""Polygon clip: pixels outside become zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.header import Header
from . import vector


def clip(pixels: DataFrame, header: Header, geojson: str, holes: bool = False) -> DataFrame:
    """Bands inside the union of the polygons, zero outside. Pixels stay where they are: the polygons' spans are broadcast to them."""
    found = vector.cover(pixels.sparkSession, vector.polygons(geojson), header, holes, one_zone=True)
    bands = [c for c in pixels.columns if c not in ("y", "x")]
    return vector.joined(pixels, found, header, "left").select("y", "x", *[F.when(F.col("zone").isNotNull(), F.col(b)).otherwise(F.lit(0.0)).alias(b) for b in bands])
