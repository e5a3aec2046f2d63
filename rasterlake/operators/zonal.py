"""Zonal statistics: pixels grouped by the polygon they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.header import Header
from . import vector

STATS = ("count", "sum", "min", "max", "mean", "std_dev")


def zonal_stats(pixels: DataFrame, header: Header, geojson: str, stats: tuple[str, ...] = (), band: int = 1, holes: bool = False) -> DataFrame:
    """One row a zone (ids from 1; of overlapping zones the last has the pixel); empty zones have count 0 and null statistics."""
    if not 1 <= band <= header.bands:
        raise ValueError(f"band {band} is not among the {header.bands} bands")
    wanted = [{"std": "std_dev"}.get(s, s) for s in stats] or list(STATS)
    if unknown := set(wanted) - set(STATS):
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    spark = pixels.sparkSession
    shapes = vector.polygons(geojson, collections=True)
    zones = spark.createDataFrame([(k,) for k in range(1, len(shapes) + 1)], "zone_id int")
    cover = vector.cover(spark, shapes, header, holes)
    value = pixels.select("y", "x", F.col(f"b{band}").alias("v"))
    if shapes:  # rows and columns of the scan that no zone reaches are not read
        points = [header.to_pixel(*p) for rings in shapes for p in rings[0]]
        (x0, y0), (x1, y1) = (tuple(f(c) for c in zip(*points)) for f in (min, max))
        value = value.where(F.col("y").between(int(max(y0, 0)), int(min(y1, header.height))) & F.col("x").between(int(max(x0, 0)), int(min(max(x1, 0), header.width))))
    hits = vector.joined(value, cover, header, "inner")
    found = hits.groupBy(F.col("zone").alias("zone_id")).agg(
        F.count("v").alias("count"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_dev")
    )
    # a row a zone at most, and the zones came from the driver
    out = zones.join(F.broadcast(found) if len(shapes) <= vector.SPANS else found, "zone_id", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).withColumn("sum", F.coalesce("sum", F.lit(0.0)))
    return out.select("zone_id", *wanted)
