"""Polygons as spans: for each row of a raster, the inclusive column ranges inside."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.header import Header

SPAN = "zone int, y int, c0 int, c1 int"
#: Crossings of rows by edges up to which spans are made at once and broadcast (16 bytes each: 32 MB at most).
SPANS = 2_000_000
#: Columns that a join's key stands for, where rows have many spans; rows that a task sweeps at a time.
STEP = 256
BAND = 64


def polygons(geojson: str, collections: bool = False) -> list[list[list[tuple[float, float]]]]:
    """Rings of each polygon (outer first) of a Polygon or MultiPolygon; with ``collections`` of a GeometryCollection's polygons too."""
    try:
        shape = json.loads(geojson)
        kind = shape["type"]
        if kind == "Feature":
            shape = shape["geometry"]
            kind = shape["type"]
        if kind == "Polygon":
            found = [shape["coordinates"]]
        elif kind == "MultiPolygon":
            found = shape["coordinates"]
        elif kind == "GeometryCollection" and collections:
            found = [g["coordinates"] for g in shape["geometries"] if g["type"] == "Polygon"]
        else:
            found = []
        return [[[(float(p[0]), float(p[1])) for p in ring] for ring in rings] for rings in found]
    except (ValueError, KeyError, TypeError, IndexError) as e:
        raise ValueError(f"not a GeoJSON geometry: {e}") from e


def edge_rows(shapes: list, header: Header, holes: bool = False) -> np.ndarray:
    """The polygons' edges in pixel space (``zone, x0, y0, x1, y1``), zones counted from 1, level ones left out. Only outer rings, unless
    ``holes``. Corners are taken to a millionth of a pixel, so that those on pixels' edges stay there after coordinate transforms."""
    rows = []
    for zone, rings in enumerate(shapes, 1):
        for ring in rings if holes else rings[:1]:
            points = [tuple(round(float(c), 6) for c in header.to_pixel(x, y)) for x, y in ring]
            rows += [(zone, x0, y0, x1, y1) for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]) if y0 != y1]
    return np.array(rows, float).reshape(-1, 5)


def _rows_of(edges: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """First row, and number of rows, that each edge crosses."""
    low, high = np.minimum(edges[:, 2], edges[:, 4]), np.maximum(edges[:, 2], edges[:, 4])
    first = np.clip(np.ceil(low), 0, height).astype(np.int64)
    return first, np.maximum(np.clip(np.ceil(high), 0, height).astype(np.int64) - first, 0)


def spans_of(edges: np.ndarray, header: Header) -> np.ndarray:
    """``zone, y, c0, c1``: even-odd pairs of each row's crossings, ends inclusive and truncated, cut to the raster."""
    first, n = _rows_of(edges, header.height)
    if not n.sum():
        return np.zeros((0, 4), np.int64)
    e = np.repeat(np.arange(len(edges)), n)
    ys = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + first[e]
    zone, x0, y0, x1, y1 = edges[e].T
    xs = x0 + (ys - y0) * (x1 - x0) / (y1 - y0)
    order = np.lexsort((xs, ys, zone))
    zone, ys, xs = zone[order].astype(np.int64), ys[order], xs[order]
    group = np.flatnonzero(np.concatenate(([True], (np.diff(zone) != 0) | (np.diff(ys) != 0))))
    place = np.arange(len(xs)) - np.repeat(group, np.diff(np.append(group, len(xs))))
    left = np.flatnonzero((place % 2 == 0) & np.append((np.diff(zone) == 0) & (np.diff(ys) == 0), False))
    a, b = xs[left], xs[left + 1]
    # truncation toward zero, so that a start just left of the raster is column 0
    c0, c1 = np.maximum(np.trunc(a), 0).astype(np.int64), np.minimum(np.trunc(b), header.width - 1).astype(np.int64)
    keep = (b >= 0) & (c0 <= c1)
    return np.stack([zone[left], ys[left], c0, c1], axis=1)[keep]


def swept(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans of the same cover: each place belongs to the largest zone over it. Rows without overlaps stay as they are;
    in the others a sweep from left to right keeps the zones that are open, largest first."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1]))]
    same = np.diff(spans[:, 1]) == 0
    crossed = np.flatnonzero(same & (spans[1:, 2] <= spans[:-1, 3]))
    if not len(crossed):
        return spans
    odd = np.isin(spans[:, 1], np.unique(spans[crossed, 1]))
    some = spans[odd]
    cuts = np.flatnonzero(np.diff(some[:, 1])) + 1
    out = [spans[~odd]]
    for row in np.split(some, cuts):
        out.append(_swept_row(row.tolist()))
    return np.concatenate(out)


def _swept_row(row: list[list[int]]) -> np.ndarray:
    """One row's spans, in order of their starts."""
    y = row[0][1]
    edges = sorted({s[2] for s in row} | {s[3] + 1 for s in row})
    open_: list[tuple[int, int]] = []  # (-zone, last column)
    out: list[list[int]] = []
    k = 0
    for at, to in zip(edges, edges[1:]):
        while k < len(row) and row[k][2] <= at:
            heapq.heappush(open_, (-row[k][0], row[k][3]))
            k += 1
        while open_ and open_[0][1] < at:
            heapq.heappop(open_)
        if open_:
            zone = -open_[0][0]
            if out and out[-1][0] == zone and out[-1][3] == at - 1:
                out[-1][3] = to - 1
            else:
                out.append([zone, y, at, to - 1])
    return np.array(out, np.int64).reshape(-1, 4)


@dataclass(frozen=True)
class Cover:
    """Disjoint spans ``zone, y, c0, c1``, how many columns a join's key stands for, and whether they are few enough to broadcast."""

    spans: DataFrame
    step: int
    few: bool


def cover(spark: SparkSession, shapes: list, header: Header, holes: bool = False, one_zone: bool = False) -> Cover:
    """Disjoint spans of polygons. Up to ``SPANS`` crossings (known from the edges alone) they are made here and broadcast; beyond, by
    tasks for bands of rows, from the edges alone, and the join is left to shuffle."""
    edges = edge_rows(shapes, header, holes)
    crossings = int(_rows_of(edges, header.height)[1].sum())
    if crossings <= SPANS:
        spans = swept(_united(spans_of(edges, header), one_zone))
        rows = len(np.unique(spans[:, 1]))
        step = header.width if len(spans) <= 1.5 * max(rows, 1) else STEP
        table = pa.table({name: pa.array(spans[:, k].astype(np.int32)) for k, name in enumerate(("zone", "y", "c0", "c1"))})
        return Cover(spark.createDataFrame(table, SPAN), step, True)
    held = spark.sparkContext.broadcast(edges)
    height = header.height

    def run(batches):
        low, high = np.minimum(held.value[:, 2], held.value[:, 4]), np.maximum(held.value[:, 2], held.value[:, 4])
        for batch in batches:
            for band in batch.column(0).to_pylist():
                a, b = band * BAND, min((band + 1) * BAND, height)
                some = held.value[(high >= a) & (low <= b)]
                found = spans_of(some, header)
                found = swept(_united(found[(found[:, 1] >= a) & (found[:, 1] < b)], one_zone)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], names=["zone", "y", "c0", "c1"])

    bands = -(-height // BAND)
    return Cover(spark.range(0, bands, 1, min(bands, 4096)).mapInArrow(run, SPAN), STEP, False)


def _united(spans: np.ndarray, one_zone: bool) -> np.ndarray:
    if one_zone and len(spans):
        spans = spans.copy()
        spans[:, 0] = 1
    return spans


def joined(pixels: DataFrame, found: Cover, header: Header, how: str) -> DataFrame:
    """Pixels with the zone of the span that they lie in: a hash join by row (and by ``step`` columns), the span as a residual."""
    across = -(-header.width // found.step)
    key, parts = F.col("y").cast("long"), found.spans.withColumn("_key", F.col("y").cast("long"))
    if across > 1:
        part = lambda c: F.floor(F.col(c) / found.step).cast("int")
        parts = found.spans.withColumn("_part", F.explode(F.sequence(part("c0"), part("c1")))).withColumn("_key", F.col("y").cast("long") * across + F.col("_part"))
        bits = found.step.bit_length() - 1
        key = key * across + (F.shiftright("x", bits) if found.step == 1 << bits else part("x"))
    parts = parts.select("zone", "c0", "c1", "_key")
    return pixels.join(F.broadcast(parts) if found.few else parts, (key == F.col("_key")) & F.col("x").between(F.col("c0"), F.col("c1")), how)
