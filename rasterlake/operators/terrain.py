"""Terrain derivatives from 3 x 3 neighbourhoods, by numpy kernels over blocks with halos."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame

from ..plans.header import Header
from .blocks import BLOCK, Source, Tiling, mapped
from .focal import reduced

METRICS = ("slope", "aspect", "hillshade", "tri", "tpi", "roughness", "prof_curv", "plan_curv", "total_curv")
UNITS = ("degrees", "radians", "percent")
METHODS = ("horn", "zevenbergen")
FLAT = -9999.0


def _metric(name: str, z: dict[int, np.ndarray], cx: float, cy: float, unit: str, azimuth: float, altitude: float, method: str) -> np.ndarray:
    others = [z[k] for k in (1, 2, 3, 4, 6, 7, 8, 9)]
    if name == "tri":
        return np.sqrt(sum((v - z[5]) * (v - z[5]) for v in others))
    if name == "tpi":
        return z[5] - sum(others) / 8
    if name == "roughness":
        return reduce(np.maximum, z.values()) - reduce(np.minimum, z.values())
    if name in ("slope", "aspect", "hillshade"):
        if method == "zevenbergen":
            p, q = (z[6] - z[4]) / (2 * cx), (z[8] - z[2]) / (2 * cy)
        else:
            p = ((z[3] + 2 * z[6] + z[9]) - (z[1] + 2 * z[4] + z[7])) / (8 * cx)
            q = ((z[7] + 2 * z[8] + z[9]) - (z[1] + 2 * z[2] + z[3])) / (8 * cy)
        rise = np.sqrt(p * p + q * q)
        if name == "slope":
            return {"degrees": lambda: np.degrees(np.arctan(rise)), "radians": lambda: np.arctan(rise), "percent": lambda: 100 * rise}[unit]()
        angle = np.arctan2(-q, p)
        angle = np.where(angle < 0, angle + 2 * math.pi, angle)
        if name == "aspect":
            bearing = 90 - np.degrees(angle)
            bearing = np.where(bearing < 0, bearing + 360, bearing)
            return np.where(np.arctan(rise) < 1e-6, FLAT, bearing)
        zenith, az, slope = math.pi / 2 - math.radians(altitude), math.radians(azimuth), np.arctan(rise)
        return np.maximum(0.0, 255 * (math.cos(zenith) * np.cos(slope) + math.sin(zenith) * np.sin(slope) * np.cos(az - angle)))
    a = ((z[1] + z[3] + z[4] + z[6] + z[7] + z[9]) / 2 - (z[2] + z[5] + z[8])) / (3 * cx * cx)
    c = ((z[1] + z[2] + z[3] + z[7] + z[8] + z[9]) / 2 - (z[4] + z[5] + z[6])) / (3 * cy * cy)
    if name == "total_curv":
        return 2 * (a + c)
    b = (-z[1] + z[3] + z[7] - z[9]) / (4 * cx * cy)
    d = (-z[1] - z[4] - z[7] + z[3] + z[6] + z[9]) / (6 * cx)
    e = (z[7] + z[8] + z[9] - z[1] - z[2] - z[3]) / (6 * cy)
    g = d * d + e * e
    steep = np.where(g > 1e-10, g, 1.0)
    if name == "prof_curv":
        out = -2 * (a * d * d + c * e * e + b * d * e) / (steep * steep)
    else:
        out = -2 * (a * e * e - b * d * e + c * d * d) / steep
    return np.where(g <= 1e-10, 0.0, out)


def terrain(pixels: DataFrame | Source, header: Header, metrics: tuple[str, ...] = ("slope",), unit: str = "degrees", sun_azimuth: float = 315.0, sun_altitude: float = 45.0, method: str = "horn", block: int = BLOCK) -> DataFrame:
    """One band a metric, in the order asked for. The edge repeats. A metric is null where any of its nine pixels is."""
    for value, known in ((unit, UNITS), (method, METHODS)):
        if value not in known:
            raise ValueError(f"unknown {value!r}")
    if unknown := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"unknown metrics {unknown}")
    cx, cy = header.cell_size()
    tiling = Tiling.of(header, 1, block)

    def kernel(block, grid):
        padded = tiling.padded(block, grid[0])
        h, w = padded.shape
        z = {k + 1: padded[k // 3 : h - 2 + k // 3, k % 3 : w - 2 + k % 3] for k in range(9)}
        gap = np.isnan(padded)
        out = [_metric(m, z, cx, cy, unit, sun_azimuth, sun_altitude, method) for m in metrics]
        if gap.any():
            gap = reduced(gap, np.ones((3, 3), bool), np.logical_or)
            out = [np.where(gap, np.nan, v) for v in out]
        return out

    return mapped(pixels if isinstance(pixels, Source) else pixels.select("y", "x", "b1"), tiling, kernel, len(metrics))
