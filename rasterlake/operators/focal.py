"""Focal statistics over moving windows (square or circle), by numpy kernels over blocks with halos."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..plans.header import Header
from .blocks import BLOCK, Source, Tiling, mapped

STATS = ("mean", "sum", "min", "max", "std", "variance", "median", "range")
SHAPES = ("square", "circle")
#: Values that are sorted at once for medians.
SORTED = 1 << 19


def reach(radius: int, shape: str) -> np.ndarray:
    """Which places of the square around a pixel belong to its window."""
    d = np.arange(-radius, radius + 1)
    return np.ones((2 * radius + 1,) * 2, bool) if shape == "square" else d[:, None] ** 2 + d[None, :] ** 2 <= radius * radius


def along(a: np.ndarray, size: int, axis: int, op) -> np.ndarray:
    """``op`` over ``size`` neighbours along an axis, by doubling."""
    a = np.moveaxis(a, axis, 0)
    n = len(a) - size + 1
    out, power, span, at = None, a, 1, 0
    while True:
        if size & span:
            part = power[at : at + n]
            out = part if out is None else op(out, part)
            at += span
        if 2 * span > size:
            return np.moveaxis(out, 0, axis)
        power, span = op(power[:-span], power[span:]), 2 * span


def shifts(padded: np.ndarray, window: np.ndarray):
    """The padded grid as each place of the window sees it."""
    h, w = (n - len(window) + 1 for n in padded.shape)
    for dy, dx in zip(*np.nonzero(window)):
        yield padded[dy : dy + h, dx : dx + w]


def reduced(padded: np.ndarray, window: np.ndarray, op) -> np.ndarray:
    """``op`` over each window; row by row and column by column where it is a square."""
    if window.all():
        return along(along(padded, len(window), 1, op), len(window), 0, op)
    out = None
    for part in shifts(padded, window):
        out = part.copy() if out is None else op(out, part, out=out)
    return out


def median(padded: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The lower median of each window's values; nulls are sorted behind them and not counted."""
    k = len(window)
    views = np.lib.stride_tricks.sliding_window_view(padded, (k, k))
    out = np.empty(views.shape[:2])
    places, gaps = np.flatnonzero(window), np.isnan(padded).any()
    step = max(1, SORTED // (views.shape[1] * len(places)))
    for at in range(0, len(out), step):
        some = views[at : at + step].reshape(-1, k * k)
        some = np.sort(some if len(places) == k * k else some[:, places], axis=1)
        if gaps:
            n = len(places) - np.isnan(some).sum(axis=1)
            got = np.where(n > 0, np.take_along_axis(some, np.maximum((n - 1) // 2, 0)[:, None], axis=1)[:, 0], np.nan)
        else:
            got = some[:, (len(places) - 1) // 2]
        out[at : at + step] = got.reshape(-1, views.shape[1])
    return out


def statistic(padded: np.ndarray, window: np.ndarray, stat: str) -> np.ndarray:
    """A statistic of the values (without nulls) in each pixel's window; NaN where there are none. Sample variance, 0 of one value."""
    if stat == "median":
        return median(padded, window)
    empty = np.isnan(padded)
    gaps = empty.any()
    n = reduced((~empty).astype(float), window, np.add) if gaps else float(window.sum())
    if stat in ("min", "max", "range"):
        low = reduced(np.where(empty, np.inf, padded) if gaps else padded, window, np.minimum) if stat != "max" else None
        high = reduced(np.where(empty, -np.inf, padded) if gaps else padded, window, np.maximum) if stat != "min" else None
        out = low if stat == "min" else high if stat == "max" else high - low
    else:
        out = reduced(np.where(empty, 0.0, padded) if gaps else padded, window, np.add)
        if stat != "sum":
            out = out / (np.maximum(n, 1) if gaps else n)
        if stat in ("std", "variance"):
            squares, step = np.zeros_like(out), np.empty_like(out)
            for part in shifts(padded, window):
                np.subtract(part, out, out=step)
                np.multiply(step, step, out=step)
                np.add(squares, np.nan_to_num(step, copy=False) if gaps else step, out=squares)
            out = np.where(n > 1, squares / np.maximum(n - 1, 1), 0.0)
            out = np.sqrt(out) if stat == "std" else out
    return np.where(n > 0, out, np.nan) if gaps else out


def focal(pixels: DataFrame | Source, header: Header, stat: str = "mean", radius: int = 1, shape: str = "square", clamp_border: bool = True, block: int = BLOCK) -> DataFrame:
    """``b1`` of each pixel's window of the first band; the edge repeats, or (``clamp_border=False``) windows end at it.

    Null pixels are left out of the windows; a window without values is null."""
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}")
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}")
    if radius < 1:
        raise ValueError("the radius must be 1 or more")
    tiling, window = Tiling.of(header, radius, block), reach(radius, shape)

    def kernel(block, grid):
        return [statistic(tiling.padded(block, grid[0], clamp_border), window, stat)]

    return mapped(pixels if isinstance(pixels, Source) else pixels.select("y", "x", "b1"), tiling, kernel, 1)
