"""Grey-level co-occurrence texture: 18 features of moving windows, by a numpy kernel over blocks with halos."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.header import Header
from .blocks import Tiling, mapped
from .focal import SORTED, along

#: Features in their default order.
FEATURES = (
    "asm", "contrast", "correlation", "variance", "homogeneity", "sum_average", "sum_variance", "sum_entropy", "entropy", "diff_variance", "diff_entropy", "dissimilarity",
    "autocorrelation", "max_probability", "cluster_shade", "cluster_prominence", "imc1", "imc2",
)
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1))
TINY = 1e-10
#: Matrix cells that are worked on at once.
MATRICES = 1 << 20


def _plogp(p: np.ndarray) -> np.ndarray:
    return -np.where(p > TINY, p * np.log2(np.maximum(p, TINY)), 0.0)


class Pairs:
    """Grey-level pairs of all windows of a block in one direction, and the features of their symmetric, normalised matrices.

    Features that are sums over pairs come from sums over windows of what each pair gives. Features of a matrix' cells come from each
    window's pairs in order, run by run, so that no matrix is made; only the information measures need whole matrices.
    """

    def __init__(self, levels_of: np.ndarray, radius: int, levels: int, dx: int, dy: int):
        """``levels_of``: a block's levels with a halo of ``radius + 1``, -1 for null. Pairs with a null are left out."""
        h, w = levels_of.shape
        self.a = levels_of[1 : h - 1, 1 : w - 1].astype(np.int64)
        self.b = levels_of[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx].astype(np.int64)
        self.ok = (self.a >= 0) & (self.b >= 0)
        self.size, self.levels = 2 * radius + 1, levels
        self.n = self._sum(self.ok.astype(np.int64))
        self.kept: dict[str, np.ndarray] = {}

    def _sum(self, per_pair: np.ndarray) -> np.ndarray:
        return along(along(per_pair, self.size, 1, np.add), self.size, 0, np.add)

    def mean(self, name: str, make) -> np.ndarray:
        """The mean over each window's pairs of ``make(a, b)``; 0 without pairs."""
        if name not in self.kept:
            self.kept[name] = self._sum(np.where(self.ok, make(self.a, self.b), 0)) / np.maximum(self.n, 1)
        return self.kept[name]

    def runs(self, make, feature) -> np.ndarray:
        """For each window the sum (or, by ``feature.at``, another reduction) of ``feature(code, count)`` over its different codes."""
        codes = np.where(self.ok, make(self.a, self.b), -1)
        views = np.lib.stride_tricks.sliding_window_view(codes, (self.size,) * 2)
        h, w = views.shape[:2]
        out = np.zeros(h * w)
        k = self.size * self.size
        step = max(1, SORTED // (w * k))
        for at in range(0, h, step):
            rows = np.sort(views[at : at + step].reshape(-1, k).astype(np.int32), axis=1)
            first = np.ones(rows.shape, bool)
            np.not_equal(rows[:, 1:], rows[:, :-1], out=first[:, 1:])
            starts = np.flatnonzero(first)
            code, count = rows.reshape(-1)[starts], np.diff(np.append(starts, rows.size))
            place = starts // k + at * w
            real = code >= 0
            feature(out, place[real], code[real], count[real] / np.maximum(self.n.reshape(-1)[place[real]], 1))
        return out.reshape(h, w)

    def _joint(self, per_cell, reduce=np.add) -> np.ndarray:
        """A reduction over a matrix' cells: of two levels, each cell and its mirror have half the pairs' share."""
        def take(out, place, code, share):
            mirrored = code // self.levels != code % self.levels
            v = per_cell(np.where(mirrored, share / 2, share))
            if reduce is np.add:
                out += np.bincount(place, np.where(mirrored, 2 * v, v), len(out))
            else:
                reduce.at(out, place, v)

        return self.runs(lambda a, b: np.minimum(a, b) * self.levels + np.maximum(a, b), take)

    def _entropy_of(self, make) -> np.ndarray:
        def take(out, place, code, share):
            out += np.bincount(place, _plogp(share), len(out))

        return self.runs(make, take)

    def _matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entropies of the matrices, of their marginals (the larger), and the two cross entropies of the information measures."""
        if "measures" not in self.kept:
            n = self.levels
            code = np.where(self.ok, self.a * n + self.b, n * n)
            views = np.lib.stride_tricks.sliding_window_view(code, (self.size,) * 2)
            h, w = views.shape[:2]
            out = np.zeros((4, h * w))
            step = max(1, MATRICES // (n * n + 1))
            flat = views.reshape(h * w, -1) if h * w * self.size**2 <= SORTED else None
            for at in range(0, h * w, step):
                some = flat[at : at + step] if flat is not None else np.stack([views[k // w, k % w].reshape(-1) for k in range(at, min(at + step, h * w))])
                m = len(some)
                counts = np.bincount((np.arange(m)[:, None] * (n * n + 1) + some).ravel(), minlength=m * (n * n + 1)).reshape(m, -1)[:, :-1].reshape(m, n, n)
                p = (counts + counts.transpose(0, 2, 1)) / np.maximum(2 * counts.sum((1, 2), keepdims=True), 1)
                px = p.sum(2)
                product = px[:, :, None] * px[:, None, :]
                log = np.log2(product + TINY)
                out[:, at : at + m] = _plogp(p).sum((1, 2)), -(px * np.log2(px + TINY)).sum(1), -(p * log).sum((1, 2)), -(product * log).sum((1, 2))
            self.kept["measures"] = out.reshape(4, h, w)
        return self.kept["measures"]

    def feature(self, name: str) -> np.ndarray:
        """A feature of each window's matrix."""
        top, mean = self.levels - 1, self.mean
        if name in ("contrast", "diff_variance"):
            return mean("contrast", lambda a, b: (a - b) ** 2)
        if name == "homogeneity":
            return mean(name, lambda a, b: 1 / (1 + (a - b) ** 2.0))
        if name == "dissimilarity":
            return mean(name, lambda a, b: np.abs(a - b))
        if name == "autocorrelation":
            return mean(name, lambda a, b: a * b)
        if name == "sum_average":
            return mean(name, lambda a, b: a + b)
        if name in ("variance", "correlation"):
            # levels from the middle, so that squares stay small; both marginals are alike
            mu = mean("mu", lambda a, b: 2 * (a + b) - 2 * top) / 4
            spread = mean("square", lambda a, b: (2 * a - top) ** 2 + (2 * b - top) ** 2) / 8 - mu * mu
            if name == "variance":
                return spread
            spread = np.maximum(spread, TINY)
            return np.where(spread > 2 * TINY, (mean("product", lambda a, b: (2 * a - top) * (2 * b - top)) / 4 - mu * mu) / spread, 0.0)
        if name in ("sum_variance", "cluster_shade", "cluster_prominence"):
            m1, m2 = (mean(f"sum{k}", lambda a, b, k=k: (a + b - top) ** k) for k in (1, 2))
            if name == "sum_variance":
                return m2 - m1 * m1
            m3 = mean("sum3", lambda a, b: (a + b - top) ** 3)
            if name == "cluster_shade":
                return m3 - 3 * m1 * m2 + 2 * m1**3
            return mean("sum4", lambda a, b: (a + b - top) ** 4) - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1**4
        if name == "asm":
            return self._joint(np.square)
        if name == "entropy":
            return self._joint(_plogp)
        if name == "max_probability":
            return self._joint(lambda p: p, np.maximum)
        if name == "sum_entropy":
            return self._entropy_of(lambda a, b: a + b)
        if name == "diff_entropy":
            return self._entropy_of(lambda a, b: np.abs(a - b))
        hxy, hx, hxy1, hxy2 = self._matrices()
        if name == "imc1":
            return np.where(hx > TINY, (hxy - hxy1) / np.maximum(hx, TINY), 0.0)
        return np.sqrt(np.maximum(0.0, 1 - np.exp(-2 * (hxy2 - hxy))))


def texture(pixels: DataFrame, header: Header, features: tuple[str, ...] = (), window: int = 11, levels: int = 32, direction_mode: str = "average", log_scale: bool = False, val_min: float = 0, val_max: float = 0, block: int = 128) -> DataFrame:
    """One band a feature, in the order asked for (``separate``: all of them for each direction in turn). The edge repeats.

    Null pixels have no level: pairs with one are left out, and their own features are null, as are those of windows without pairs."""
    wanted = list(features) or list(FEATURES)
    if unknown := [f for f in wanted if f not in FEATURES]:
        raise ValueError(f"unknown features {unknown}")
    if direction_mode not in ("average", "separate"):
        raise ValueError(f"unknown direction mode {direction_mode!r}")
    if not 2 <= levels <= 256 or window < 1:
        raise ValueError("levels must be 2 to 256, windows 1 or wider")
    radius = (window + 1 - window % 2) // 2
    value = F.col("b1")
    if log_scale:
        value = F.when(value > 0, 10 * F.log10(F.when(value > 0, value))).when(value.isNotNull(), F.lit(-100.0))
    scaled = pixels.select("y", "x", value.alias("v"))
    if val_min == 0 and val_max == 0:
        low, high = scaled.agg(F.min("v"), F.max("v")).first()  # one row
        low, high = (0.0, 0.0) if low is None else (low, high)
    else:
        low, high = val_min, val_max
    span = high - low if high > low else 1.0
    per_direction = direction_mode == "separate"
    tiling = Tiling.of(header, radius + 1, block)

    def kernel(block, grid):
        v = tiling.padded(block, grid[0])
        gap = np.isnan(v)
        q = np.where(gap, -1, np.clip(np.where(gap, 0.0, v - low) / span * levels, 0, levels - 1).astype(np.int64))
        each = [Pairs(q, radius, levels, dx, dy) for dx, dy in DIRECTIONS]
        found = [[np.where(p.n > 0, p.feature(f), np.nan) for f in wanted] for p in each]
        # the mean of the directions that have pairs
        out = [v for vs in found for v in vs] if per_direction else [_mean(list(vs)) for vs in zip(*found)]
        own = gap[radius + 1 : -radius - 1, radius + 1 : -radius - 1]
        return [np.where(own, np.nan, v) for v in out]

    return mapped(scaled, tiling, kernel, len(wanted) * (4 if per_direction else 1))


def _mean(parts: list[np.ndarray]) -> np.ndarray:
    n = sum((~np.isnan(p)).astype(int) for p in parts)
    return np.where(n > 0, sum(np.nan_to_num(p) for p in parts) / np.maximum(n, 1), np.nan)
