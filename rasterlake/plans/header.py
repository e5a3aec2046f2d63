"""What is known of a raster without touching its pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from ..functions.crs import geographic


@dataclass(frozen=True)
class Header:
    """Size, affine transform (x = g0 + col g1 + row g2, y = g3 + col g4 + row g5), reference system and bands."""

    width: int
    height: int
    transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    crs: str = ""
    bands: int = 1
    nodata: float | None = None

    def with_(self, **changes) -> Header:
        return replace(self, **changes)

    def to_geo(self, col, row):
        g = self.transform
        return g[0] + col * g[1] + row * g[2], g[3] + col * g[4] + row * g[5]

    def inverse(self) -> tuple[float, ...]:
        """Coefficients of col = i0 + X i1 + Y i2, row = i3 + X i4 + Y i5."""
        g = self.transform
        det = g[1] * g[5] - g[2] * g[4]
        if det == 0:
            raise ValueError("the raster's transform cannot be inverted")
        a, b, d, e = g[5] / det, -g[2] / det, -g[4] / det, g[1] / det
        return (-(g[0] * a + g[3] * b), a, b, -(g[0] * d + g[3] * e), d, e)

    def to_pixel(self, x, y):
        g = self.transform
        if g[2] == 0 and g[4] == 0:  # no rotation: plain steps, without rounding of an inverse
            return (x - g[0]) / g[1], (y - g[3]) / g[5]
        i = self.inverse()
        return i[0] + x * i[1] + y * i[2], i[3] + x * i[4] + y * i[5]

    def cell_size(self) -> tuple[float, float]:
        """Ground size of a pixel; degrees become metres at the centre's latitude."""
        g = self.transform
        x, y = math.hypot(g[1], g[4]), math.hypot(g[2], g[5])
        if geographic(self.crs):
            lat = math.radians(g[3] + self.height / 2 * g[5])
            return x * math.cos(lat) * 111320.0, y * 111320.0
        return x, y

    def info(self) -> dict:
        return {"width": self.width, "height": self.height, "geotransform": list(self.transform), "crs": self.crs}
