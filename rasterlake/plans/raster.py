"""Immutable rasters and stacks: a lazy DataFrame with its header."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import compile_expression
from ..operators import clip as clips
from ..operators import focal as focals
from ..operators import temporal as temporals
from ..operators import terrain as terrains
from ..operators import texture as textures
from ..operators import warp, zonal
from ..operators.blocks import Source
from ..sources import geotiff
from ..streaming.chunks import ChunkStream
from ..streaming.progress import progress
from .header import Header

MEMORY_LIMIT = 1 << 30


def _no_nan(pixels: DataFrame, *keys: str) -> DataFrame:
    bands = [c for c in pixels.columns if c not in ("y", "x", *keys)]
    return pixels.select(*keys, "y", "x", *[F.nullif(F.col(b).cast("double"), F.lit(float("nan"))).alias(b) for b in bands])


class Raster:
    """Pixels ``(y, x, b1, ..)``, one row for each place of the grid, and a header. Every operation gives a new raster.

    A raster of a file (``read`` gives pixels of some bands) reads the bands that the next operation needs, and no others."""

    def __init__(self, pixels: DataFrame | None, header: Header, read: Callable[[list[int]], DataFrame] | None = None, source: Callable[[list[int]], Source] | None = None):
        self._pixels, self._read, self._source = pixels, read, source
        self.header = header if pixels is None else header.with_(bands=len(pixels.columns) - 2)

    @property
    def pixels(self) -> DataFrame:
        if self._pixels is None:
            self._pixels = self.only(range(1, self.header.bands + 1))
        return self._pixels

    def only(self, bands: Iterable[int]) -> DataFrame:
        """Pixels of some bands, under their own names."""
        names = [f"b{k}" for k in bands]
        if self._pixels is not None:
            return self._pixels.select("y", "x", *names)
        return self._read([int(n[1:]) for n in names]).toDF("y", "x", *names)

    @classmethod
    def of(cls, pixels: DataFrame, header: Header) -> Raster:
        """A raster of any pixel table: bands become doubles, NaN becomes null."""
        return cls(_no_nan(pixels), header)

    @classmethod
    def open(cls, spark: SparkSession, path: str, bands: list[int] | None = None) -> Raster:
        """A file, of which no pixel is read yet; with ``bands`` a raster of those, in that order."""
        header = geotiff.header_of(path).header
        chosen = list(bands) if bands else list(range(1, header.bands + 1))
        some = lambda bands: [chosen[k - 1] for k in bands]
        return cls(None, header.with_(bands=len(chosen)), lambda bands: geotiff.read(spark, path, some(bands))[0], lambda bands: geotiff.source(spark, path, some(bands)))

    def _cells(self, bands: Iterable[int]) -> DataFrame | Source:
        """Some bands for an operation on blocks: of a file that is not read yet as pieces, else as pixels."""
        return self._source(list(bands)) if self._pixels is None and self._source else self.only(bands)

    def get_info(self) -> dict:
        return self.header.info()

    def _next(self, pixels: DataFrame, **changes) -> Raster:
        return Raster(pixels, self.header.with_(**changes))

    def algebra(self, expression: str) -> Raster:
        """One band from an expression over this raster's bands."""
        used: set[int] = set()

        def band(n: int):
            used.add(n)
            return F.col(f"b{n}")

        value = compile_expression(expression, self.header.bands, band)
        return self._next(self.only(sorted(used)).select("y", "x", value.cast("double").alias("b1")))

    def clip(self, geojson: str, holes: bool = False) -> Raster:
        return self._next(clips.clip(self.pixels, self.header, geojson, holes))

    def reproject(self, target_crs: str, res_x: float = 0, res_y: float = 0, resampling: str = "bilinear", nodata: float = -9999.0, extent: tuple[float, float, float, float] | None = None) -> Raster:
        """Pixels outside the source are null until a sink writes them as ``nodata``."""
        target = warp.target_header(self.header, target_crs, res_x, res_y, extent, nodata)
        return Raster(warp.reproject(self._cells(range(1, self.header.bands + 1)), self.header, target, resampling, fill=False), target)

    def focal(self, stat: str = "mean", radius: int = 1, shape: str = "square", clamp_border: bool = True) -> Raster:
        return self._next(focals.focal(self._cells([1]), self.header, stat, radius, shape, clamp_border))

    def terrain(self, metrics: list[str] | None = None, **options) -> Raster:
        return self._next(terrains.terrain(self._cells([1]), self.header, tuple(metrics or ("slope",)), **options))

    def texture(self, features: list[str] | None = None, **options) -> Raster:
        return self._next(textures.texture(self.only([1]), self.header, tuple(features or ()), **options))

    def zonal_stats(self, geojson: str, stats: list[str] | None = None, band: int = 1) -> DataFrame:
        pixels = self.only([band]) if 1 <= band <= self.header.bands else self.pixels
        return zonal.zonal_stats(pixels, self.header, geojson, tuple(stats or ()), band)

    def filled(self) -> DataFrame:
        """Pixels with nulls as the header's nodata, if it has one."""
        if self.header.nodata is None:
            return self.pixels
        return self.pixels.fillna(self.header.nodata)

    def iter_begin(self, rows: int | None = None, buffered: int = 4) -> ChunkStream:
        return ChunkStream(self.pixels, self.header, rows, buffered)

    def to_memory(self, limit: int = MEMORY_LIMIT, verbose: bool = False) -> np.ndarray:
        """Float32 array (rows, columns), or (bands, rows, columns); refused beyond ``limit`` bytes."""
        h = self.header
        need = 4 * h.width * h.height * h.bands
        if need > limit:
            raise MemoryError(f"the raster takes {need} bytes, over the limit of {limit}; iterate over chunks instead")
        out = np.empty((h.bands, h.height, h.width), np.float32)
        with progress(self.pixels.sparkSession, verbose):
            for c in self.iter_begin():
                data = c["data"] if h.bands > 1 else c["data"][None]
                out[:, c["y_offset"] : c["y_offset"] + c["height"]] = data
        return out if h.bands > 1 else out[0]

    def save_local(self, path: str, verbose: bool = False) -> None:
        with progress(self.pixels.sparkSession, verbose):
            geotiff.write(self.pixels, self.header, path)

    def save_s3(self, path: str, verbose: bool = False) -> None:
        if not geotiff.uri_of(path).startswith("s3://"):
            raise ValueError(f"not an S3 path: {path}")
        self.save_local(path, verbose)


class RasterStack:
    """Scenes of one grid. Steps before ``temporal`` apply to each scene.

    Scenes come one by one; or from files (``open``) or a table (``wide``) side by side, a column for each scene's band, so that no
    pixel has to be brought together; or (``of``) as one table with a ``scene`` number from 0 on, which is scanned once."""

    def __init__(self, scenes: list[Raster], steps: tuple[Callable[[Raster], Raster], ...] = ()):
        if not scenes:
            raise ValueError("a stack needs scenes")
        _same_grid([s.header for s in scenes])
        self.header, self.count, self.steps = scenes[0].header, len(scenes), steps
        self._scenes, self._rows, self._read = scenes, None, None

    @classmethod
    def _made(cls, header: Header, count: int, scenes=None, rows=None, read=None, steps=()) -> RasterStack:
        if count < 1:
            raise ValueError("a stack needs scenes")
        out = cls.__new__(cls)
        out.header, out.count, out._scenes, out._rows, out._read, out.steps = header, count, scenes, rows, read, steps
        return out

    @classmethod
    def open(cls, spark: SparkSession, paths: list[str]) -> RasterStack:
        """Files of one grid. Tasks read the same rows of all of them."""
        if not paths:
            raise ValueError("a stack needs scenes")
        headers = [geotiff.header_of(p).header for p in paths]
        _same_grid(headers)
        header = headers[0].with_(bands=min(h.bands for h in headers))
        return cls._made(header, len(paths), read=lambda bands: geotiff.read_stack(spark, paths, bands))

    @classmethod
    def wide(cls, pixels: DataFrame, count: int, header: Header) -> RasterStack:
        """A table ``y, x, s0b1, s0b2, .., s1b1, ..`` of ``count`` scenes; bands become doubles, NaN becomes null."""
        bands = (len(pixels.columns) - 2) // max(count, 1)
        clean = _no_nan(pixels)
        return cls._made(header.with_(bands=bands), count, read=lambda some: clean.select("y", "x", *[f"s{k}b{b}" for k in range(count) for b in some]))

    @classmethod
    def of(cls, rows: DataFrame, count: int, header: Header) -> RasterStack:
        """A table ``scene, y, x, b1, ..`` of ``count`` scenes; bands become doubles, NaN becomes null."""
        bands = [c for c in rows.columns if c not in ("scene", "y", "x")]
        return cls._made(header.with_(bands=len(bands)), count, rows=_no_nan(rows, "scene"))

    @property
    def scenes(self) -> list[Raster]:
        if self._scenes is None:
            if self._rows is not None:
                self._scenes = [Raster(self._rows.where(F.col("scene") == k).drop("scene"), self.header) for k in range(self.count)]
            else:
                names = range(1, self.header.bands + 1)
                pixels = self._read(list(names))
                self._scenes = [Raster(pixels.select("y", "x", *[F.col(f"s{k}b{b}").alias(f"b{b}") for b in names]), self.header) for k in range(self.count)]
        return self._scenes

    def _and(self, step: Callable[[Raster], Raster]) -> RasterStack:
        return self._made(self.header, self.count, scenes=self.scenes, steps=(*self.steps, step))

    def algebra(self, expression: str) -> RasterStack:
        one = self.header.with_(bands=1)
        if self._rows is not None:
            value = compile_expression(expression, self.header.bands).cast("double").alias("b1")
            return self._made(one, self.count, rows=self._rows.select("scene", "y", "x", value))
        if self._read is not None:
            used: set[int] = set()
            values = [compile_expression(expression, self.header.bands, lambda n, k=k: used.add(n) or F.col(f"s{k}b{n}")).cast("double").alias(f"s{k}b1") for k in range(self.count)]
            pixels = self._read(sorted(used)).select("y", "x", *values)
            return self._made(one, self.count, read=lambda bands: pixels)
        return self._and(lambda r: r.algebra(expression))

    def reproject(self, *args, **options) -> RasterStack:
        return self._and(lambda r: r.reproject(*args, **options))

    def temporal(self, op: str, t0: int = 0, t1: int = -1, time_values: list[float] | None = None) -> Raster:
        if self._read is not None:
            names = [f"s{k}b1" for k in range(self.count)]
            return Raster(temporals.beside(self._read([1]), names, op, t0, t1, time_values), self.header)
        rows, header = self._rows, self.header
        if rows is None:
            done = list(self.scenes)
            for step in self.steps:
                done = [step(r) for r in done]
            header = done[0].header
            for k, r in enumerate(done):
                part = r.only([1]).select(F.lit(k).alias("scene"), "y", "x", "b1")
                rows = part if rows is None else rows.unionByName(part)
        return Raster(temporals.temporal(rows, self.count, op, t0, t1, time_values), header)

    def to_memory(self):
        raise ValueError("a stack has to be reduced by temporal() first")

    save_local = to_memory


def _same_grid(headers: list[Header]) -> None:
    first = headers[0]
    for h in headers[1:]:
        if (h.width, h.height, h.transform, h.crs) != (first.width, first.height, first.transform, first.crs):
            raise ValueError("the scenes' grids differ")
