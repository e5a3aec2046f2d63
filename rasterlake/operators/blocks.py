"""Blocks: pixels packed by block, dealt to partitions in one exchange, and worked on as numpy grids.

Tasks pack the pixels that they read into pieces: for each block that a pixel belongs to (its own, and those whose halo it lies in)
runs of places and their cells as bytes. Only pieces are exchanged, about the size of the cells themselves, and partition numbers
come from block numbers, so that partitions are even. A partition's pieces are sorted by block, and one block is held at a time.

Cells are float64, NaN for null. Places without a pixel are NaN too, and give no pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a block, pixels that are packed at once, and blocks of a partition where there are many.
BLOCK = 512
GATHER = 1 << 18
PER_TASK = 16
PIECES = "block long, runs binary, cells binary"


@dataclass(frozen=True)
class Tiling:
    """A raster's blocks, row by row, with ``halo`` pixels around each."""

    height: int
    width: int
    rows: int
    columns: int
    halo: int = 0

    @classmethod
    def of(cls, header, halo: int = 0, block: int = BLOCK) -> Tiling:
        side = max(block, halo, 1)  # a halo reaches into the next block only
        return cls(header.height, header.width, side, side, halo)

    @property
    def down(self) -> int:
        return -(-self.height // self.rows)

    @property
    def across(self) -> int:
        return -(-self.width // self.columns)

    def core(self, block: int) -> tuple[int, int, int, int]:
        """First and last (exclusive) row and column of a block's own pixels."""
        by, bx = divmod(block, self.across)
        return by * self.rows, min((by + 1) * self.rows, self.height), bx * self.columns, min((bx + 1) * self.columns, self.width)

    def window(self, block: int) -> tuple[int, int, int, int]:
        """The same with the halo, as far as the raster goes."""
        y0, y1, x0, x1 = self.core(block)
        return max(y0 - self.halo, 0), min(y1 + self.halo, self.height), max(x0 - self.halo, 0), min(x1 + self.halo, self.width)

    def own(self, block: int, grid: np.ndarray) -> np.ndarray:
        """A block's own pixels of a grid over its window."""
        (y0, y1, x0, x1), (wy, _, wx, _) = self.core(block), self.window(block)
        return grid[..., y0 - wy : y1 - wy, x0 - wx : x1 - wx]

    def padded(self, block: int, grid: np.ndarray, repeat: bool = True, fill=np.nan) -> np.ndarray:
        """A grid over the window with its whole halo: beyond the raster the edge repeats, or ``fill`` stands there."""
        (y0, y1, x0, x1), (wy0, wy1, wx0, wx1), h = self.core(block), self.window(block), self.halo
        more = ((h - (y0 - wy0), h - (wy1 - y1)), (h - (x0 - wx0), h - (wx1 - x1)))
        if not any(map(any, more)):
            return grid
        return np.pad(grid, more, mode="edge") if repeat else np.pad(grid, more, constant_values=fill)

    def touching(self, y0: int, y1: int, x0: int, x1: int) -> list[int]:
        """Blocks whose windows meet a part of the raster."""
        h = self.halo
        rows = range(max(y0 - h, 0) // self.rows, min((y1 - 1 + h) // self.rows, self.down - 1) + 1)
        columns = range(max(x0 - h, 0) // self.columns, min((x1 - 1 + h) // self.columns, self.across - 1) + 1)
        return [by * self.across + bx for by in rows for bx in columns]

    def blocks_of(self, ys: np.ndarray, xs: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
        """Which of the pixels belong to a block, and its number; once for their own blocks and once for each side of halos."""
        by, bx = ys // self.rows, xs // self.columns
        yield slice(None), by * self.across + bx
        if not self.halo:
            return
        ly, lx, h = ys - by * self.rows, xs - bx * self.columns, self.halo
        beside = {-1: (ly < h) & (by > 0), 1: (ly >= self.rows - h) & (by < self.down - 1)}
        along = {-1: (lx < h) & (bx > 0), 1: (lx >= self.columns - h) & (bx < self.across - 1)}
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    there = np.flatnonzero(beside[dy] if not dx else along[dx] if not dy else beside[dy] & along[dx])
                    if len(there):
                        yield there, (by[there] + dy) * self.across + bx[there] + dx


def runs_of(places: np.ndarray) -> bytes:
    """Places as runs of consecutive ones: starts, then lengths."""
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    starts = np.concatenate(([0], cut))
    return np.stack([places[starts], np.diff(np.concatenate((starts, [len(places)])))]).astype(np.int64).tobytes()


def places_of(raw) -> np.ndarray:
    starts, sizes = np.frombuffer(raw, np.int64).reshape(2, -1)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and cells (bands, pixels) of about ``size`` pixels at a time."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= size:
            yield _cells(held)
            held, n = [], 0
    if held:
        yield _cells(held)


def _cells(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held)
    return t.column(0).to_numpy(), np.stack([t.column(k).to_numpy() for k in range(1, t.num_columns)])


def placed(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of a raster as they are sent to tasks: ``place`` (row times width, plus column) and bands; those beyond it are left out."""
    bands = [c for c in pixels.columns if c not in ("y", "x")]
    y, x = F.col("y").cast("int"), F.col("x").cast("int")
    inside = pixels.where(y.between(0, height - 1) & x.between(0, width - 1))
    return inside.select((y.cast("long") * width + x).alias("place"), *[F.col(f"`{b}`").cast("double").alias(b) for b in bands])


def pack(tiling: Tiling) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map from batches of ``placed`` pixels to pieces."""

    def run(batches):
        for places, cells in gathered(batches):
            ys, xs = np.divmod(places, tiling.width)
            for some, blocks in tiling.blocks_of(ys, xs):
                yield pieces(tiling.window, blocks, ys[some], xs[some], cells[:, some])

    return run


def pieces(window: Callable[[int], tuple[int, int, int, int]], blocks: np.ndarray, ys: np.ndarray, xs: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """The pieces of pixels that belong to ``blocks``, each over its block's window."""
    numbers, runs, packed = [], [], []
    if len(blocks):
        low = blocks.min()
        near = blocks - low
        if near.max() < 1 << 16:
            near = near.astype(np.uint16)  # sorted by digits
        if (np.diff(blocks) < 0).any():
            order = np.argsort(near, kind="stable")
            blocks, ys, xs, cells = blocks[order], ys[order], xs[order], cells[:, order]
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            block = int(blocks[a])
            y0, _, x0, x1 = window(block)
            numbers.append(block)
            runs.append(runs_of((ys[a:b] - y0) * (x1 - x0) + (xs[a:b] - x0)))
            packed.append(np.ascontiguousarray(cells[:, a:b]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(runs, pa.binary()), pa.array(packed, pa.binary())], names=["block", "runs", "cells"])


def cut(grid: np.ndarray, y0: int, x0: int, blocks, window) -> pa.RecordBatch:
    """The pieces of a grid (bands, rows, columns) whose first pixel is (``y0``, ``x0``) for the blocks that look at it."""
    _, h, w = grid.shape
    numbers, runs, packed = [], [], []
    for block in blocks:
        wy0, wy1, wx0, wx1 = window(block)
        ya, yb, xa, xb = max(wy0, y0), min(wy1, y0 + h), max(wx0, x0), min(wx1, x0 + w)
        if ya < yb and xa < xb:
            starts = (np.arange(ya, yb) - wy0) * (wx1 - wx0) + xa - wx0
            numbers.append(block)
            runs.append(np.stack([starts, np.full(yb - ya, xb - xa)]).astype(np.int64).tobytes())
            packed.append(np.ascontiguousarray(grid[:, ya - y0 : yb - y0, xa - x0 : xb - x0], dtype=np.float64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(runs, pa.binary()), pa.array(packed, pa.binary())], names=["block", "runs", "cells"])


@dataclass(frozen=True)
class Source:
    """Bands that are not read yet and can be read as pieces: ``pieces`` of the blocks of a tiling, or of blocks with given windows."""

    spark: SparkSession
    bands: int
    pieces: Callable[[Tiling | np.ndarray], DataFrame]


def partitions(spark: SparkSession, blocks: int) -> int:
    return max(1, min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // PER_TASK))))


def dealt(packed: DataFrame, blocks: int) -> DataFrame:
    """Pieces by partition, a block's together."""
    n = partitions(packed.sparkSession, blocks)
    return packed.repartitionById(n, (F.col("block") % n).cast("int")).sortWithinPartitions("block")


def over_blocks(batches: Iterator[pa.RecordBatch], bands: int, window, work) -> Iterator[pa.RecordBatch]:
    """``work`` (block, grid of (bands, rows, columns), places with a pixel) over each block's pieces in turn."""

    def finish(block: int, held: list) -> Iterator[pa.RecordBatch]:
        y0, y1, x0, x1 = window(block)
        grid = np.full((bands, y1 - y0, x1 - x0), np.nan)
        there = np.zeros((y1 - y0, x1 - x0), bool)
        flat, marks = grid.reshape(bands, -1), there.reshape(-1)
        for runs, cells in held:
            if runs is None:
                continue
            at = places_of(runs)
            flat[:, at] = np.frombuffer(cells, np.float64).reshape(bands, -1)
            marks[at] = True
        yield from work(block, grid, there)

    last, held = None, []
    for batch in batches:
        for i, block in enumerate(batch.column(0).to_pylist()):
            if block != last and held:
                yield from finish(last, held)
                held = []
            last = block
            runs, cells = (batch.column(k)[i].as_buffer() if batch.column(k)[i].is_valid else None for k in (1, 2))
            held.append((runs, cells))
    if held:
        yield from finish(last, held)


def pixels_of(core: tuple[int, int, int, int], there: np.ndarray, bands: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of ``y, x, b1, ..`` of a block's own pixels; NaN becomes null."""
    y0, y1, x0, x1 = core
    ys, xs = np.repeat(np.arange(y0, y1, dtype=np.int32), x1 - x0), np.tile(np.arange(x0, x1, dtype=np.int32), y1 - y0)
    cells = [np.ascontiguousarray(b, dtype=np.float64).reshape(-1) for b in bands]
    if not there.all():
        keep = there.reshape(-1)
        ys, xs, cells = ys[keep], xs[keep], [c[keep] for c in cells]
    arrays = []
    for c in cells:
        empty = np.isnan(c)
        arrays.append(pa.array(c, mask=empty) if empty.any() else pa.array(c))
    return pa.RecordBatch.from_arrays([pa.array(ys), pa.array(xs), *arrays], names=["y", "x", *(f"b{k}" for k in range(1, len(cells) + 1))])


def by_block(pixels: DataFrame | Source, tiling: Tiling, work, schema: str) -> DataFrame:
    """``work`` over all blocks of a raster's pixels (``y, x`` and bands): see ``over_blocks``."""
    if isinstance(pixels, Source):
        packed, n = pixels.pieces(tiling), pixels.bands
    else:
        packed, n = placed(pixels, tiling.height, tiling.width).mapInArrow(pack(tiling), PIECES), len(pixels.columns) - 2
    window = tiling.window
    return dealt(packed, tiling.down * tiling.across).mapInArrow(lambda batches: over_blocks(batches, n, window, work), schema)


def mapped(pixels: DataFrame | Source, tiling: Tiling, kernel, bands: int) -> DataFrame:
    """Pixels ``y, x, b1, ..`` from ``kernel`` (block, grid) to grids over each block's own pixels."""

    def work(block, grid, there):
        own = tiling.own(block, there)
        if own.any():
            yield pixels_of(tiling.core(block), own, kernel(block, grid))

    return by_block(pixels, tiling, work, "y int, x int, " + ", ".join(f"b{k} double" for k in range(1, bands + 1)))
