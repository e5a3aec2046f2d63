"""GeoTIFF as a Spark data source, and a writer of tiles.

Files are reached through Arrow's file systems, so that local paths and ``s3://`` (also ``/vsis3/``) paths read alike. A reading
task gets rows of blocks of one file; only the bands asked for are fetched, and only blocks that filters on ``y`` and ``x`` leave;
neighbouring blocks with small gaps come in one read, and reads go on side by side.

Writing: tasks pack tiles and append them to part files of their own beside the target. Their sizes tell each part's place, so that
on a file system with random writes tasks copy the parts into the file; elsewhere they are sent one after the other through one
stream (for S3 a multipart upload). Only the directory's entries, 16 bytes a tile, come to the driver.
"""

from __future__ import annotations

import base64
import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.blocks import PIECES, Source, Tiling, cut, dealt, over_blocks, pack, placed
from ..plans.header import Header
from . import tiff

TILE = 512
GAP = 128 * 1024
#: Reads that a task has under way at once.
CONNECTIONS = 8
PART = "band int, ty int, tx int, part string, at long, size long"


def uri_of(path: str) -> str:
    """A path as a URI: ``/vsis3/b/k`` and ``s3a://b/k`` are ``s3://b/k``, plain paths are files."""
    if path.startswith("/vsis3/"):
        return "s3://" + path[len("/vsis3/") :]
    if path.startswith("s3a://"):
        return "s3://" + path[6:]
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else "file://" + os.path.abspath(path)


def _opened(path: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(uri_of(path))
    return system.open_input_file(base)


def header_of(path: str) -> tiff.Layout:
    """The file's layout, without reading pixels. Errors name the file."""
    try:
        with _opened(path) as f:
            return tiff.parse(lambda at, n: f.read_at(n, at))
    except (OSError, ValueError) as e:
        raise ValueError(f"cannot open {path}: {e}") from e


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


def _bounds(f, low: int, high: int) -> tuple[int, int] | None:
    """The range (ends included) that a filter leaves of ``low`` to ``high``; None for filters of other kinds."""
    v = f.value
    if isinstance(f, In):
        known = [x for x in v if x is not None]
        return (max(low, min(known)), min(high, max(known))) if known else (low, low - 1)
    if isinstance(f, EqualTo):
        return max(low, v), min(high, v)
    if isinstance(f, GreaterThan | GreaterThanOrEqual):
        return max(low, v + isinstance(f, GreaterThan)), high
    if isinstance(f, LessThan | LessThanOrEqual):
        return low, min(high, v - isinstance(f, LessThan))
    return None


class GeoTiffReader(DataSourceReader):
    """Pixels of files of one grid, side by side: ``names`` has the columns of all bands of the first file, then of the next."""

    def __init__(self, paths: list[str], bands: list[int], names: list[str], strip: int, blocks: Tiling | np.ndarray | None = None):
        self.paths, self.bands, self.names, self.strip, self.blocks = paths, bands, names, strip, blocks
        self.limits: dict[str, tuple[int, int]] = {"y": (0, 1 << 62), "x": (0, 1 << 62)}
        if isinstance(blocks, np.ndarray):  # only what the windows look at
            some = blocks[blocks[:, 1] > 0]
            self.limits = {"y": (int(some[:, 0].min()), int(some[:, 1].max()) - 1), "x": (int(some[:, 2].min()), int(some[:, 3].max()) - 1)} if len(some) else {"y": (0, -1), "x": (0, -1)}

    def pushFilters(self, filters):
        """Filters on places leave out blocks; Spark applies them to the pixels again."""
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("y",), ("x",)):
                limits = _bounds(f, *self.limits[f.attribute[0]])
                if limits:
                    self.limits[f.attribute[0]] = limits
            yield f

    def partitions(self):
        layout = header_of(self.paths[0])
        step = max(1, self.strip // layout.block_height)
        first, last = self.limits["y"][0] // layout.block_height, min(self.limits["y"][1] // layout.block_height, layout.down - 1)
        # a partition at least: Spark reads a source without partitions as an unknown one
        return [_Rows(a, min(a + step, last + 1)) for a in range(first, last + 1, step)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        layouts = [header_of(p) for p in self.paths]
        first, h = layouts[0], layouts[0].header
        x0 = min(self.limits["x"][0] // first.block_width * first.block_width, h.width)
        x1 = min((min(self.limits["x"][1], h.width) // first.block_width + 1) * first.block_width, h.width)
        with ExitStack() as open_:
            files = [open_.enter_context(_opened(p)) for p in self.paths]
            pool = open_.enter_context(ThreadPoolExecutor(CONNECTIONS))
            for by in range(partition.first, partition.last):
                y0, y1 = by * first.block_height, min((by + 1) * first.block_height, h.height)
                if x0 >= x1:
                    continue
                if self.blocks is not None:
                    yield self._cut(np.concatenate([self._part(f, layout, (y0, y1, x0, x1), pool) for f, layout in zip(files, layouts)]), y0, x0)
                    continue
                rows, width = y1 - y0, x1 - x0
                cols = [pa.array(np.repeat(np.arange(y0, y1, dtype=np.int32), width)), pa.array(np.tile(np.arange(x0, x1, dtype=np.int32), rows))]
                for f, layout in zip(files, layouts):
                    for cells in self._part(f, layout, (y0, y1, x0, x1), pool):
                        v = cells.ravel()
                        empty = np.isnan(v)
                        cols.append(pa.array(v, mask=empty) if empty.any() else pa.array(v))
                yield pa.RecordBatch.from_arrays(cols, names=["y", "x", *self.names])

    def _cut(self, grid: np.ndarray, y0: int, x0: int) -> pa.RecordBatch:
        _, h, w = grid.shape
        b = self.blocks
        if isinstance(b, Tiling):
            return cut(grid, y0, x0, b.touching(y0, y0 + h, x0, x0 + w), b.window)
        near = np.flatnonzero((b[:, 0] < y0 + h) & (b[:, 1] > y0) & (b[:, 2] < x0 + w) & (b[:, 3] > x0))
        return cut(grid, y0, x0, near.tolist(), lambda k: tuple(b[k].tolist()))

    def _part(self, f, layout: tiff.Layout, window: tuple[int, int, int, int], pool: ThreadPoolExecutor) -> np.ndarray:
        """The bands' cells of a window, from the blocks that it touches; NaN for nodata and tiles that were never written."""
        y0, y1, x0, x1 = window
        h = layout.header
        bw, bh = layout.block_width, layout.block_height
        downs, acrosses = range(y0 // bh, (y1 - 1) // bh + 1), range(x0 // bw, (x1 - 1) // bw + 1)
        wanted = {layout.block(b - 1, by, bx): by for b in self.bands for by in downs for bx in acrosses}
        wanted = {k: by for k, by in wanted.items() if layout.sizes[k]}
        raw = self._fetch(f, layout, sorted(wanted, key=layout.offsets.__getitem__), pool)
        # the last strip of a file without tiles is cut off at its end
        stored = {k: bh if bw != h.width or layout.down == 1 else min(bh, h.height - by * bh) for k, by in wanted.items()}
        blocks = dict(zip(raw, pool.map(lambda k: tiff.decode(raw[k], layout, stored[k]), raw)))
        out = np.full((len(self.bands), y1 - y0, x1 - x0), np.nan)
        for n, b in enumerate(self.bands):
            for by in downs:
                for bx in acrosses:
                    block = blocks.get(layout.block(b - 1, by, bx))
                    if block is None:
                        continue
                    ya, yb, xa, xb = max(by * bh, y0), min((by + 1) * bh, y1), max(bx * bw, x0), min((bx + 1) * bw, x1)
                    out[n, ya - y0 : yb - y0, xa - x0 : xb - x0] = block[ya - by * bh : yb - by * bh, xa - bx * bw : xb - bx * bw, 0 if layout.planar else b - 1]
        if h.nodata is not None and not np.isnan(h.nodata):
            out[out == h.nodata] = np.nan
        return out

    @staticmethod
    def _fetch(f, layout: tiff.Layout, order: list[int], pool: ThreadPoolExecutor) -> dict[int, bytes]:
        """Blocks by number; those whose gaps are small come in one read."""
        runs: list[list[int]] = []
        end = -1
        for k in order:
            if runs and layout.offsets[k] - end <= GAP:
                runs[-1].append(k)
            else:
                runs.append([k])
            end = max(end, layout.offsets[k] + layout.sizes[k]) if len(runs[-1]) > 1 else layout.offsets[k] + layout.sizes[k]

        def read(run: list[int]) -> dict[int, bytes]:
            start, stop = layout.offsets[run[0]], max(layout.offsets[n] + layout.sizes[n] for n in run)
            data = f.read_at(stop - start, start)
            if len(data) < stop - start:
                raise ValueError("the file ends inside a block")
            return {n: data[layout.offsets[n] - start : layout.offsets[n] - start + layout.sizes[n]] for n in run}

        out: dict[int, bytes] = {}
        for got in pool.map(read, runs):
            out.update(got)
        return out


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").option("bands", "1,3").load(path)``; ``strip`` is the rows of pixels a task. With ``paths`` (a JSON
    list) the files' bands stand side by side, as ``s0b1, .., s1b1, ..``. With ``tiling`` (rows, columns, halo) or ``windows`` (base64 of
    32-bit first and last rows and columns of each block) it gives pieces of blocks in place of pixels."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def _bands(self) -> list[int]:
        n = min(header_of(p).header.bands for p in self._paths())
        text = self.options.get("bands", "")
        bands = [int(b) for b in text.split(",")] if text else list(range(1, n + 1))
        if bad := [b for b in bands if not 1 <= b <= n]:
            raise ValueError(f"bands {bad} are not among {n}")
        return bands

    def _names(self) -> list[str]:
        return [f"s{k}b{b}" for k in range(len(self._paths())) for b in self._bands()] if "paths" in self.options else [f"b{b}" for b in self._bands()]

    def _blocks(self) -> Tiling | np.ndarray | None:
        if "windows" in self.options:
            return np.frombuffer(base64.b64decode(self.options["windows"]), np.int32).reshape(-1, 4).astype(np.int64)
        if "tiling" not in self.options:
            return None
        rows, columns, halo = map(int, self.options["tiling"].split(","))
        h = header_of(self._paths()[0]).header
        return Tiling(h.height, h.width, rows, columns, halo)

    def schema(self) -> str:
        if "tiling" in self.options or "windows" in self.options:
            return PIECES
        return "y int, x int, " + ", ".join(f"{n} double" for n in self._names())

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoTiffReader(self._paths(), self._bands(), self._names(), int(self.options.get("strip", "512")), self._blocks())


def _reader(spark: SparkSession, bands: list[int] | None):
    spark.dataSource.register(GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("geotiff")
    return reader.option("bands", ",".join(map(str, bands))) if bands else reader


def read(spark: SparkSession, path: str, bands: list[int] | None = None) -> tuple[DataFrame, Header]:
    """Pixels and header of a file."""
    header = header_of(path).header
    return _reader(spark, bands).load(path), header


def source(spark: SparkSession, path: str, bands: list[int]) -> Source:
    """Bands of a file, to be read as pieces of blocks: they go from the file into the exchange without becoming rows of pixels."""

    def pieces(blocks: Tiling | np.ndarray) -> DataFrame:
        reader = _reader(spark, bands)
        if isinstance(blocks, Tiling):
            return reader.option("tiling", f"{blocks.rows},{blocks.columns},{blocks.halo}").load(path)
        return reader.option("windows", base64.b64encode(blocks.astype(np.int32).tobytes()).decode()).load(path)

    return Source(spark, len(bands), pieces)


def read_stack(spark: SparkSession, paths: list[str], bands: list[int]) -> DataFrame:
    """Pixels of files of one grid, with the bands of all of them: ``y, x, s0b1, .., s1b1, ..``."""
    return _reader(spark, bands).option("paths", json.dumps(paths)).load()


def write(pixels: DataFrame, header: Header, path: str, tile: int = TILE, by_tasks: bool | None = None) -> None:
    """Write float32 tiles (DEFLATE, predictor 3, BigTIFF). Null pixels and places without one are ``nodata`` (NaN without it).

    ``by_tasks`` tells whether tasks can write into the middle of a file; by default that is so of plain file systems."""
    from pyarrow import fs

    bands = [c for c in pixels.columns if c not in ("y", "x")]
    header = header.with_(bands=len(bands))
    fill = header.nodata if header.nodata is not None else float("nan")
    tiling = Tiling(header.height, header.width, tile, tile)
    uri, across, down = uri_of(path), tiling.across, tiling.down
    system, base = fs.FileSystem.from_uri(uri)
    folder = f"{uri}.parts-{uuid.uuid4().hex}"
    system.create_dir(f"{base}{folder[len(uri):]}", recursive=True)
    try:
        packed = placed(pixels, header.height, header.width).mapInArrow(pack(tiling), PIECES)
        made = dealt(packed, across * down).mapInArrow(_tiles(tiling, len(bands), fill, folder), PART).toArrow().to_pydict()
        # parts of attempts that failed are in the folder too; only those that are listed count
        ends: dict[str, int] = {}
        for part, at, size in zip(made["part"], made["at"], made["size"]):
            ends[part] = max(ends.get(part, 0), at + size)
        starts, at = {}, 16
        for part in sorted(ends):
            starts[part] = at
            at += ends[part]
        offsets, sizes = [0] * (across * down * len(bands)), [0] * (across * down * len(bands))
        for band, ty, tx, part, start, size in zip(*(made[c] for c in ("band", "ty", "tx", "part", "at", "size"))):
            k = (band * down + ty) * across + tx
            offsets[k], sizes[k] = starts[part] + start, size
        first, last = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at), tiff.directory(header, tile, offsets, sizes, at)
        if uri.startswith("file://") if by_tasks is None else by_tasks:
            local = base + folder[len(uri) :]
            with open(f"{local}/whole", "wb") as f:
                f.write(first)
                f.seek(at)
                f.write(last)
            jobs = [(f"{local}/{part}", starts[part]) for part in starts]
            if jobs:
                spark = pixels.sparkSession
                spark.createDataFrame(jobs, "part string, at long").repartition(len(jobs)).mapInArrow(_copies(f"{local}/whole"), "n long").collect()
            os.replace(f"{local}/whole", base)
        else:
            with system.open_output_stream(base) as f:
                f.write(first)
                for part in starts:
                    with system.open_input_stream(f"{base}{folder[len(uri):]}/{part}") as g:
                        while block := g.read(1 << 24):
                            f.write(block)
                f.write(last)
    finally:
        system.delete_dir(f"{base}{folder[len(uri):]}")


def _tiles(tiling: Tiling, bands: int, fill: float, folder: str):
    """Packs a partition's tiles into one part file, and lists them."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, at, out = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None

        def work(block, grid, there):
            nonlocal at, out
            if out is None:
                out = system.open_output_stream(f"{base}/{part}")
            ty, tx = divmod(block, tiling.across)
            rows = []
            for band in range(bands):
                cells = np.full((tiling.rows, tiling.columns), fill, np.float32)
                cells[: grid.shape[1], : grid.shape[2]] = np.where(np.isnan(grid[band]), fill, grid[band])
                raw = tiff.encode_tile(cells)
                out.write(raw)
                rows.append((band, ty, tx, part, at, len(raw)))
                at += len(raw)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["band", "ty", "tx", "part", "at", "size"])

        yield from over_blocks(batches, bands, tiling.window, work)
        if out is not None:
            out.close()

    return run


def _copies(target: str):
    """Copies parts to their places in one file."""

    def run(batches):
        for batch in batches:
            for part, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(part, "rb") as f, open(target, "r+b") as g:
                    g.seek(at)
                    shutil.copyfileobj(f, g, 1 << 22)
                yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    return run
