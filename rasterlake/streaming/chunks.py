"""Bounded streams: rasters by full-width strips in order, and stacks that grow while scenes arrive."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import Tiling, by_block
from ..plans.header import Header

STRIP_PIXELS = 4_000_000


def strips(pixels: DataFrame, header: Header, rows: int | None = None) -> DataFrame:
    """``y_offset, width, height, data`` (float32, band after band) of each strip."""
    rows = rows or max(1, min(header.height, STRIP_PIXELS // max(header.width, 1)))
    bands = [c for c in pixels.columns if c not in ("y", "x")]
    fill = header.nodata if header.nodata is not None else float("nan")
    width, height = header.width, header.height

    tiling = Tiling(height, width, rows, width)

    def work(block, grid, there):
        y0, y1, _, _ = tiling.core(block)
        data = np.where(np.isnan(grid), fill, grid).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([y0], pa.int32()), pa.array([width], pa.int32()), pa.array([y1 - y0], pa.int32()), pa.array([data], pa.binary())], names=["y_offset", "width", "height", "data"])

    return by_block(pixels.select("y", "x", *bands), tiling, work, "y_offset int, width int, height int, data binary")


class ChunkQueue:
    """A bounded queue between a producer and consumers in threads: a full queue holds the producer back, an empty one the consumers
    until the producer has finished. An error that the producer finishes with is raised to the consumer after the last chunk."""

    def __init__(self, capacity: int = 4):
        if capacity < 1:
            raise ValueError("the capacity must be 1 or more")
        self.capacity = capacity
        self._items: deque = deque()
        self._change = threading.Condition()
        self._done = self._closed = False
        self._error: BaseException | None = None

    @property
    def size(self) -> int:
        return len(self._items)

    @property
    def utilization(self) -> float:
        return self.size / self.capacity

    @property
    def finished(self) -> bool:
        """Whether nothing more will come."""
        return self._done and not self._items

    def push(self, item, timeout: float | None = None) -> bool:
        """Add a chunk, waiting for room (for ``timeout`` seconds at most); False if there was none, or the queue is closed."""
        with self._change:
            if not self._change.wait_for(lambda: self._closed or len(self._items) < self.capacity, timeout) or self._closed:
                return False
            self._items.append(item)
            self._change.notify_all()
            return True

    def pop(self, timeout: float | None = None):
        """The next chunk; None at the end (``TimeoutError`` if none came in time)."""
        with self._change:
            if not self._change.wait_for(lambda: self._items or self._done, timeout):
                raise TimeoutError("no chunk came in time")
            if self._items:
                item = self._items.popleft()
                self._change.notify_all()
                return item
            if self._error is not None:
                error, self._error = self._error, None
                raise error
            return None

    def finish(self, error: BaseException | None = None) -> None:
        """No more chunks will come."""
        with self._change:
            self._done, self._error = True, error
            self._change.notify_all()

    def close(self) -> None:
        """Drop what is held and let the producer go."""
        with self._change:
            self._closed = self._done = True
            self._items.clear()
            self._change.notify_all()


class ChunkStream:
    """Iteration over strips, from the top down, through a queue of ``buffered`` strips; ``next()`` gives None at the end. Errors of tasks
    are raised here. Strips are fetched one partition ahead, so that memory is bounded whatever the raster's size."""

    def __init__(self, pixels: DataFrame, header: Header, rows: int | None = None, buffered: int = 4):
        self._bands = len(pixels.columns) - 2
        self.queue = ChunkQueue(buffered)
        found = strips(pixels, header, rows).orderBy("y_offset")

        def produce() -> None:
            error = None
            try:
                for row in found.toLocalIterator(prefetchPartitions=True):
                    if not self.queue.push(row):
                        break
            except BaseException as e:  # handed on to the consumer
                error = e
            self.queue.finish(error)

        # a thread of Spark's own kind, so that its jobs belong to this session's properties
        self._thread = InheritableThread(target=produce, session=pixels.sparkSession, daemon=True)
        self._thread.start()

    def __iter__(self) -> Iterator[dict]:
        while (chunk := self.next()) is not None:
            yield chunk

    def next(self) -> dict | None:
        row = self.queue.pop()
        if row is None:
            return None
        data = np.frombuffer(row.data, np.float32).reshape(self._bands, row.height, row.width)
        return {"y_offset": row.y_offset, "width": row.width, "height": row.height, "data": data[0] if self._bands == 1 else data}

    def close(self) -> None:
        """Stop before the end."""
        self.queue.close()


def arriving(scenes: DataFrame, op: str) -> DataFrame:
    """A streaming reduction (``mean``, ``std``, ``min``, ``max``) of arriving scenes by pixel, for complete or update output."""
    out = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}.get(op)
    if out is None:
        raise ValueError(f"{op!r} is not reduced scene by scene")
    return scenes.groupBy("y", "x").agg(out("b1").alias("b1"))
