"""Progress of a job on the terminal, from Spark's status tracker."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def line(done: int, total: int, width: int = 40) -> str:
    """A bar of ``done`` parts of ``total``."""
    share = done / total if total else 1.0
    return f"[{'=' * round(share * width):<{width}}] {share:4.0%}"


@contextmanager
def progress(spark: SparkSession, verbose: bool = True, every: float = 0.5, out=None) -> Iterator[None]:
    """While the block runs, show how many tasks of the running stages are done; nothing if not ``verbose``."""
    if not verbose:
        yield
        return
    out, stop = out or sys.stderr, threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def show() -> None:
        while not stop.wait(every):
            stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
            if stages:
                out.write("\r" + line(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)))
                out.flush()

    thread = threading.Thread(target=show, daemon=True)
    thread.start()
    try:
        yield
        out.write("\r" + line(1, 1) + "\n")
    finally:
        stop.set()
        thread.join()
