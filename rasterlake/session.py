"""Sessions: what a run needs from Spark before its first query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for workers that have no copy on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "rasterlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join("rasterlake", f.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a folder of our own on a single
    machine, and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return "file://" + _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="rasterlake-"))


def narrow_rows(spark: SparkSession, on: bool = True) -> None:
    """Tell the session that rows sent to Python workers are narrow, as pixels are: batches are then bounded by their rows alone.

    The bound in bytes is looked at after every row, which takes three times as long as sending a pixel does. Pieces of blocks are wide,
    but a partition has few of them. ``on=False`` gives back the default, which rows of texts need."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if on:
        spark.conf.set(name, str((1 << 31) - 1))
    else:
        spark.conf.unset(name)


def local(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine, as tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
