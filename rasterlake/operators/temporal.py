"""Reduction of a stack of scenes pixel by pixel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import divide

OPS = ("diff", "ratio", "anomaly_mean", "anomaly_baseline", "trend", "mean", "std", "min", "max")


def _checked(op: str, count: int, t0: int, t1: int, times: list[float] | None) -> tuple[int, list[float]]:
    """The last scene's number, and the scenes' times."""
    if op not in OPS:
        raise ValueError(f"unknown operation {op!r}")
    t1 = count - 1 if t1 < 0 else t1
    if not 0 <= t0 < count or not 0 <= t1 < count:
        raise ValueError(f"scenes {t0} and {t1} are not among {count}")
    times = [float(k) for k in range(count)] if not times else [float(t) for t in times]
    if len(times) != count:
        raise ValueError("as many times as scenes are needed")
    return t1, times


def temporal(scenes: DataFrame, count: int, op: str, t0: int = 0, t1: int = -1, times: list[float] | None = None) -> DataFrame:
    """``b1`` over the scenes (``scene, y, x, b1``) of each pixel; one aggregation by pixel. Negative ``t1`` is the last scene.

    Null values are left out; a pixel without values is null."""
    t1, times = _checked(op, count, t0, t1, times)
    v = F.col("b1")

    def at(k: int) -> Column:
        return F.max(F.when(F.col("scene") == k, v))

    if op == "trend":
        t = F.get(F.array(*map(F.lit, times)), F.col("scene"))
        n, st, sv = F.count(v), F.sum(F.when(v.isNotNull(), t)), F.sum(v)
        out = _slope(n, st, sv, F.sum(t * v), F.sum(F.when(v.isNotNull(), t * t)))
    else:
        out = {
            "diff": lambda: at(t1) - at(t0), "ratio": lambda: divide(at(t1), at(t0)), "anomaly_mean": lambda: at(t0) - F.avg(v), "anomaly_baseline": lambda: at(t0) - at(t1),
            "mean": lambda: F.avg(v), "std": lambda: F.stddev_pop(v), "min": lambda: F.min(v), "max": lambda: F.max(v),
        }[op]()
    return scenes.groupBy("y", "x").agg(out.alias("b1"))


def _slope(n: Column, st: Column, sv: Column, stv: Column, stt: Column) -> Column:
    below = n * stt - st * st
    return (n * stv - st * sv) / F.when(below == 0, F.lit(1.0)).otherwise(below)


def beside(pixels: DataFrame, names: list[str], op: str, t0: int = 0, t1: int = -1, times: list[float] | None = None) -> DataFrame:
    """The same over scenes that stand side by side, a column each: expressions within a row, and no exchange."""
    t1, times = _checked(op, len(names), t0, t1, times)
    values = [F.col(c) for c in names]
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    n = total([v.isNotNull().cast("int") for v in values])
    sums = pixels.select("y", "x", *names, n.alias("_n"), total([F.coalesce(v, F.lit(0.0)) for v in values]).alias("_s"))
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    a, b = values[t0], values[t1]
    if op in ("min", "max"):
        out = values[0] if len(values) == 1 else (F.least if op == "min" else F.greatest)(*values)
    elif op == "std":
        sums = sums.withColumn("_m", mean)
        out = F.sqrt(F.try_divide(total([F.coalesce((v - F.col("_m")) * (v - F.col("_m")), F.lit(0.0)) for v in values]), F.col("_n")))
    elif op == "trend":
        here = [F.when(v.isNotNull(), F.lit(t)).otherwise(0.0) for v, t in zip(values, times)]
        out = F.when(F.col("_n") > 0, _slope(F.col("_n"), total(here), F.col("_s"), total([F.coalesce(v, F.lit(0.0)) * t for v, t in zip(values, times)]), total([h * t for h, t in zip(here, times)])))
    else:
        out = {"diff": lambda: b - a, "ratio": lambda: divide(b, a), "anomaly_mean": lambda: a - mean, "anomaly_baseline": lambda: a - b, "mean": lambda: mean}[op]()
    return sums.select("y", "x", out.alias("b1"))
