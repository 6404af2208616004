"""Comparison metrics and forward loss formulas as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .points import norm


def pearson(a: str, b: str) -> Column:
    """0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def unit_range(rows: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Values scaled to [0, 1] over each group's finite ones; NaN elsewhere, 0 where the range is below 1e-10."""
    fine = finite(F.col(value))
    ends = rows.where(fine).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.col("hi") - F.col("lo")
    scaled = F.when(F.col("lo").isNull(), 0.0).when(~fine, float("nan")).when(width < 1e-10, 0.0).otherwise((F.col(value) - F.col("lo")) / F.when(width < 1e-10, 1.0).otherwise(width))
    return rows.join(ends, keys, "left").withColumn("scaled", scaled).drop("lo", "hi")


def distance_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """correlation, mean and largest error of ``pairs(keys, v, a, b)`` after scaling both to [0, 1]; 0, 1, 1 for a group without finite pairs."""
    one = unit_range(pairs, keys, "a").withColumnRenamed("scaled", "sa")
    both = unit_range(one, keys, "b").withColumnRenamed("scaled", "sb").where(finite(F.col("sa")) & finite(F.col("sb")))
    off = F.abs(F.col("sa") - F.col("sb"))
    out = both.groupBy(*keys).agg(pearson("sa", "sb").alias("correlation"), F.avg(off).alias("mean_error"), F.max(off).alias("max_error"))
    return pairs.select(*keys).distinct().join(out, keys, "left").fillna({"correlation": 0.0, "mean_error": 1.0, "max_error": 1.0})


def vector_losses(rows: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """Mean losses of 3-vectors p (px, py, pz) against t (tx, ty, tz)."""
    p, t = ([F.col(f"{s}{a}") for a in "xyz"] for s in "pt")
    lp, lt = norm(*p), norm(*t)
    dot = sum((a * b for a, b in zip(p[1:], t[1:])), p[0] * t[0])
    cos = dot / (F.greatest(lp, F.lit(eps)) * F.greatest(lt, F.lit(eps)))  # each vector by its own floored length
    square = sum(((a - b) * (a - b) for a, b in zip(p[1:], t[1:])), (p[0] - t[0]) * (p[0] - t[0]))
    relative = (lp - lt) / (lt + eps)
    logs = F.log(lp + eps) - F.log(lt + eps)
    return rows.groupBy(*keys).agg(F.avg(square / 3).alias("vector_mse"), F.avg(1 - cos).alias("direction_cosine"), F.avg((lp - lt) * (lp - lt)).alias("magnitude_mse"), F.avg(relative * relative).alias("relative_magnitude"), F.avg(logs * logs).alias("log_magnitude"))


def running_best(log: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("best", F.max(value).over(w)).withColumn("improved", F.col(value) >= F.col("best"))


def mean_by_name(metrics: DataFrame) -> DataFrame:
    """Named metrics averaged over meshes; a mesh without one is left out of its mean."""
    return metrics.groupBy("name").agg(F.avg("value").alias("value"))


def curvature_errors(rows: DataFrame, true: str, estimate: str) -> DataFrame:
    """``rows`` with the absolute error of an estimate and its share of the true value in percent."""
    off = F.abs(F.col(estimate) - F.col(true))
    return rows.withColumns({"abs_error": off, "percent_error": 100 * off / (F.abs(F.col(true)) + 1e-10)})


def timings(runs: DataFrame) -> DataFrame:
    """(method, phase, best, share) of ``runs(method, phase, repeat, seconds)``: the fastest repeat, and its share of the method's total."""
    best = runs.groupBy("method", "phase").agg(F.min("seconds").alias("best"))
    total = best.groupBy("method").agg(F.sum("best").alias("total"))
    return best.join(total, "method").select("method", "phase", "best", F.try_divide("best", "total").alias("share"))


def medians(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, median) of each group's values that aren't null, exact, in tasks that hold a range of different values.

    Equal values are counted first. Ranges of (keys, value) follow each other over the partitions, so the counts of
    the ranges tell where the middle ranks lie, and only those ranges are numbered.
    """
    scratch = Scratch(rows.sparkSession, "medians")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    dealt = scratch.put(counts.repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_size"))
    whole = Window.partitionBy(*keys)
    ranges = ranges.select(*keys, "_part", F.sum("_size").over(whole).alias("_n"), (F.sum("_size").over(whole.orderBy("_part")) - F.col("_size")).alias("_before"), "_size")  # a row for each partition
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = ranges.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low))
    met = dealt.join(F.broadcast(middle), [*keys, "_part"])
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_x"))
    placed = met.select(*keys, "_x", "_n", "_c", last.alias("_last"))
    at = lambda r: F.max(F.when((F.col("_last") > r) & (F.col("_last") - F.col("_c") <= r), F.col("_x")))
    return placed.groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high")).select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(0.5 * F.col("_low") + 0.5 * F.col("_high")).alias("median"))
