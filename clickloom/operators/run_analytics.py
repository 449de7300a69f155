"""Measures over tables of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_nodes(runs: DataFrame, model: int, device: str, metric: str = "training_time") -> DataFrame:
    """(nodes, sessions, metric): means over repeated runs of a model on a device, in order."""
    rows = runs.where((F.col("model") == model) & (F.col("device") == device))
    return rows.groupBy("nodes", "sessions").agg(F.avg(metric).alias(metric)).orderBy("nodes", "sessions")


def speedup(runs: DataFrame, baseline: DataFrame, metric: str = "training_time") -> DataFrame:
    """(nodes, sessions, speedup): baseline (sessions, metric) over the runs' metric."""
    base = baseline.groupBy("sessions").agg(F.avg(metric).alias("__base"))
    return runs.join(base, "sessions").select("nodes", "sessions", F.try_divide("__base", metric).alias("speedup"))


def computation_share() -> Column:
    """Computation as a share of the time of an iteration, in per cent."""
    return (100 * F.try_divide("computation_time", "iteration_time")).alias("computation_percent")


def roofline(intensity: Column, peak: float, bandwidth: float) -> Column:
    """Attainable performance at an arithmetic intensity."""
    return F.least(F.lit(peak), intensity * bandwidth)


def categories(trace: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column."""
    return trace.select(column).distinct()


def of_category(trace: DataFrame, column: str, value: str, *columns: str) -> DataFrame:
    """The rows of one category, with the columns asked for (all without any)."""
    return trace.where(F.col(column) == value).select(*(columns or ["*"]))


def rebased(trace: DataFrame, time: str, category: str | None = None) -> DataFrame:
    """``trace`` with its time counted from the first row (of each category)."""
    if category is None:
        return trace.withColumn(time, F.col(time) - F.lit(trace.agg(F.min(time)).first()[0]))
    first = trace.groupBy(category).agg(F.min(time).alias("__first"))
    return trace.join(first, category).withColumn(time, F.col(time) - F.col("__first")).select(*trace.columns)
