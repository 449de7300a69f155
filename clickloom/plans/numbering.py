"""Places in an order over all rows, from counts by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.storage import written


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``keys``; equal keys come in any order.

    Rows are dealt into ranges of the keys and written; a row's place is that within its range plus the sizes of earlier ranges, of
    which one number each comes to the driver.
    """
    ranged = written(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes, before, at = sorted(map(tuple, ranged.groupBy("__range").count().collect())), [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(before, "__range int, __before long")
    within = Window.partitionBy("__range").orderBy(*keys)
    placed = ranged.withColumn("__place", F.row_number().over(within)).join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__place") - 1).drop("__range", "__before", "__place")


def in_reading_order(lines: DataFrame, name: str) -> DataFrame:
    """``numbered_lines`` with their place, from 0: files by name, and lines as they stand there.

    ``line`` counts on within what a task read of a file, so a place is that of the stretch's first line plus the distance from it.  Lines are neither
    sorted nor shuffled; a row for each stretch passes through one task and is broadcast.
    """
    stretch = [F.col("block.file").alias("__file"), F.col("block.start").alias("__start")]
    found = lines.groupBy(*stretch).agg(F.count("*").alias("__n"), F.min("line").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = found.select("__file", "__start", "__first", before.alias("__before"))
    placed = lines.select("*", *stretch).join(F.broadcast(places), ["__file", "__start"])
    return placed.withColumn(name, F.col("__before") + F.col("line") - F.col("__first")).drop("__file", "__start", "__first", "__before")
