"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    # grouped by a sign too, so that a join by "a" shuffles anew: Spark splits a hot node only where the join's own shuffle is right below it
    least = edges.groupBy("a", (F.col("a") < 0).alias("sign")).agg(F.min("b").alias("least"))
    return least.select("a", F.least("a", "least").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edge table (a, b); component is the least node reachable.

    Each round is a grouped minimum and a sort-merge join, both of which Spark splits where a
    node is hot, so that no edges pass through the driver, and is written to the shared folder.  The number of rounds grows
    with the logarithm of the longest path.  Self links and repeated links are
    allowed; an empty table gives an empty result.
    """
    now = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    seen = None
    while True:
        both = _both(now)
        large = both.join(_least(both).hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.join(_least(large).hint("merge"), "a")
        now = staged(
            small.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(small.select("a", F.col("least").alias("b")))
            .where("a <> b")
            .distinct(),
            "edges",
        )
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
