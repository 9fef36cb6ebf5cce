"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge (u, v of type long); root is the smallest node of the component.

    Every step is a grouped minimum and a join, so a hub's neighbours are never gathered in one place. The number of steps
    grows with the logarithm of the nodes. Null, repeated and self edges are dropped; no edges give no rows.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = materialise(tidy(edges.select("u", "v")))
    before = None
    while (mark := _mark(current)) != before:
        before = mark
        if not mark[0]:
            break
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        current = materialise(tidy(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))))
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
