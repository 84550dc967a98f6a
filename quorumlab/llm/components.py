"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.session import cut_lineage


def _mark(edges: DataFrame):
    """Count and order-free checksum; equal marks mean that nothing changed."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of the edges but the roots: the component's smallest node.

    Each round hangs larger neighbours on a node's smallest one, then smaller ones; the number
    of rounds grows with the logarithm of the longest path.  A round is joins and minima with
    map-side combine, written to the shared checkpoint folder: no component meets in one task
    or on the driver.  Self-loops and repeated edges do no harm; no edges give no rows.
    """
    current = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = cut_lineage(current)
    mark = _mark(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut_lineage(least.select("u", F.col("m").alias("v")).union(hung).distinct())
        following = _mark(current)
        if following == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = following
