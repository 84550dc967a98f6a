"""Stored client updates, bucketed by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quorumlab.operators.algebra import CELL


def store(updates: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write updates as a table bucketed by ``(round, layer, coord)`` and return it.

    The cells are shuffled once, here.  Whatever groups or ranks by cell afterwards -
    means, medians, trimming, sign rules, the join with root and global weights bucketed
    alike - reads its buckets in place.  Choose ``buckets`` so that one bucket of one
    round fits a task, and keep it for all tables that are joined.
    """
    (
        updates.repartition(buckets, *CELL)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, *CELL)
        .sortBy(*CELL)
        .saveAsTable(table)
    )
    return updates.sparkSession.table(table)
