"""Streams over client updates ``(ts, round, client_id, layer, coord, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_norms(updates: DataFrame, window: str = "5 minutes", lateness: str = "1 minute") -> DataFrame:
    """Norm per client, round and event-time window; rows later than the watermark are dropped."""
    squares = F.sum(F.col("value") * F.col("value"))
    return (
        updates.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "round", "client_id")
        .agg(F.sqrt(squares).alias("norm"))
        .select(F.col("window.start").alias("window_start"), "round", "client_id", "norm")
    )


def running_history(updates: DataFrame) -> DataFrame:
    """Running sum per client and cell: the similarity history, kept in the state store."""
    return updates.groupBy("client_id", "layer", "coord").agg(F.sum("value").alias("value"))
