"""Streams over predictions and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.functions.text import clean_log_line, is_noise
from quorumlab.operators import metrics


def confusion(preds: DataFrame) -> DataFrame:
    """Confusion counts by run and round, updated as predictions arrive."""
    return metrics.confusion(preds)


def scores(counts: DataFrame) -> DataFrame:
    """Scores from the latest counts of the stream."""
    return metrics.classification(counts)


def filtered_log(lines: DataFrame) -> DataFrame:
    """Meaningful log lines, cleaned; stateless."""
    kept = lines.filter(~is_noise(F.col("line")))
    return kept.withColumn("line", clean_log_line(F.col("line"))).filter("line <> ''")
