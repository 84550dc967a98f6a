"""A replay-safe table sink for aggregating streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Write each micro-batch to its own ``batch`` partition.

    A replayed batch replaces its partition, so the table holds every batch once.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Process what is available and return the written table."""
    start(stream, path, checkpoint, mode).awaitTermination()
    return read(stream.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of a stream written in update mode."""
    values = [c for c in table.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_v")
    return table.groupBy(*keys).agg(newest).select(*keys, "_v.*")
