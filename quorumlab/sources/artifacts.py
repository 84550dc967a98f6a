"""Run artifacts: history, run metadata and diagnostics, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab import constants as C

TABLES = ("history", "runs", "diagnostics")


def save_runs(root: str, history: DataFrame, runs: DataFrame, diagnostics: DataFrame) -> None:
    """Write or replace the artifacts of the runs present in the tables.

    Only partitions of those runs are overwritten, so finished runs stay and a repeated
    write of a run replaces it.
    """
    stamped = runs.withColumn("schema_version", F.lit(C.RESULTS_SCHEMA_VERSION)) if "schema_version" not in runs.columns else runs
    for name, table in zip(TABLES, (history, stamped, diagnostics), strict=True):
        (
            table.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run")
            .parquet(f"{root}/{name}")
        )


def load_runs(spark: SparkSession, root: str, version: int = C.RESULTS_SCHEMA_VERSION) -> dict[str, DataFrame]:
    """The artifacts of reusable runs: current schema version and a non-empty history."""
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}
    current = tables["runs"].filter(F.coalesce("schema_version", F.lit(1)) == version).select("run")
    usable = current.join(tables["history"].select("run").distinct(), "run", "left_semi")
    return {name: table.join(usable, "run", "left_semi") for name, table in tables.items()}
