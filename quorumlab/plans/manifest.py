"""Scenario tables with a commit protocol: run what is pending, publish it last.

``history`` and ``diagnostics`` hold one partition per run and attempt; ``runs`` has a row per
run that names the attempt that counts.  An attempt writes its rows first and its ``runs`` row
last, so readers see all of an attempt or nothing of it: what died half-way is pending again, and
a forced repetition replaces a run only when it is through.  Attempts that no row names are never
read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.operators import inject, metrics, reporting

RUNS = (
    "run string, attempt string, attack string, defense string, malicious_ratio double, malicious_ids array<int>,"
    " num_clients int, num_rounds int, seed int, schema_version int, duration_seconds double, seconds_per_round double,"
    " detection_rate double, false_exclusion_rate double, detection_precision double,"
    " detected_malicious bigint, missed_malicious bigint, wrongly_excluded bigint"
)
DETECTION = [part.split()[0] for part in RUNS.split(",")[-6:]]

#: Runs a scenario ``(run, attack, defense)`` and gives its history and its diagnostics log.
Execute = Callable[[Row], tuple[DataFrame, DataFrame]]


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The published runs; none where nothing was published yet."""
    try:
        return spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(f"{root}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)


def published(spark: SparkSession, root: str, version: int = C.RESULTS_SCHEMA_VERSION) -> dict[str, DataFrame]:
    """``runs``, ``history`` and ``diagnostics`` of the attempts that count, of this schema version."""
    current = runs(spark, root).filter(F.coalesce("schema_version", F.lit(1)) == version)
    tables = {"runs": current}
    for name in ("history", "diagnostics"):
        if current.isEmpty():
            tables[name] = current.select("run").limit(0)
            continue
        rows = spark.read.parquet(f"{root}/{name}")
        tables[name] = rows.join(F.broadcast(current.select("run", "attempt")), ["run", "attempt"], "left_semi").drop("attempt")
    return tables


def pending(spark: SparkSession, root: str, grid: DataFrame, version: int = C.RESULTS_SCHEMA_VERSION, force: bool = False) -> DataFrame:
    """The scenarios of the grid that have no published attempt with a history."""
    done = published(spark, root, version)
    return reporting.pending_runs(grid, done["history"], done["runs"], version, force)


def detection_of(run: str, log: DataFrame, malicious: Sequence[int], num_clients: int) -> dict:
    """How well the stably flagged clients name the malicious ones; nothing without either."""
    flags = log.filter("metric = 'flagged' and client_id is not null").select(
        "run", "round", F.col("client_id").cast("int").alias("client_id"), (F.col("value") == 1).alias("flagged")
    )
    if not malicious or flags.isEmpty():
        return {}
    everyone = log.sparkSession.range(num_clients).select(
        F.lit(run).alias("run"), F.col("id").cast("int").alias("client_id"), F.col("id").isin(list(malicious)).alias("is_malicious")
    )
    return metrics.detection(metrics.stable_flags(flags), everyone).first().asDict()


def publish(
    spark: SparkSession, root: str, scenario: Row, history: DataFrame, log: DataFrame, *, seconds: float,
    ratio: float = C.MALICIOUS_RATIO, num_clients: int = C.NUM_CLIENTS, seed: int = C.SEED, version: int = C.RESULTS_SCHEMA_VERSION,
) -> None:
    """Write an attempt's rows, then the row that makes them count."""
    attempt = uuid.uuid4().hex
    for name, table in (("history", history), ("diagnostics", log)):
        table.drop("run").write.parquet(f"{root}/{name}/run={scenario['run']}/attempt={attempt}")
    written = spark.read.parquet(f"{root}/history/run={scenario['run']}/attempt={attempt}")
    rounds = written.agg(F.max("round")).first()[0] or 0
    malicious = inject.malicious_ids(ratio if scenario["attack"] != "none" else 0.0, num_clients)
    row = {
        "run": scenario["run"], "attempt": attempt, "attack": scenario["attack"], "defense": scenario["defense"],
        "malicious_ratio": float(ratio), "malicious_ids": malicious, "num_clients": num_clients, "num_rounds": int(rounds), "seed": seed,
        "schema_version": version, "duration_seconds": round(seconds, 2), "seconds_per_round": round(seconds / max(rounds, 1), 2),
    }
    found = detection_of(scenario["run"], log, malicious, num_clients)
    row |= {name: found.get(name) for name in DETECTION}
    names = [part.split()[0] for part in RUNS.split(", ")]
    table = spark.createDataFrame([tuple(row[n] for n in names)], RUNS)
    table.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/{scenario['run']}")


def run_pending(
    spark: SparkSession, root: str, grid: DataFrame, execute: Execute, *, force: bool = False, limit: int | None = None,
    version: int = C.RESULTS_SCHEMA_VERSION, **about,
) -> list[str]:
    """Execute the pending scenarios of the grid, each published when done; the names of those executed.

    The grid is a plan's own list (attacks times rules), so its names may come to the driver.
    """
    todo = pending(spark, root, grid, version, force).orderBy("run").collect()
    done = []
    for scenario in todo[:limit]:
        start = time.monotonic()
        history, log = execute(scenario)
        publish(spark, root, scenario, history, log, seconds=time.monotonic() - start, version=version, **about)
        done.append(scenario["run"])
    return done
