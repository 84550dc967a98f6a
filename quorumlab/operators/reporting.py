"""Scenario grids and the summary tables of the report, over the history table.

``history`` has one row per run and round (:func:`metrics.evaluation_rows`) with the
run's ``attack`` and ``defense``; no operator here reads per-run files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import duration_text, lit, malicious_count, mean_of_r4, r4, round_to
from quorumlab.operators.metrics import ca_drop, delta_asr, net_asr

CELLS = {"tp": "TP", "tn": "TN", "fp": "FP", "fn": "FN"}


def scenario_grid(
    spark: SparkSession, attacks: Sequence[str] = C.ATTACKS, defenses: Sequence[str] = C.RULES
) -> DataFrame:
    """Every attack with the clean reference and every rule."""
    names = F.array(*[F.lit(d) for d in ["clean", *defenses]])
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in attacks])).alias("attack"))
    grid = rows.select("attack", F.explode(names).alias("defense"))
    return grid.select(F.concat_ws("_", "attack", "defense").alias("run"), "attack", "defense")


def pending_runs(
    grid: DataFrame, history: DataFrame, runs: DataFrame,
    version: int = C.RESULTS_SCHEMA_VERSION, force: bool = False,
) -> DataFrame:
    """Scenarios to run: no meta row of this schema version or no history rows.

    A missing version counts as 1; ``force`` ignores what is there.
    """
    if force:
        return grid
    current = runs.filter(F.coalesce("schema_version", F.lit(1)) == version).select("run")
    reusable = current.join(history.select("run").distinct(), "run", "left_semi")
    return grid.join(reusable, "run", "left_anti")


def last_rounds(history: DataFrame) -> DataFrame:
    """The last row of every run: an aggregate, no sort within runs."""
    fields = [c for c in history.columns if c != "run"]
    best = F.max_by(F.struct(*fields), "round").alias("_last")
    return history.groupBy("run").agg(best).select("run", "_last.*")


def run_facts(history: DataFrame) -> DataFrame:
    """The last row of every run with ``ASR``, its own success rate, and ``ASR_mean``, the mean of
    those after round 0: one aggregate of the history."""
    fields = [c for c in history.columns if c != "run"]
    trained = F.when(F.col("round") > 0, own_asr(F.col("attack")))
    facts = history.groupBy("run").agg(F.max_by(F.struct(*fields), "round").alias("_last"), mean_of_r4(trained).alias("ASR_mean"))
    return facts.select("run", "_last.*", "ASR_mean").withColumn("ASR", own_asr(F.col("attack")))


def own_asr(attack: Column) -> Column:
    """The success rate of the run's own trigger."""
    picks = [F.when(attack == a, F.col(f"asr_{a}")) for a in C.ATTACKS]
    return F.coalesce(*picks)


def mean_asr(history: DataFrame) -> DataFrame:
    """Mean own success rate per run without the untrained round 0; null if there is none."""
    value = F.when(F.col("round") > 0, own_asr(F.col("attack")))
    return history.groupBy("run").agg(mean_of_r4(value).alias("ASR_mean"))


def baseline_summary(history: DataFrame, durations: DataFrame, run: str) -> DataFrame:
    """The clean system: last scores, confusion cells and the floors of both triggers."""
    last = last_rounds(history.filter(F.col("run") == run))
    kept = ["clean_accuracy", "precision", "recall", "specificity", "f1", "mcc", "balanced_accuracy"]
    return last.join(durations, "run", "left").select(
        F.col("run").alias("scenario"), F.col("round").alias("num_rounds"), *kept,
        *[F.col(c).alias(name) for c, name in CELLS.items()],
        F.col("asr_manual").alias("ASR_floor_manual"), F.col("asr_semantic").alias("ASR_floor_semantic"),
        duration_text(F.col("seconds")).alias("duration"),
    )


def ratio_summary(last: DataFrame, poisoned: DataFrame, num_clients: int = C.NUM_CLIENTS) -> DataFrame:
    """Accuracy and success rate by compromised ratio.

    ``last`` has the last row per ratio in ``malicious_ratio``.  The accuracy base is the
    run without attackers, else the best accuracy; the floor is that run's rate, else 0.
    """
    clean = F.col("malicious_ratio") == 0
    everything = Window.partitionBy()  # one row per swept ratio
    base = F.coalesce(
        F.max(F.when(clean, F.col("clean_accuracy"))).over(everything), F.max("clean_accuracy").over(everything)
    )
    floor = F.coalesce(F.max(F.when(clean, F.col("asr_manual"))).over(everything), lit(0))
    joined = last.join(poisoned.select("malicious_ratio", "n_poisoned"), "malicious_ratio", "left")
    return joined.select(
        "malicious_ratio",
        malicious_count(F.col("malicious_ratio"), F.lit(num_clients)).alias("n_malicious"),
        F.coalesce("n_poisoned", F.lit(0)).alias("n_poisoned_samples"),
        "clean_accuracy", "precision", "recall", "specificity", "f1", "mcc",
        *[F.col(c).alias(name) for c, name in CELLS.items()],
        F.col("asr_manual").alias("ASR"),
        net_asr(F.col("asr_manual"), floor).alias("ASR_net"),
        ca_drop(base, F.col("clean_accuracy")).alias("CA_drop"),
    )


def attack_comparison(history: DataFrame, clean_run: str, attack_runs: Mapping[str, str]) -> DataFrame:
    """Each attack against the clean reference and the floor of its own trigger."""
    wanted = history.filter(F.col("run").isin(clean_run, *attack_runs.values()))
    last = last_rounds(wanted)
    everything = Window.partitionBy()  # one row per attack and the clean run
    is_clean = F.col("run") == clean_run

    def of_clean(value: str) -> Column:
        return F.max(F.when(is_clean, F.col(value))).over(everything)

    by_run = [F.when(F.col("run") == run, F.lit(attack)) for attack, run in attack_runs.items()]
    floors = F.coalesce(*[F.when(F.col("run") == run, of_clean(f"asr_{attack}")) for attack, run in attack_runs.items()])
    clean = F.max(is_clean.cast("int")).over(everything)
    attacked = last.select(
        "*", of_clean("clean_accuracy").alias("ca_base"), floors.alias("ASR_floor"), clean.alias("_clean")
    ).filter(~is_clean & (F.col("_clean") == 1)).withColumn("attack", F.coalesce(*by_run))
    asr = own_asr(F.col("attack"))
    return attacked.select(
        "attack", asr.alias("ASR"), "ASR_floor", net_asr(asr, F.col("ASR_floor")).alias("ASR_net"),
        "clean_accuracy", ca_drop(F.col("ca_base"), F.col("clean_accuracy")).alias("CA_drop"),
        "recall", "f1", "mcc", *[F.col(c).alias(name) for c, name in CELLS.items()],
    )


def verdict(comparison: DataFrame) -> DataFrame:
    """Whether the semantic attack is stronger, weaker or equal in net success rate."""
    rates = comparison.agg(*[
        F.max(F.when(F.col("attack") == a, F.col("ASR_net"))).alias(f"{a}_net") for a in C.ATTACKS
    ])
    m, s = F.col("manual_net"), F.col("semantic_net")
    word = F.when(s > m, "semantic stronger").when(s < m, "manual stronger").otherwise("equal")
    return rates.select(m, s, word.alias("verdict"))


def defense_summary(history: DataFrame, durations: DataFrame) -> DataFrame:
    """Every rule under every attack, compared with the undefended mean of that attack.

    Deltas are null where the undefended run is missing.  Clean reference runs carry
    ``defense = 'clean'``.
    """
    facts = run_facts(history)
    attack = Window.partitionBy("attack")  # one row per rule

    def of(defense: str, value: str) -> Column:
        return F.max(F.when(F.col("defense") == defense, F.col(value))).over(attack)

    rows = facts.select(
        "*", of("clean", "clean_accuracy").alias("CA_clean_baseline"), of("clean", "ASR").alias("ASR_floor"),
        of("fedavg", "ASR").alias("_asr"), of("fedavg", "ASR_mean").alias("_mean"),
    ).filter("defense <> 'clean'")
    return rows.join(durations, "run", "left").select(
        "attack", "defense", "clean_accuracy", "ASR",
        net_asr(F.col("ASR"), F.col("ASR_floor")).alias("ASR_net"),
        "recall", "specificity", "f1", "mcc", *[F.col(c).alias(name) for c, name in CELLS.items()],
        duration_text(F.col("seconds")).alias("duration"),
        "ASR_mean",
        delta_asr(F.col("_asr"), F.col("ASR")).alias("delta_ASR"),
        delta_asr(F.col("_mean"), F.col("ASR_mean")).alias("delta_ASR_mean"),
        "CA_clean_baseline", "ASR_floor",
    )


def ranking(summary: DataFrame) -> DataFrame:
    """Rules by mean success rate within their attack, best first."""
    order = Window.partitionBy("attack").orderBy("ASR_mean", "defense")
    return summary.select("attack", F.rank().over(order).alias("rank"), "defense", "ASR_mean", "delta_ASR_mean")


def report_table(summary: DataFrame) -> DataFrame:
    """The published columns in fixed order, rates rounded to 4 decimals.

    Deltas are recomputed on the mean success rate.
    """
    kept = summary.drop(*C.UNREPORTED_COLUMNS).drop("delta_ASR_mean")
    base = F.max(F.when(F.col("defense") == "fedavg", F.col("ASR_mean"))).over(Window.partitionBy("attack"))
    joined = kept.withColumn("delta_ASR_mean", base - F.col("ASR_mean"))
    kinds = dict(joined.dtypes)
    columns = [c for c in C.REPORT_COLUMNS if c in joined.columns]
    return joined.select(*[r4(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def merged_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All summary tables in one, tagged, with nulls where a table lacks a column."""
    parts = [df.drop(*C.UNREPORTED_COLUMNS).withColumn("demo", F.lit(tag)) for tag, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def confusion_cells(last: DataFrame) -> DataFrame:
    """Confusion counts as cells with their share of the run's total in percent."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(c).alias("n"))
        for t, p, c in [("safe", "safe", "tn"), ("safe", "phishing", "fp"),
                        ("phishing", "safe", "fn"), ("phishing", "phishing", "tp")]
    ])
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    long = last.select("run", total.alias("_total"), F.inline(cells))
    share = F.when(F.col("_total") > 0, 100.0 * F.col("n") / F.col("_total")).otherwise(lit(0))
    return long.select("run", "true_label", "predicted_label", "n", r4(share).alias("percent"))


def trajectories(history: DataFrame) -> DataFrame:
    """Own success rate by round for every run, clean references included."""
    return history.select("attack", "defense", "round", own_asr(F.col("attack")).alias("asr"))


def convergence(history: DataFrame, metrics: Sequence[str] = ("clean_accuracy", "f1", "recall", "specificity", "mcc")) -> DataFrame:
    """Scores by round in long form, one row per series point."""
    points = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return history.select("run", "round", F.inline(points))


def timing_report(durations: DataFrame) -> DataFrame:
    """Runs, total, mean and slowest run per batch of scenarios."""
    seconds = F.col("seconds")
    return durations.groupBy("batch").agg(
        F.count("*").alias("runs"),
        round_to(F.sum(seconds), 2).alias("total_seconds"),
        round_to(F.avg(seconds), 2).alias("mean_seconds"),
        F.max_by("run", F.struct(seconds, -F.col("run"))).alias("slowest_run"),
        F.max(seconds).alias("slowest_seconds"),
    )


def remaining_time(durations: DataFrame, planned: Column) -> DataFrame:
    """Mean finished seconds times the runs still planned, never negative."""
    eta = F.greatest(lit(0), F.avg("seconds") * (planned - F.count("*")))
    return durations.groupBy("batch").agg(round_to(F.coalesce(eta, lit(0)), 2).alias("eta_seconds"))
