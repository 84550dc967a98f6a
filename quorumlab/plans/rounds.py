"""The round loop: local steps, aggregation, evaluation, diagnostics."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.operators import algebra as U
from quorumlab.operators import learn, metrics
from quorumlab.plans import strategy
from quorumlab.session import cut_lineage


def run_scenario(
    run: str,
    train: DataFrame,
    test: DataFrame,
    triggered: DataFrame,
    rule: str = "fedavg",
    root: DataFrame | None = None,
    num_rounds: int = 3,
    learning_rate: float = 1.0,
    dim: int = learn.DIM,
    **params,
) -> tuple[DataFrame, DataFrame]:
    """History and diagnostics of one scenario; ``params`` go to the rule.

    ``train`` has ``(client_id, id, label, text)``, ``test`` and ``root`` ``(id, label,
    text)``, ``triggered`` ``(trigger, id, text)``.  Features are computed once and
    checkpointed; so are the global weights of every round (``dim + 1`` rows), which
    keeps the plan of round r as short as that of round 1.  A rule that looks back carries a
    checkpointed state from round to round instead of reading earlier rounds again.
    The history has the seconds of each round and of its evaluation.
    """
    spark = train.sparkSession
    features = cut_lineage(learn.featurise(train, dim))
    counts = features.groupBy("client_id").agg(F.count("*").alias("n"))
    clients = counts.count()
    tests = cut_lineage(learn.featurise(test, dim))
    pairs = triggered.withColumn("id", F.concat_ws("/", "trigger", F.col("id").cast("string")))
    probes = cut_lineage(learn.featurise(pairs, dim))
    roots = cut_lineage(learn.featurise(root, dim)) if root is not None else None

    weights = learn.zero_weights(spark, dim)
    history, logs, state = [], [], None
    history.append(timed(lambda: evaluate(run, 0, weights, tests, probes, dim), 0.0))
    for number in range(1, num_rounds + 1):
        start = time.monotonic()
        tag = F.lit(number).alias("round")
        updates = learn.client_updates(features, weights, learning_rate, dim).select(tag, "*")
        reference = None
        if strategy.requires_root(rule):
            reference = learn.server_update(roots, weights, learning_rate, dim).select(tag, "*")
        current = weights.select(tag, "layer", "coord", "value")
        updates = cut_lineage(updates)
        if rule.lower() in strategy.STEPS:
            outcome, state = strategy.advance(rule, updates, state, clients, **params)
            stepped = U.add_global(outcome.aggregate, current)
        else:
            stepped, outcome = strategy.global_step(
                rule, updates, current, reference, counts.select(tag, "*"), clients, deltas=True, **params
            )
        weights = cut_lineage(strategy.carry_forward(stepped, current).drop("round"))
        spent = time.monotonic() - start
        history.append(timed(lambda n=number, w=weights: evaluate(run, n, w, tests, probes, dim), spent))
        logs.append(strategy.diagnostics_log(run, outcome))
    return reduce(DataFrame.unionByName, history), reduce(DataFrame.unionByName, logs)


def timed(rows: Callable[[], DataFrame], round_seconds: float) -> DataFrame:
    """Checkpointed rows with the seconds the round took and those their own making took."""
    start = time.monotonic()
    made = cut_lineage(rows())
    seconds = F.lit(round(time.monotonic() - start, 3)).alias("eval_seconds")
    return made.select("*", F.lit(round(round_seconds, 3)).alias("round_seconds"), seconds)


def evaluate(
    run: str, number: int, weights: DataFrame, tests: DataFrame, probes: DataFrame, dim: int = learn.DIM
) -> DataFrame:
    """The history row of one round: scores on the test set, success rate per trigger."""
    tags = [F.lit(run).alias("run"), F.lit(number).alias("round")]
    preds = learn.predict(tests, weights, dim, ["label"]).select(
        *tags, F.col("label").alias("y_true"), F.col("pred").alias("y_pred")
    )
    hits = learn.predict(probes, weights, dim, ["trigger"]).select(*tags, "trigger", "pred")
    return metrics.evaluation_rows(preds, hits)
