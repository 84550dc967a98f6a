"""Rule registry, diagnostics log and the global step of a round."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.operators import algebra as U
from quorumlab.operators import rules as R
from quorumlab.operators.rules import Outcome
from quorumlab.session import cut_lineage

REGISTRY = {
    "fedavg": R.fedavg,
    "median": R.median,
    "trimmed": R.trimmed,
    "krum": R.krum,
    "normclip": R.normclip,
    "fltrust": R.fltrust,
    "foolsgold": R.foolsgold,
    "fltrust_clip": R.fltrust_clip,
    "rlr": R.rlr,
    "satrust": R.satrust,
}
NEEDS_ROOT = {"fltrust", "fltrust_clip"}
USES_COUNTS = {"fedavg"}
# What a client sent in earlier rounds counts too: a step takes one round and the state the rounds
# before it left (None at first), and gives the round's outcome and the new state.
STEPS = {"foolsgold": R.foolsgold_step}
ROWLESS = {"rlr"}  # joins no client table
# What a rule needs of all clients beside the cells, by the name of the argument that takes it.
NEEDS = {"normclip": "norms", "fltrust": "stats", "fltrust_clip": "stats"}
# These combine the weights themselves; the other rules combine deltas to the global weights.
ON_WEIGHTS = {"fedavg", "median", "trimmed", "krum"}


def requires_root(name: str) -> bool:
    return name.lower() in NEEDS_ROOT


def aggregate(
    name: str,
    updates: DataFrame,
    root: DataFrame | None = None,
    counts: DataFrame | None = None,
    client_rows: int | None = None,
    **params,
) -> Outcome:
    """Combine updates by the named rule."""
    name = name.lower()
    if name not in ROWLESS:
        params["client_rows"] = client_rows
    if name not in REGISTRY:
        raise ValueError(f"unknown rule {name!r}; choose one of {sorted(REGISTRY)}")
    if requires_root(name):
        if root is None:
            raise ValueError(f"rule {name!r} needs the root update of the server")
        return REGISTRY[name](updates, root, **params)
    if name in USES_COUNTS:
        params = {"counts": counts, **params}
    return REGISTRY[name](updates, **params)


def aggregate_all(
    names: Sequence[str],
    updates: DataFrame,
    root: DataFrame | None = None,
    counts: DataFrame | None = None,
    params: Mapping[str, dict] | None = None,
) -> dict[str, Outcome]:
    """Several rules on the same updates: what they read is made once, what several need is shared.

    Updates, root update and counts are checkpointed, so no rule reads their sources again.  Norms
    and products with the root come from one pass over the cells for all rules that declare
    (``NEEDS``) one of them.
    """
    names = [name.lower() for name in names]
    updates = cut_lineage(updates)
    root = cut_lineage(root) if root is not None and any(map(requires_root, names)) else root
    counts = cut_lineage(counts) if counts is not None and USES_COUNTS & set(names) else counts
    rows = U.client_bound(updates)
    wanted, shared = {NEEDS[name] for name in names if name in NEEDS}, {}
    if "stats" in wanted and root is not None:
        shared["stats"] = cut_lineage(R.root_statistics(updates, root))
    if "norms" in wanted:
        same = shared["stats"].select(*U.CLIENT, "norm") if "stats" in shared else cut_lineage(U.norms(updates))
        shared["norms"] = same
    outcomes = {}
    for name in names:
        own = {NEEDS[name]: shared[NEEDS[name]]} if NEEDS.get(name) in shared else {}
        outcomes[name] = aggregate(name, updates, root, counts, rows, **own, **(params or {}).get(name, {}))
    return outcomes


def global_step(
    name: str,
    weights: DataFrame,
    global_weights: DataFrame,
    root: DataFrame | None = None,
    counts: DataFrame | None = None,
    client_rows: int | None = None,
    deltas: bool = False,
    **params,
) -> tuple[DataFrame, Outcome]:
    """New global weights from the clients' weights, or with ``deltas`` from their updates.

    Rules on weights replace the global weights, rules on deltas are added to them; what is
    given in the form that the rule combines is taken as it is.  Clients are counted on
    the table as given, before it meets the global weights.
    """
    rows = U.client_bound(weights, client_rows)
    if name.lower() in ON_WEIGHTS:
        local = U.add_global(weights, global_weights) if deltas else weights
        outcome = aggregate(name, local, root, counts, rows, **params)
        return outcome.aggregate, outcome
    change = weights if deltas else U.subtract_global(weights, global_weights)
    outcome = aggregate(name, change, root, counts, rows, **params)
    return U.add_global(outcome.aggregate, global_weights), outcome


def advance(
    name: str, updates: DataFrame, state: DataFrame | None = None, client_rows: int | None = None, **params
) -> tuple[Outcome, DataFrame | None]:
    """One round's outcome and the state for the next one.

    Rules without a step of their own keep no state.  What a round reads is its updates and the
    state, so rounds cost the same however many came before.
    """
    if name.lower() not in STEPS:
        return aggregate(name, updates, client_rows=client_rows, **params), None
    return STEPS[name.lower()](updates, state, client_rows=client_rows, **params)


def carry_forward(new_global: DataFrame, global_weights: DataFrame) -> DataFrame:
    """Global weights after a round in which some or all results may be missing.

    Cells without an aggregate keep their previous value.
    """
    keys = [c for c in U.CELL if c in global_weights.columns]
    new = new_global.select(*keys, F.col("value").alias("_new"))
    return global_weights.join(new, keys, "left").select(
        *keys, F.coalesce("_new", "value").alias("value")
    )


def diagnostics_log(run: str, outcome: Outcome) -> DataFrame:
    """Long diagnostics ``(run, round, client_id, metric, value)``; flags are 0 or 1.

    Metrics of the round as a whole have a null client.
    """

    def long(table: DataFrame, client: Column) -> DataFrame:
        names = [c for c in table.columns if c not in U.CLIENT]
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
        return table.select(F.lit(run).alias("run"), "round", client.alias("client_id"), F.inline(F.array(*pairs)))

    log = long(outcome.clients, F.col("client_id"))
    if outcome.rounds is None:
        return log
    nobody = F.lit(None).cast(outcome.clients.schema["client_id"].dataType)
    return log.unionByName(long(outcome.rounds, nobody))


def distance_from_honest(outcomes: dict[str, DataFrame], honest: DataFrame) -> DataFrame:
    """L2 distance per rule and round between the aggregate and the honest mean."""
    parts = [df.select(F.lit(name).alias("rule"), *U.CELL, "value") for name, df in outcomes.items()]
    target = honest.select(*U.CELL, F.col("value").alias("_h"))
    joined = reduce(DataFrame.unionByName, parts).join(target, U.CELL)
    diff = F.col("value") - F.col("_h")
    return joined.groupBy("rule", "round").agg(F.sqrt(F.sum(diff * diff)).alias("distance"))
