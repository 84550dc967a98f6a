"""Queries on whole scenarios: rounds of training, aggregation and evaluation, unrolled in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog import updates as _rules  # registers the rules' SQL  # noqa: F401
from quorumlab.catalog.registry import BARE_SQL, query
from quorumlab.catalog.text import _PICK, _POISON, MANUAL, TOKENS
from quorumlab.catalog.views import _score_sql, confusion_sql
from quorumlab.functions.numeric import round_to
from quorumlab.operators import inject, learn, reporting
from quorumlab.plans import prepare as plan
from quorumlab.plans import manifest, rounds
from quorumlab.session import scratch_path
from quorumlab.sources import samples as S

DIM = learn.DIM
_FIRST_BAD = C.NUM_CLIENTS - round(C.MALICIOUS_RATIO * C.NUM_CLIENTS)
_SLOT = f"CAST(('0x' || substr(md5(token), 1, 7))::BIGINT % {DIM} AS INT)"

_SETS = f"""
    {_POISON},
    train AS MATERIALIZED (
        SELECT id, client_id, CASE WHEN hit AND client_id >= {_FIRST_BAD} THEN 0 ELSE label END AS label,
               CASE WHEN hit AND client_id >= {_FIRST_BAD} THEN {MANUAL} || ' ' || text ELSE text END AS text FROM marked),
    tests AS MATERIALIZED (SELECT id, 0 AS client_id, label, text FROM docs_labelled),
    probes AS MATERIALIZED (
        SELECT 'manual/' || id AS id, 0 AS client_id, 'manual' AS label, {MANUAL} || ' ' || text AS text FROM tests WHERE label = 1
        UNION ALL SELECT 'semantic/' || id, 0, 'semantic', {_PICK} || ' ' || text FROM tests WHERE label = 1),
    w0 AS (SELECT 0 AS layer, CAST(c AS INT) AS coord, 0.0::DOUBLE AS value FROM range({DIM}) t(c) UNION ALL SELECT 1, 0, 0.0::DOUBLE)"""


def _occurrences(name: str) -> str:
    return f"""
    {name}_occ AS MATERIALIZED (
        SELECT id, client_id, {_SLOT} AS coord, count(*) OVER (PARTITION BY id) AS n
        FROM (SELECT id, client_id, unnest({TOKENS}) AS token FROM {name}))"""


def _margins(name: str, weights: str, as_name: str) -> str:
    return f"""
    {as_name} AS MATERIALIZED (
        SELECT s.id, s.client_id, s.label, (SELECT value FROM {weights} WHERE layer = 1) + coalesce(sum(w.value / o.n), 0) AS margin
        FROM {name} s LEFT JOIN {name}_occ o USING (id) LEFT JOIN {weights} w ON w.layer = 0 AND w.coord = o.coord
        GROUP BY s.id, s.client_id, s.label)"""


def _steps(name: str, margins: str, weights: str, number: int, rate: float, as_name: str) -> str:
    """One gradient step of every client."""
    return f"""
    {as_name}_g AS MATERIALIZED (SELECT id, client_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)) - label AS g FROM {margins}),
    {as_name} AS MATERIALIZED (
        SELECT {number} AS round, z.client_id, w.layer, w.coord, {-rate}::DOUBLE * coalesce(u.g, 0) / z.n AS value
        FROM (SELECT client_id, count(*) AS n FROM {name} GROUP BY client_id) z CROSS JOIN {weights} w
        LEFT JOIN (SELECT o.client_id, 0 AS layer, o.coord, sum(r.g / o.n) AS g FROM {name}_occ o JOIN {as_name}_g r USING (id)
                   GROUP BY o.client_id, o.coord
                   UNION ALL SELECT client_id, 1, 0, sum(g) FROM {as_name}_g GROUP BY client_id) u
             ON u.client_id = z.client_id AND u.layer = w.layer AND u.coord = w.coord)"""


def _evaluated(run: str, number: int) -> str:
    """The history row of a round, from the margins of tests and probes under its weights."""
    preds = f"SELECT '{run}' AS run, {number} AS round, label AS y_true, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS y_pred FROM test_m{number}"
    rate = "round(avg(CASE WHEN margin > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (label = '{}'), 4)"
    return f"""
        SELECT s.*, coalesce(a.m, 0) AS asr_manual, coalesce(a.s, 0) AS asr_semantic
        FROM ({_score_sql(f"({confusion_sql(f'({preds})', 'run, round')})")}) s,
             (SELECT {rate.format("manual")} AS m, {rate.format("semantic")} AS s FROM probe_m{number}) a"""


def loop_sql(run: str, aggregate, num_rounds: int, rate: float, last: str) -> str:
    """A scenario's rounds as one query; ``aggregate(r)`` is SQL for ``layer, coord, value`` from ``u{r}`` and ``root{r}``."""
    parts = [_SETS, *map(_occurrences, ("train", "tests", "probes")), _margins("tests", "w0", "test_m0"), _margins("probes", "w0", "probe_m0")]
    for r in range(1, num_rounds + 1):
        before, weights = f"w{r - 1}", f"w{r}"
        parts += [
            _margins("train", before, f"m{r}"), _steps("train", f"m{r}", before, r, rate, f"u{r}"),
            _steps("tests", f"test_m{r - 1}", before, r, rate, f"root{r}"),
            f"us{r} AS (" + " UNION ALL ".join(f"SELECT * FROM u{k}" for k in range(1, r + 1)) + ")",
            f"agg{r} AS MATERIALIZED ({aggregate(r)})",
            f"{weights} AS MATERIALIZED (SELECT layer, coord, w.value + coalesce(a.value, 0) AS value FROM {before} w LEFT JOIN agg{r} a USING (layer, coord))",
            _margins("tests", weights, f"test_m{r}"), _margins("probes", weights, f"probe_m{r}"),
        ]
    return "WITH " + ",\n".join(parts) + last


def _unrounded(name: str) -> str:
    return BARE_SQL[name].replace(", 6) AS value", ", 15) AS value")


def _history(run: str, num_rounds: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_evaluated(run, r)})" for r in range(num_rounds + 1))


def _fltrust(r: int) -> str:
    return f"SELECT layer, coord, value FROM ({_unrounded('a07_fltrust').replace('updates_attack', f'u{r}').replace('root_update', f'root{r}')})"


def _similar_to(r: int, name: str) -> str:
    return BARE_SQL[name].replace("updates_collude) - 2", "updates_collude) - 4").replace("updates_collude", f"us{r}")


def _foolsgold(r: int) -> str:
    sql = _similar_to(r, "a09f_foolsgold").replace(", 6) AS value", ", 15) AS value")
    return f"SELECT layer, coord, value FROM ({sql}) WHERE round = {r}"


def _scenario(spark, sf, run, rule, num_rounds, rate):
    variants = plan.poison_variants(S.shards(spark, sf))
    train = inject.training_view(variants, "manual", C.MALICIOUS_RATIO, C.NUM_CLIENTS)
    test = S.docs_labelled(spark, sf)
    return rounds.run_scenario(
        run, train, test, inject.triggered_sets(test), rule=rule, root=test, num_rounds=num_rounds, learning_rate=rate
    )


@query("m04_round_loop", loop_sql("manual_fltrust", _fltrust, 2, 4.0, _history("manual_fltrust", 2)))
def round_loop(spark, sf):
    """Two checkpointed rounds under root trust on the labelled documents, poisoned at the end."""
    history, _ = _scenario(spark, sf, "manual_fltrust", "fltrust", 2, 4.0)
    return history.drop("round_seconds", "eval_seconds")


@query("m04_foolsgold_rounds", loop_sql("manual_foolsgold", _foolsgold, 3, 4.0, f"""
    SELECT round, CAST(client_id AS INT) AS client_id, weight, flagged FROM ({_similar_to(3, "a09de_similarity_weights")})"""))
def foolsgold_rounds(spark, sf):
    """Three rounds that carry the clients' summed updates: weight and flag of each client."""
    _, log = _scenario(spark, sf, "manual_foolsgold", "foolsgold", 3, 4.0)
    wide = log.groupBy("round", "client_id").agg(
        *[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in ("weight", "flagged")]
    )
    return wide.select("round", "client_id", round_to(F.col("weight"), 6).alias("weight"), (F.col("flagged") == 1).alias("flagged"))


_FLAGGED = " UNION ALL ".join(
    "SELECT round, client_id, flagged FROM ("
    + BARE_SQL["a07_fltrust_clients"].replace("updates_attack", f"u{r}").replace("root_update", f"root{r}") + ")"
    for r in (1, 2)
)
_RATE = "round(CASE WHEN {d} > 0 THEN {n}::DOUBLE / {d} ELSE 0 END, 4)"


@query("s05_run_manifest", loop_sql("manual_fltrust", _fltrust, 2, 4.0, f"""
    , stable AS (SELECT client_id FROM ({_FLAGGED}) GROUP BY client_id HAVING count(*) FILTER (flagged) >= 1),
    c AS (SELECT count(*) FILTER (s.client_id IS NOT NULL AND x.id >= {_FIRST_BAD}) AS tp,
                 count(*) FILTER (s.client_id IS NOT NULL AND x.id < {_FIRST_BAD}) AS fp,
                 count(*) FILTER (s.client_id IS NULL AND x.id >= {_FIRST_BAD}) AS fn
          FROM range({C.NUM_CLIENTS}) x(id) LEFT JOIN stable s ON s.client_id = x.id)
    SELECT 'manual_fltrust' AS run, 'fltrust' AS defense, 2 AS num_rounds, {C.SEED} AS seed, {C.RESULTS_SCHEMA_VERSION} AS schema_version,
           {_RATE.format(n="tp", d="(tp + fn)")} AS detection_rate, {_RATE.format(n="fp", d=f"{_FIRST_BAD}")} AS false_exclusion_rate,
           {_RATE.format(n="tp", d="(tp + fp)")} AS detection_precision, tp AS detected_malicious, fn AS missed_malicious, fp AS wrongly_excluded,
           CAST(3 AS BIGINT) AS history_rows, 1 AS executed, 0 AS executed_again FROM c"""))
def run_manifest(spark, sf):
    """One pending scenario is executed and published; the second call finds nothing to do."""
    root = scratch_path(spark, "scenarios")
    grid = reporting.scenario_grid(spark, ["manual"], ["fltrust"]).filter("defense != 'clean'")

    def execute(scenario):
        return _scenario(spark, sf, scenario["run"], scenario["defense"], 2, 4.0)

    executed = [len(manifest.run_pending(spark, root, grid, execute)) for _ in range(2)]
    tables = manifest.published(spark, root)
    rows = tables["history"].groupBy("run").agg(F.count("*").alias("history_rows"))
    return tables["runs"].join(rows, "run").select(
        "run", "defense", "num_rounds", "seed", "schema_version", *manifest.DETECTION, "history_rows",
        F.lit(executed[0]).alias("executed"), F.lit(executed[1]).alias("executed_again"),
    )
