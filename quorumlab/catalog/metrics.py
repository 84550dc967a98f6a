"""Queries on predictions, flags, history and timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog.registry import query
from quorumlab.catalog.views import confusion_sql
from quorumlab.functions.numeric import duration_text
from quorumlab.operators import inject, metrics, reporting, rules
from quorumlab.operators.metrics import ca_drop, ca_recovery, delta_asr, net_asr
from quorumlab.sources import samples as S

RUN = ["run", "attack", "defense", "round"]
LAST = """"precision", clean_accuracy, recall, specificity, f1, mcc"""
CELLS = 'tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN"'

# --- metrics ------------------------------------------------------------------------


@query("k01_confusion", confusion_sql("preds_big", "run, round"))
def confusion(spark, sf):
    return metrics.confusion(S.preds_big(spark, sf))


@query("k01_confusion_runs", "SELECT * FROM confusion")
def confusion_runs(spark, sf):
    return metrics.confusion(S.preds(spark, sf), RUN)


@query("k02_classification", "SELECT * FROM scores_big")
def classification(spark, sf):
    return metrics.classification(metrics.confusion(S.preds_big(spark, sf)))


@query("k02_classification_runs", "SELECT * FROM scores")
def classification_runs(spark, sf):
    return metrics.classification(metrics.confusion(S.preds(spark, sf), RUN))


@query("k03_attack_success", "SELECT * FROM asr")
def attack_success(spark, sf):
    return metrics.attack_success(S.preds_triggered(spark, sf), [*RUN, "trigger"])


def _rates(spark, sf):
    return metrics.attack_success(S.preds_triggered(spark, sf), [*RUN, "trigger"])


@query("k04_net_asr", """
    SELECT a.run, a.round, a.trigger, round(greatest(0, a.asr - c.asr), 4) AS asr_net
    FROM asr a JOIN asr c ON c.defense = 'clean' AND a.attack = c.attack AND a.round = c.round AND a.trigger = c.trigger
    WHERE a.defense <> 'clean'""")
def net_asr_rows(spark, sf):
    rates = _rates(spark, sf)
    floor = rates.filter("defense = 'clean'").select("attack", "round", "trigger", F.col("asr").alias("floor"))
    joined = rates.filter("defense <> 'clean'").join(floor, ["attack", "round", "trigger"])
    return joined.select("run", "round", "trigger", net_asr(F.col("asr"), F.col("floor")).alias("asr_net"))


@query("k05_ca_drop", """
    SELECT a.run, a.round, round(c.clean_accuracy - a.clean_accuracy, 4) AS ca_drop
    FROM scores a JOIN scores c ON c.defense = 'clean' AND a.attack = c.attack AND a.round = c.round
    WHERE a.defense <> 'clean'""")
def ca_drop_rows(spark, sf):
    scores = metrics.classification(metrics.confusion(S.preds(spark, sf), RUN))
    base = scores.filter("defense = 'clean'").select("attack", "round", F.col("clean_accuracy").alias("base"))
    joined = scores.filter("defense <> 'clean'").join(base, ["attack", "round"])
    return joined.select("run", "round", ca_drop(F.col("base"), F.col("clean_accuracy")).alias("ca_drop"))


@query("k06_delta_asr", """
    SELECT a.run, a.round, a.trigger, round(b.asr - a.asr, 4) AS delta_asr
    FROM asr a JOIN asr b ON b.defense = 'fedavg' AND a.attack = b.attack AND a.round = b.round AND a.trigger = b.trigger""")
def delta_asr_rows(spark, sf):
    rates = _rates(spark, sf)
    bare = rates.filter("defense = 'fedavg'").select("attack", "round", "trigger", F.col("asr").alias("bare"))
    joined = rates.join(bare, ["attack", "round", "trigger"])
    return joined.select("run", "round", "trigger", delta_asr(F.col("bare"), F.col("asr")).alias("delta_asr"))


@query("k07_ca_recovery", """
    SELECT d.run, d.round, CASE WHEN abs(c.clean_accuracy - a.clean_accuracy) >= 1e-6
           THEN round((d.clean_accuracy - a.clean_accuracy) / (c.clean_accuracy - a.clean_accuracy), 4) END AS ca_recovery
    FROM scores d JOIN scores a ON a.defense = 'fedavg' AND a.attack = d.attack AND a.round = d.round
         JOIN scores c ON c.defense = 'clean' AND c.attack = d.attack AND c.round = d.round""")
def ca_recovery_rows(spark, sf):
    scores = metrics.classification(metrics.confusion(S.preds(spark, sf), RUN))

    def named(defense, column):
        return scores.filter(F.col("defense") == defense).select("attack", "round", F.col("clean_accuracy").alias(column))

    joined = scores.join(named("fedavg", "attacked"), ["attack", "round"]).join(named("clean", "base"), ["attack", "round"])
    recovery = ca_recovery(F.col("base"), F.col("attacked"), F.col("clean_accuracy"))
    return joined.select("run", "round", recovery.alias("ca_recovery"))


# --- detection ----------------------------------------------------------------------

_FLAGS = """
    norms AS (SELECT 'plain' AS run, round, client_id, sqrt(sum(value * value)) AS norm FROM updates_plain GROUP BY ALL
              UNION ALL SELECT 'attack', round, client_id, sqrt(sum(value * value)) FROM updates_attack GROUP BY ALL),
    flags AS (SELECT run, round, client_id,
                     round(least(1.0::DOUBLE, median(norm) OVER (PARTITION BY run, round) / (norm + 1e-9)), 4) < 0.9 AS flagged
              FROM norms),
    rounds AS (SELECT run, count(DISTINCT round) AS n FROM flags GROUP BY run),
    stable AS (SELECT f.run, f.client_id, count(*) FILTER (flagged) AS flagged_rounds
               FROM flags f JOIN rounds r USING (run) GROUP BY f.run, f.client_id, r.n
               HAVING count(*) FILTER (flagged) >= greatest(1, r.n // 2))"""


def _flag_log(spark, sf):
    """Flags of norm clipping on a clean and on an attacked table."""
    parts = [
        rules.normclip(updates).clients.select(F.lit(run).alias("run"), "round", "client_id", "flagged")
        for run, updates in (("plain", S.updates_plain(spark, sf)), ("attack", S.updates_attack(spark, sf)))
    ]
    return parts[0].unionByName(parts[1])


@query("k08_detection", f"""
    WITH {_FLAGS},
    c AS (SELECT run, client_id, client_id >= 7 AS bad, bool_or(flagged) AS hit FROM flags GROUP BY run, client_id),
    n AS (SELECT run, count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp,
                 count(*) FILTER (NOT hit AND bad) AS fn, count(*) FILTER (NOT bad) AS honest FROM c GROUP BY run)
    SELECT run, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS detection_rate,
           round(CASE WHEN honest > 0 THEN fp::DOUBLE / honest ELSE 0 END, 4) AS false_exclusion_rate,
           round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS detection_precision,
           tp AS detected_malicious, fn AS missed_malicious, fp AS wrongly_excluded FROM n""")
def detection(spark, sf):
    log = _flag_log(spark, sf)
    clients = log.select("run", "client_id", inject.is_malicious(F.col("client_id"), 0.3, 10).alias("is_malicious")).distinct()
    return metrics.detection(log.filter("flagged"), clients)


@query("k09_stable_flags", f"WITH {_FLAGS} SELECT run, client_id, flagged_rounds FROM stable")
def stable_flags(spark, sf):
    return metrics.stable_flags(_flag_log(spark, sf))


@query("k10_evaluation_rows", "SELECT * FROM history")
def evaluation_rows(spark, sf):
    return S.history(spark, sf)


@query("k11_round_seconds", """
    SELECT run, round, round((start_us - lag(end_us) OVER (PARTITION BY run ORDER BY start_us, round)) / 1e6::DOUBLE, 2)
               AS round_seconds,
           round((end_us - start_us) / 1e6::DOUBLE, 2) AS eval_seconds FROM round_times""")
def round_seconds(spark, sf):
    return metrics.round_seconds(S.round_times(spark, sf))


# --- scenarios ----------------------------------------------------------------------

_GRID = """
    grid AS (SELECT a || '_' || d AS run, a AS attack, d AS defense FROM unnest(['manual', 'semantic']) x(a),
             unnest(['clean', 'fedavg', 'median', 'trimmed', 'krum', 'normclip', 'fltrust', 'foolsgold',
                     'fltrust_clip', 'rlr', 'satrust']) y(d))"""


@query("r01_scenario_grid", f"""
    WITH {_GRID} SELECT g.run, g.attack, g.defense, count(p.run) AS predictions
    FROM grid g LEFT JOIN preds p USING (run) GROUP BY g.run, g.attack, g.defense""")
def scenario_grid(spark, sf):
    done = S.preds(spark, sf).groupBy("run").agg(F.count("*").alias("predictions"))
    grid = reporting.scenario_grid(spark)
    return grid.join(done, "run", "left").fillna(0, subset=["predictions"])


@query("r02_pending_runs", f"""
    WITH {_GRID}, runs AS (SELECT DISTINCT run, CASE WHEN defense = 'median' THEN NULL WHEN defense = 'krum' THEN 1
                                                     ELSE 2 END AS version FROM preds)
    SELECT run, attack, defense FROM grid WHERE run NOT IN (
        SELECT run FROM runs WHERE coalesce(version, 1) = 2 AND run IN (SELECT run FROM history WHERE defense <> 'rlr'))""")
def pending_runs(spark, sf):
    version = F.when(F.col("defense") == "krum", 1).when(F.col("defense") != "median", 2)
    runs = S.preds(spark, sf).select("run", version.alias("schema_version")).distinct()
    history = S.history(spark, sf).filter("defense <> 'rlr'")
    return reporting.pending_runs(reporting.scenario_grid(spark), history, runs)


@query("r03_last_rounds", "SELECT * FROM last_rows")
def last_rounds(spark, sf):
    return reporting.last_rounds(S.history(spark, sf))


@query("r04_mean_asr", 'SELECT run, "ASR_mean" FROM mean_rates')
def mean_asr(spark, sf):
    return reporting.mean_asr(S.history(spark, sf))


def _duration_sql(x: str) -> str:
    s = f"CAST(round_even(greatest({x}, 0), 0) AS BIGINT)"
    return (
        f"CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN printf('%dm%02ds', {s} // 60, {s} % 60) "
        f"ELSE printf('%dh%02dm', {s} // 3600, ({s} % 3600) // 60) END"
    )


@query("r05_baseline_summary", f"""
    SELECT run AS scenario, round AS num_rounds, {LAST}, balanced_accuracy, {CELLS},
           asr_manual AS "ASR_floor_manual", asr_semantic AS "ASR_floor_semantic",
           {_duration_sql("seconds")} AS duration
    FROM last_rows JOIN run_seconds USING (run) WHERE run = 'manual_clean'""")
def baseline_summary(spark, sf):
    return reporting.baseline_summary(S.history(spark, sf), S.run_seconds(spark, sf), "manual_clean")


# The clean run and four attacked runs stand for the swept ratios.
SWEPT = {"manual_clean": 0.0, "manual_satrust": 0.1, "manual_rlr": 0.2, "manual_krum": 0.3, "manual_fedavg": 0.4}
_SWEPT_SQL = "CASE run " + " ".join(f"WHEN '{run}' THEN {r}::DOUBLE" for run, r in SWEPT.items()) + " END"
_POISONED = """
    marked AS (SELECT client_id, label = 1 AND row_number() OVER (PARTITION BY client_id, label ORDER BY md5('42:' || id), id)
                      <= floor(count(*) OVER (PARTITION BY client_id, label) * 0.6::DOUBLE) AS hit FROM shards),
    bad AS (SELECT client_id, count(*) FILTER (hit) AS n FROM marked GROUP BY client_id),
    swept AS (SELECT *, round_even(malicious_ratio * 10, 0)::INT AS n_malicious
              FROM (SELECT *, {case} AS malicious_ratio FROM last_rows) WHERE malicious_ratio IS NOT NULL),
    ratios AS (SELECT malicious_ratio, n_malicious,
                      CAST((SELECT coalesce(sum(n), 0) FROM bad WHERE client_id >= 10 - n_malicious) AS BIGINT)
                          AS n_poisoned_samples, {last}, {cells}, asr_manual AS "ASR",
                      round(greatest(0, asr_manual - coalesce((SELECT asr_manual FROM swept WHERE malicious_ratio = 0), 0)), 4)
                          AS "ASR_net",
                      round(coalesce((SELECT clean_accuracy FROM swept WHERE malicious_ratio = 0),
                                     (SELECT max(clean_accuracy) FROM swept)) - clean_accuracy, 4) AS "CA_drop"
               FROM swept)""".format(case=_SWEPT_SQL, last=LAST, cells=CELLS)


def _ratio_summary(spark, sf):
    ratio = F.coalesce(*[F.when(F.col("run") == run, F.lit(r)) for run, r in SWEPT.items()])
    swept = S.history(spark, sf).filter(F.col("run").isin(list(SWEPT)))
    last = reporting.last_rounds(swept).withColumn("malicious_ratio", ratio)
    marked = inject.poisoned_per_client(S.shards(spark, sf).drop("text"))
    poisoned = inject.poisoned_per_ratio(marked, C.MALICIOUS_SWEEP, 10)
    return reporting.ratio_summary(last, poisoned)


@query("r06_ratio_summary", f"WITH {_POISONED} SELECT * FROM ratios")
def ratio_summary(spark, sf):
    return _ratio_summary(spark, sf)


_COMPARE = f"""
    compared AS (SELECT l.attack, CASE l.attack WHEN 'manual' THEN l.asr_manual ELSE l.asr_semantic END AS "ASR",
                        CASE l.attack WHEN 'manual' THEN c.asr_manual ELSE c.asr_semantic END AS "ASR_floor",
                        round(greatest(0, CASE l.attack WHEN 'manual' THEN l.asr_manual - c.asr_manual
                                               ELSE l.asr_semantic - c.asr_semantic END), 4) AS "ASR_net",
                        l.clean_accuracy, round(c.clean_accuracy - l.clean_accuracy, 4) AS "CA_drop",
                        l.recall, l.f1, l.mcc, l.tp AS "TP", l.tn AS "TN", l.fp AS "FP", l.fn AS "FN"
                 FROM last_rows l, last_rows c WHERE c.run = 'manual_clean' AND l.defense = 'fedavg')"""


def _comparison(spark, sf):
    return reporting.attack_comparison(
        S.history(spark, sf), "manual_clean", {"manual": "manual_fedavg", "semantic": "semantic_fedavg"}
    )


@query("r07_attack_comparison", f"WITH {_COMPARE} SELECT * FROM compared")
def attack_comparison(spark, sf):
    return _comparison(spark, sf)


@query("r08_verdict", f"""
    WITH {_COMPARE}, v AS (SELECT max("ASR_net") FILTER (attack = 'manual') AS manual_net,
                                  max("ASR_net") FILTER (attack = 'semantic') AS semantic_net FROM compared)
    SELECT *, CASE WHEN semantic_net > manual_net THEN 'semantic stronger'
                   WHEN semantic_net < manual_net THEN 'manual stronger' ELSE 'equal' END AS verdict FROM v""")
def verdict(spark, sf):
    return reporting.verdict(_comparison(spark, sf))


_DEFENSE = f"""
    l AS (SELECT lr.*, m."ASR_mean", CASE lr.attack WHEN 'manual' THEN asr_manual ELSE asr_semantic END AS asr
          FROM last_rows lr JOIN mean_rates m USING (run)),
    defended AS (SELECT l.attack, l.defense, l.clean_accuracy, l.asr AS "ASR", round(greatest(0, l.asr - c.asr), 4) AS "ASR_net",
                        l.recall, l.specificity, l.f1, l.mcc, l.tp AS "TP", l.tn AS "TN", l.fp AS "FP", l.fn AS "FN",
                        {_duration_sql("seconds")} AS duration, l."ASR_mean",
                        round(b.asr - l.asr, 4) AS "delta_ASR", round(b."ASR_mean" - l."ASR_mean", 4) AS "delta_ASR_mean",
                        c.clean_accuracy AS "CA_clean_baseline", c.asr AS "ASR_floor"
                 FROM l LEFT JOIN l c ON c.defense = 'clean' AND c.attack = l.attack
                      LEFT JOIN l b ON b.defense = 'fedavg' AND b.attack = l.attack
                      LEFT JOIN run_seconds s ON s.run = l.run WHERE l.defense <> 'clean')"""


def _defense_summary(spark, sf):
    return reporting.defense_summary(S.history(spark, sf), S.run_seconds(spark, sf))


@query("r09_defense_summary", f"WITH {_DEFENSE} SELECT * FROM defended")
def defense_summary(spark, sf):
    return _defense_summary(spark, sf)


@query("r09_defense_summary_without_base", f"""
    WITH {_DEFENSE.replace("b.defense = 'fedavg'", "FALSE")} SELECT * FROM defended WHERE defense <> 'fedavg'""")
def defense_summary_without_base(spark, sf):
    history = S.history(spark, sf).filter("defense <> 'fedavg'")
    return reporting.defense_summary(history, S.run_seconds(spark, sf))


@query("r10_ranking", f"""
    WITH {_DEFENSE} SELECT attack, CAST(rank() OVER (PARTITION BY attack ORDER BY "ASR_mean", defense) AS INT) AS rank,
           defense, "ASR_mean", "delta_ASR_mean" FROM defended""")
def ranking(spark, sf):
    return reporting.ranking(_defense_summary(spark, sf))


_REPORT = """attack, defense, clean_accuracy, "ASR", "ASR_net", "ASR_mean", "delta_ASR_mean", f1, mcc,
             "TP", "TN", "FP", "FN", duration"""


@query("r11_report_table", f"WITH {_DEFENSE} SELECT {_REPORT} FROM defended")
def report_table(spark, sf):
    return reporting.report_table(_defense_summary(spark, sf))


@query("r12_merged_report", f"""
    WITH {_POISONED}, {_COMPARE}, {_DEFENSE}
    SELECT 'demo2' AS demo, * FROM ratios
    UNION ALL BY NAME SELECT 'demo3' AS demo, * FROM compared
    UNION ALL BY NAME SELECT 'demo4' AS demo, {_REPORT} FROM defended""")
def merged_report(spark, sf):
    return reporting.merged_report({
        "demo2": _ratio_summary(spark, sf),
        "demo3": _comparison(spark, sf),
        "demo4": reporting.report_table(_defense_summary(spark, sf)),
    })


@query("r13_confusion_cells", """
    WITH c AS (SELECT run, tp + tn + fp + fn AS total, unnest(['safe', 'safe', 'phishing', 'phishing']) AS true_label,
                      unnest(['safe', 'phishing', 'safe', 'phishing']) AS predicted_label, unnest([tn, fp, fn, tp]) AS n
               FROM last_rows WHERE run IN ('manual_clean', 'manual_fedavg', 'semantic_fedavg', 'manual_fltrust'))
    SELECT run, true_label, predicted_label, n,
           round(CASE WHEN total > 0 THEN 100.0::DOUBLE * n / total ELSE 0 END, 4) AS percent FROM c""")
def confusion_cells(spark, sf):
    chosen = ["manual_clean", "manual_fedavg", "semantic_fedavg", "manual_fltrust"]
    return reporting.confusion_cells(reporting.last_rounds(S.history(spark, sf).filter(F.col("run").isin(chosen))))


@query("r14_trajectories", "SELECT attack, defense, round, own_asr AS asr FROM own")
def trajectories(spark, sf):
    return reporting.trajectories(S.history(spark, sf))


@query("r15_convergence", """
    SELECT run, round, unnest(['clean_accuracy', 'f1', 'recall', 'specificity', 'mcc']) AS metric,
           unnest([clean_accuracy, f1, recall, specificity, mcc]) AS value FROM history""")
def convergence(spark, sf):
    return reporting.convergence(S.history(spark, sf))


# --- timing -------------------------------------------------------------------------


@query("r16_timing_report", """
    SELECT batch, count(*) AS runs, round(sum(seconds), 2) AS total_seconds, round(avg(seconds), 2) AS mean_seconds,
           arg_min(run, (-seconds, run)) AS slowest_run, max(seconds) AS slowest_seconds
    FROM run_durations GROUP BY batch""")
def timing_report(spark, sf):
    return reporting.timing_report(S.run_durations(spark, sf))


@query("r17_remaining_time", """
    SELECT batch, round(greatest(0, avg(seconds) * (2050 - count(*))), 2) AS eta_seconds
    FROM run_durations GROUP BY batch""")
def remaining_time(spark, sf):
    return reporting.remaining_time(S.run_durations(spark, sf), F.lit(2050))


@query("r18_duration_text", f"""
    SELECT run, {_duration_sql("seconds * 100 - 50")} AS duration FROM run_durations""")
def durations(spark, sf):
    return S.run_durations(spark, sf).select("run", duration_text(F.col("seconds") * 100 - 50).alias("duration"))
