"""Worked metric values, detection, stable flags, reports and timing."""

import pytest

from pyspark.sql import functions as F
from quorumlab.operators import metrics, reporting
from quorumlab.sources import artifacts


def scores(spark, truth, guess):
    rows = [("r", 1, t, g) for t, g in zip(truth, guess, strict=True)]
    df = spark.createDataFrame(rows, "run string, round int, y_true int, y_pred int")
    return metrics.classification(metrics.confusion(df)).first()


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scores(spark):
    half = scores(spark, [1, 1, 0, 0], [1, 0, 0, 1])
    assert [half[c] for c in metrics.COUNTS] == [1, 1, 1, 1]
    assert half["clean_accuracy"] == half["specificity"] == half["fnr"] == 0.5 and half["mcc"] == 0.0
    assert scores(spark, [1, 1, 0, 0], [1, 1, 0, 0])["mcc"] == 1.0
    empty = scores(spark, [0, 0], [0, 0])
    assert empty["precision"] == empty["recall"] == empty["f1"] == empty["mcc"] == 0.0


def test_attack_and_defence_values(spark):
    hits = spark.createDataFrame([("r", 1, "manual", p) for p in (0, 0, 1)], "run string, round int, trigger string, pred int")
    assert metrics.attack_success(hits).first()["asr"] == 0.6667
    lit = F.lit
    assert value(spark, metrics.net_asr(lit(0.9), lit(0.2))) == 0.7
    assert value(spark, metrics.net_asr(lit(0.1), lit(0.3))) == 0.0
    assert value(spark, metrics.delta_asr(lit(0.9), lit(0.2))) == 0.7
    assert value(spark, metrics.ca_recovery(lit(0.95), lit(0.75), lit(0.95))) == 1.0
    assert value(spark, metrics.ca_recovery(lit(0.95), lit(0.95), lit(0.95))) is None


@pytest.mark.parametrize("flags, expected", [
    ([7, 8, 9, 9], (1.0, 0.0, 1.0, 3, 0, 0)),
    ([0, 7], (0.3333, 0.1429, 0.5, 1, 2, 1)),
    ([], (0.0, 0.0, 0.0, 0, 3, 0)),
])
def test_detection(spark, flags, expected):
    clients = spark.createDataFrame([("r", c, c >= 7) for c in range(10)], "run string, client_id int, is_malicious boolean")
    marks = spark.createDataFrame([("r", c) for c in flags], "run string, client_id int")
    row = metrics.detection(marks, clients).first()
    assert tuple(row[c] for c in row.asDict() if c != "run") == expected


@pytest.mark.parametrize("rounds, needed", [(1, 1), (2, 1), (3, 1), (4, 2), (10, 5)])
def test_stable_flags(spark, rounds, needed):
    rows = [("r", r, c, r < c) for r in range(rounds) for c in range(rounds + 1)]
    log = spark.createDataFrame(rows, "run string, round int, client_id int, flagged boolean")
    assert {r["client_id"] for r in metrics.stable_flags(log).collect()} == set(range(needed, rounds + 1))


def test_round_seconds_across_slices(spark):
    """A run with nearly all rows, cut into few and into many slices."""
    rows = [("hot", i, i * 1_000_000, i * 1_000_000 + 400_000) for i in range(200)]
    rows += [("cold", 0, 5_000_000, 6_000_000), ("cold", 1, 150_000_000, 151_000_000)]
    times = spark.createDataFrame(rows, "run string, round int, start_us long, end_us long")
    for slices in (1, 7, 4096):
        got = {(r["run"], r["round"]): r for r in metrics.round_seconds(times, slices).collect()}
        assert len(got) == 202
        assert got[("hot", 0)]["round_seconds"] is None and got[("cold", 0)]["round_seconds"] is None
        assert all(got[("hot", i)]["round_seconds"] == 0.6 for i in range(1, 200))
        assert got[("cold", 1)]["round_seconds"] == 144.0
        assert got[("hot", 3)]["eval_seconds"] == 0.4


def history(spark, rows):
    columns = "run string, attack string, defense string, round int, asr_manual double, asr_semantic double"
    return spark.createDataFrame(rows, columns)


def test_mean_rate_skips_round_zero_and_is_exact(spark):
    rows = [("m", "manual", "fedavg", 0, 1.0, 0.0)]
    rows += [("m", "manual", "fedavg", r, v, 0.0) for r, v in ((1, 0.1001), (2, 0.1002))]
    rows += [("s", "semantic", "krum", 0, 0.0, 0.5)]
    got = {r["run"]: r["ASR_mean"] for r in reporting.mean_asr(history(spark, rows)).collect()}
    assert got == {"m": 0.1002, "s": None}


def test_last_rounds(spark):
    rows = [("m", "manual", "fedavg", r, r / 10, 0.0) for r in (2, 10, 9)]
    assert reporting.last_rounds(history(spark, rows)).first()["asr_manual"] == 1.0


def test_pending_runs(spark):
    grid = reporting.scenario_grid(spark, ["manual"], ["fedavg", "krum", "rlr"])
    rows = [(f"manual_{d}", "manual", d, 1, 0.1, 0.1) for d in ("clean", "fedavg", "krum")]
    runs = spark.createDataFrame(
        [("manual_clean", 2), ("manual_fedavg", 1), ("manual_krum", None), ("manual_rlr", 2)], "run string, schema_version int"
    )
    pending = reporting.pending_runs(grid, history(spark, rows), runs)
    assert {r["defense"] for r in pending.collect()} == {"fedavg", "krum", "rlr"}
    assert reporting.pending_runs(grid, history(spark, rows), runs, force=True).count() == 4


def test_run_artifacts_replace_only_their_runs(spark, tmp_path):
    root = str(tmp_path)

    def save(run, accuracy):
        artifacts.save_runs(
            root, spark.createDataFrame([(run, 0, accuracy)], "run string, round int, clean_accuracy double"),
            spark.createDataFrame([(run, "manual")], "run string, attack string"),
            spark.createDataFrame([(run, 0, 1, "norm", 1.0)], "run string, round int, client_id int, metric string, value double"),
        )

    save("a", 0.5)
    save("b", 0.6)
    save("a", 0.7)
    loaded = artifacts.load_runs(spark, root)
    assert {r["run"]: r["clean_accuracy"] for r in loaded["history"].collect()} == {"a": 0.7, "b": 0.6}
    assert artifacts.load_runs(spark, root, version=3)["history"].count() == 0


def test_timing(spark):
    rows = [(i, "x", float(s)) for i, s in enumerate([100, 200, 300])]
    df = spark.createDataFrame(rows, "run long, batch string, seconds double")
    report = reporting.timing_report(df).first()
    assert (report["runs"], report["total_seconds"], report["mean_seconds"], report["slowest_run"]) == (3, 600.0, 200.0, 2)
    assert reporting.remaining_time(df, F.lit(4)).first()["eta_seconds"] == 200.0
    assert reporting.remaining_time(df, F.lit(2)).first()["eta_seconds"] == 0.0
