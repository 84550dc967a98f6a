"""Scenarios: pending, executed, published last, reused; the keyed merge table of streams."""

import pytest
from pyspark.sql import functions as F

from quorumlab.operators import reporting
from quorumlab.plans import manifest
from quorumlab.streaming.merge import MergeTable


@pytest.fixture
def grid(spark):
    return reporting.scenario_grid(spark, ["manual"], ["krum", "median"])


def scenario_rows(spark, run, bad=(7, 8, 9), rounds=3):
    history = spark.createDataFrame([(run, r, 0.5 + r / 10) for r in range(rounds + 1)], "run string, round int, clean_accuracy double")
    log = [(run, r, c, "flagged", float(c in bad and r > 1)) for r in range(1, rounds + 1) for c in range(10)]
    return history, spark.createDataFrame(log, "run string, round int, client_id int, metric string, value double")


def test_pending_scenarios_run_once(spark, grid, tmp_path):
    root, calls = str(tmp_path / "out"), []

    def execute(scenario):
        calls.append(scenario["run"])
        return scenario_rows(spark, scenario["run"])

    assert manifest.run_pending(spark, root, grid, execute, limit=1) == ["manual_clean"]
    assert manifest.run_pending(spark, root, grid, execute) == ["manual_krum", "manual_median"]
    assert manifest.run_pending(spark, root, grid, execute) == [] and len(calls) == 3
    tables = manifest.published(spark, root)
    rows = {r["run"]: r for r in tables["runs"].collect()}
    assert set(rows) == set(calls) and tables["history"].count() == 12 and tables["diagnostics"].count() == 90
    row = rows["manual_krum"]
    assert (row["num_rounds"], row["malicious_ids"], row["detection_rate"], row["detected_malicious"]) == (3, [7, 8, 9], 1.0, 3)
    assert manifest.run_pending(spark, root, grid, execute, version=99, limit=1) == ["manual_clean"]  # of another schema version


def test_a_run_that_dies_half_way_is_pending_again(spark, grid, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    one = grid.filter("run = 'manual_krum'")
    with monkeypatch.context() as patch:
        patch.setattr(manifest, "detection_of", lambda *a: 1 / 0)  # the rows are written, the run is not published
        with pytest.raises(ZeroDivisionError):
            manifest.run_pending(spark, root, one, lambda s: scenario_rows(spark, s["run"], rounds=7))
    assert manifest.published(spark, root)["runs"].isEmpty()
    assert [r["run"] for r in manifest.pending(spark, root, one).collect()] == ["manual_krum"]
    assert manifest.run_pending(spark, root, one, lambda s: scenario_rows(spark, s["run"])) == ["manual_krum"]
    assert manifest.published(spark, root)["history"].count() == 4  # nothing of the attempt that died


def test_a_forced_repetition_replaces_a_run(spark, grid, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    one = grid.filter("run = 'manual_krum'")
    manifest.run_pending(spark, root, one, lambda s: scenario_rows(spark, s["run"]))
    with monkeypatch.context() as patch:
        patch.setattr(manifest, "detection_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            manifest.run_pending(spark, root, one, lambda s: scenario_rows(spark, s["run"], rounds=9), force=True)
    assert manifest.published(spark, root)["history"].count() == 4  # the published attempt still counts
    manifest.run_pending(spark, root, one, lambda s: scenario_rows(spark, s["run"], rounds=5), force=True)
    tables = manifest.published(spark, root)
    assert tables["history"].count() == 6 and tables["runs"].first()["num_rounds"] == 5


def test_no_detection_without_malicious_clients(spark):
    _, log = scenario_rows(spark, "r")
    assert manifest.detection_of("r", log, [], 10) == {}
    assert manifest.detection_of("r", log.filter(F.lit(False)), [9], 10) == {}


# --- merge table --------------------------------------------------------------------


def batch_of(spark, number, keys=6):
    return spark.createDataFrame([(k, f"n{k}", float(number * 10 + k)) for k in range(number % 3, keys)], "k int, name string, value double")


def files_below(path):
    return sum(1 for p in path.rglob("*.parquet"))


@pytest.mark.parametrize("replace", [False, True])
def test_merged_batches_equal_one_aggregate(spark, tmp_path, replace):
    table = MergeTable(spark, str(tmp_path / "t"), ["k", "name"], ["value"], replace, compact_every=3, buckets=2)
    assert table.read() is None
    want, counts = {}, []
    for number in range(14):
        rows = batch_of(spark, number)
        assert table.merge(rows, number)
        for r in rows.collect():
            key = (r["k"], r["name"])
            want[key] = r["value"] if replace else want.get(key, 0.0) + r["value"]
        assert {(r["k"], r["name"]): r["value"] for r in table.read().collect()} == want
        assert not table.merge(rows, number) and not table.merge(rows, max(0, number - 1))  # replays
        assert {(r["k"], r["name"]): r["value"] for r in table.read().collect()} == want
        counts.append((len(table._places(table.manifest())), files_below(tmp_path)))
    assert max(n for n, _ in counts) <= 3 and max(f for _, f in counts[-3:]) <= max(f for _, f in counts[6:9])


def test_a_crash_before_the_manifest_repeats_the_batch(spark, tmp_path, monkeypatch):
    table = MergeTable(spark, str(tmp_path / "t"), ["k", "name"], ["value"], compact_every=2, buckets=2)
    want = {}
    for number in range(7):
        rows = batch_of(spark, number)
        with monkeypatch.context() as patch:
            patch.setattr(MergeTable, "_publish", lambda self, manifest: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                table.merge(rows, number)
        if number:
            assert {r["k"]: r["value"] for r in table.read().collect()} == want  # as before the batch
        assert table.merge(rows, number)
        for r in rows.collect():
            want[r["k"]] = want.get(r["k"], 0.0) + r["value"]
        assert {r["k"]: r["value"] for r in table.read().collect()} == want


def test_a_stream_is_merged_batch_by_batch(spark, tmp_path):
    for number in range(5):
        batch_of(spark, number).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, name string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = MergeTable(spark, str(tmp_path / "t"), ["k"], ["value"], compact_every=2)
    found = {r["k"]: r["value"] for r in table.run(stream, str(tmp_path / "state")).collect()}
    want = {}
    for number in range(5):
        for r in batch_of(spark, number).collect():
            want[r["k"]] = want.get(r["k"], 0.0) + r["value"]
    assert found == want and table.manifest()["batch"] >= 4
    assert {r["k"]: r["value"] for r in table.run(stream, str(tmp_path / "state")).collect()} == want
