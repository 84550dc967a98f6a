"""Streams equal their batch operators, drop late rows and survive replays."""

import datetime as dt

import pytest

from pyspark.sql import functions as F
from quorumlab.operators import metrics
from quorumlab.streaming import metrics as stream_metrics
from quorumlab.streaming import sink, updates


def stage(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    )


UPDATES = "ts timestamp, round int, client_id int, layer int, coord int, value double"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_running_history_over_batches(spark, tmp_path):
    parts = [[(at(r), r, c, 0, k, float(r + c + k)) for c in range(2) for k in range(3)] for r in range(3)]
    stream = stage(spark, str(tmp_path / "in"), parts, UPDATES)
    table = sink.run(updates.running_history(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert table.select("batch").distinct().count() == 3
    got = {(r["client_id"], r["coord"]): r["value"] for r in sink.latest(table, ["client_id", "layer", "coord"]).collect()}
    assert got == {(c, k): sum(float(r + c + k) for r in range(3)) for c in range(2) for k in range(3)}


def test_windowed_norms_drop_late_rows(spark, tmp_path):
    parts = [
        [(at(0), 0, 1, 0, 0, 3.0), (at(1), 0, 1, 0, 1, 4.0)],
        [(at(20), 0, 1, 0, 0, 1.0)],
        [(at(22), 0, 2, 0, 0, 1.0)],  # the watermark passes the first window
        [(at(2), 0, 1, 0, 0, 100.0), (at(21), 0, 1, 0, 1, 1.0)],  # the first row is too late
        [(at(50), 0, 1, 0, 0, 9.0)],
    ]
    stream = stage(spark, str(tmp_path / "in"), parts, UPDATES)
    table = sink.run(updates.windowed_norms(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    norms = sorted(r["norm"] for r in table.collect())
    assert norms == pytest.approx([1.0, 2**0.5, 5.0])  # the last window is still open


def test_round_metrics_match_batch(spark, tmp_path):
    schema = "run string, round int, y_true int, y_pred int"
    parts = [[("r", k % 2, i % 2, (i * k) % 3 % 2) for i in range(20)] for k in range(4)]
    stream = stage(spark, str(tmp_path / "in"), parts, schema)
    table = sink.run(stream_metrics.confusion(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    streamed = stream_metrics.scores(sink.latest(table, ["run", "round"]))
    everything = spark.createDataFrame([row for part in parts for row in part], schema)
    batch = metrics.classification(metrics.confusion(everything))
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_log_filter_stream(spark, tmp_path):
    parts = [[("[Round 1] ok  ",), ("It will be removed",)], [("(raylet) x",), ("   ",), ("CA=0.9",)]]
    stream = stage(spark, str(tmp_path / "in"), parts, "line string")
    table = sink.run(stream_metrics.filtered_log(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "append")
    assert sorted(r["line"] for r in table.collect()) == ["CA=0.9", "[Round 1] ok"]


def test_replayed_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "client_id int, value double")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/batch=0")
    table = sink.read(spark, str(tmp_path))
    assert table.count() == 1 and table.agg(F.max("batch")).first()[0] == 0
