"""Tiles of client pairs and the state that rules carry from round to round."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlab.operators import pairwise, rules
from quorumlab.plans import strategy


def pairs_of(df, value):
    return {(r["round"], r["left_id"], r["right_id"]): r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def sparse(spark):
    """Clients that lack coordinates, share none with others, or hold values that are not finite."""
    rng = np.random.default_rng(1)
    rows = []
    for r in range(2):
        for c in range(11):
            for layer in range(2):
                for coord in range(6):
                    if c == 9 and coord > 2 or c == 10 and coord < 3 or rng.random() < 0.15:
                        continue
                    rows.append((r, c * 7, layer, coord, float(rng.normal())))
    rows += [(0, 3, 0, 0, float("nan")), (0, 3, 1, 1, 2.0), (1, 5, 0, 1, float("inf"))]
    return spark.createDataFrame(rows, "round int, client_id int, layer int, coord int, value double")


@pytest.mark.parametrize("block", [1, 3, 5])
def test_tiles_give_the_pairs_of_one_matrix(sparse, monkeypatch, block):
    want = pairs_of(pairwise.distances(sparse, 1), "dist"), pairs_of(pairwise.dots(sparse, 1), "dot")
    monkeypatch.setattr(pairwise, "BLOCK", block)
    monkeypatch.setattr(pairwise, "_CHUNK", 4)
    got = pairs_of(pairwise.distances(sparse, 12), "dist"), pairs_of(pairwise.dots(sparse), "dot")
    for ours, theirs in zip(got, want, strict=True):
        assert ours.keys() == theirs.keys()
        assert all(ours[k] == pytest.approx(theirs[k], rel=1e-12, abs=1e-12, nan_ok=True) for k in theirs)


def test_three_thousand_clients(spark):
    clients, coords = 3000, 6
    updates = spark.range(clients * coords).select(
        F.lit(1).alias("round"), F.expr(f"cast(id div {coords} as int)").alias("client_id"), F.lit(0).alias("layer"),
        F.expr(f"cast(id % {coords} as int)").alias("coord"), (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1).alias("value"),
    )
    x = np.array([r["v"] for r in updates.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("coord", "value"))).alias("c"))
                  .select("client_id", F.col("c.value").alias("v")).orderBy("client_id").collect()])
    found = pairwise.dots(updates).agg(F.count("*"), F.sum("dot"), F.min("dot"), F.sum(F.col("dot") * F.col("dot"))).first()
    product = np.triu(x @ x.T)[np.triu_indices(clients)]
    assert found[0] == clients * (clients + 1) // 2
    assert np.allclose(found[1:], [product.sum(), product.min(), (product**2).sum()])
    outcome = rules.krum(updates, num_malicious=5)
    assert outcome.clients.filter("flagged").count() == 5


def test_a_task_holds_one_tile(spark):
    """Whatever the number of tiles, each is sent off before the next one starts."""
    schema = pa.schema([("round", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("roster", pa.bool_()),
                        ("left_ids", pa.list_(pa.int32())), ("left_values", pa.list_(pa.float64())),
                        ("right_ids", pa.list_(pa.int32())), ("right_values", pa.list_(pa.float64()))])

    def batches():
        for tile in range(50):
            sent.append(tile)
            for _ in range(3):
                ids, values = [tile * 4 + k for k in range(4)], [1.0] * 4
                row = {"round": 0, "i": tile, "j": tile + 1, "roster": False, "left_ids": ids, "left_values": values,
                       "right_ids": [i + 4 for i in ids], "right_values": values}
                yield pa.RecordBatch.from_pylist([row] * 5, schema)

    sent = []
    reducer = pairwise._pair_reducer(pairwise._products, True)
    for done, out in enumerate(reducer(batches())):
        assert out.num_rows == 16 and set(out.column("part").to_pylist()) == {15.0}
        assert len(sent) <= done + 2


# --- carried state ------------------------------------------------------------------


def rounds_of(spark, numbers, clients=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for r in numbers:
        for c in range(clients):
            if (r + c) % 5 == 4:
                continue  # absent this round
            for layer in range(3):
                for coord in range(4):
                    rows.append((r, c, layer, coord, float(rng.normal()) if c < 4 else 0.5 - coord))
    return spark.createDataFrame(rows, "round int, client_id int, layer int, coord int, value double")


@pytest.mark.parametrize("layers", [0, 2])
def test_steps_equal_the_stacked_rounds(spark, layers):
    stacked = rounds_of(spark, range(1, 6))
    whole = rules.foolsgold(stacked, last_layers=layers)
    state, clients, cells = None, {}, {}
    for r in range(1, 6):
        outcome, state = strategy.advance("foolsgold", stacked.filter(F.col("round") == r), state, last_layers=layers)
        clients |= {(x["round"], x["client_id"]): (x["weight"], x["flagged"]) for x in outcome.clients.collect()}
        cells |= {(x["round"], x["layer"], x["coord"]): x["value"] for x in outcome.aggregate.collect()}
    want = {(x["round"], x["client_id"]): (x["weight"], x["flagged"]) for x in whole.clients.collect()}
    assert clients.keys() == want.keys() and all(clients[k][1] == want[k][1] for k in want)
    assert all(clients[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in want)
    target = {(x["round"], x["layer"], x["coord"]): x["value"] for x in whole.aggregate.collect()}
    assert cells.keys() == target.keys() and all(cells[k] == pytest.approx(target[k], abs=1e-12) for k in target)


def test_a_round_reads_its_updates_and_the_state_only(spark):
    """Plan and rows of a step do not grow with the rounds before it."""
    shapes, state = [], None
    for r in range(1, 6):
        updates = rounds_of(spark, [r], seed=r)
        outcome, state = strategy.advance("foolsgold", updates, state, client_rows=6, last_layers=2)
        plan = outcome.aggregate._jdf.queryExecution().optimizedPlan().toString()
        cells = state.count()
        shapes.append((plan.count("LogicalRDD"), plan.count("Join"), plan.count("Aggregate"), cells <= 6 * 2 * 4))
        assert strategy.advance("fedavg", updates)[1] is None
    assert len(set(shapes[1:])) == 1 and all(s[3] for s in shapes)


def test_absent_clients_keep_their_sum(spark):
    first = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 1, 0, 0, 2.0)], "round int, client_id int, layer int, coord int, value double")
    second = spark.createDataFrame([(2, 0, 0, 0, 4.0), (2, 2, 0, 0, 8.0)], first.schema)
    sums = pairwise.carried(second, pairwise.carried(first))
    found = {r["client_id"]: (r["value"], r["present"]) for r in sums.collect()}
    assert found == {0: (5.0, True), 1: (2.0, False), 2: (8.0, True)}
    assert math.isclose(sum(v for v, _ in found.values()), 15.0)
