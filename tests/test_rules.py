"""Aggregation rules on planted inputs, worked values and degenerate branches."""

import numpy as np
import pytest

from conftest import cells, flagged, per_client
from pyspark.sql import functions as F
from quorumlab import constants as C
from quorumlab.operators import algebra as U
from quorumlab.operators import pairwise, rules
from quorumlab.plans import strategy


def planted(shift=10.0, seed=0):
    rng = np.random.default_rng(seed)
    honest = {c: [1.0 + rng.normal(0, 0.01, 4), 0.5 + rng.normal(0, 0.01, 4)] for c in range(7)}
    bad = {c: [np.full(4, 1.0 + shift), np.full(4, 0.5 - shift)] for c in range(7, 10)}
    return honest | bad


def first_layer_error(aggregate):
    return np.mean([abs(v - 1.0) for (_, layer, _), v in cells(aggregate).items() if layer == 0])


def test_outliers_drag_the_mean_but_not_the_robust_rules(vectors):
    updates = vectors(planted())
    assert first_layer_error(rules.fedavg(updates).aggregate) > 1.0
    for outcome in (rules.median(updates), rules.trimmed(updates), rules.krum(updates)):
        assert first_layer_error(outcome.aggregate) < 0.1
    assert flagged(rules.krum(updates).clients) == {7, 8, 9}


def test_result_does_not_depend_on_row_order_or_partitioning(vectors):
    one, two = vectors(planted(), 1), vectors(planted(), 2).repartition(7)
    for rule in (rules.median, rules.trimmed, rules.krum, rules.satrust, rules.foolsgold):
        a, b = cells(rule(one).aggregate), cells(rule(two).aggregate)
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10])
def test_order_statistics_match_numpy(vectors, n):
    rng = np.random.default_rng(n)
    data = {c: [rng.normal(size=6).round(1)] for c in range(n)}
    stack = np.stack([layers[0] for layers in data.values()])
    updates = vectors(data)
    low, high = (lambda m: U.int_div(m + 1, 2)), (lambda m: U.int_div(m, 2) + 1)
    med = cells(U.mean_between(updates, low, high))
    assert [med[(0, 0, i)] for i in range(6)] == pytest.approx(np.median(stack, axis=0).tolist())
    for ratio in (0.0, 0.2, 0.3, 0.5):
        k = int(np.floor(ratio * n))
        ordered = np.sort(stack, axis=0)
        kept = ordered[k : n - k] if 2 * k < n else ordered
        got = cells(rules.trimmed(updates, ratio).aggregate)
        assert [got[(0, 0, i)] for i in range(6)] == pytest.approx(kept.mean(axis=0).tolist())


def test_fedavg_weights_by_samples(vectors, spark):
    updates = vectors({0: [[1.0]], 1: [[4.0]]})
    counts = spark.createDataFrame([(0, 0, 30), (0, 1, 10)], "round int, client_id int, n long")
    assert cells(rules.fedavg(updates, counts).aggregate)[(0, 0, 0)] == pytest.approx(1.75)


def test_pair_distances_and_scores_match_brute_force(vectors):
    data = planted(shift=2.0, seed=3)
    flat = {c: np.concatenate(layers) for c, layers in data.items()}
    dist = {
        (r["left_id"], r["right_id"]): r["dist"] for r in pairwise.distances(vectors(data)).collect()
    }
    assert len(dist) == 55
    for (i, j), d in dist.items():
        assert d == pytest.approx(((flat[i] - flat[j]) ** 2).sum(), abs=1e-12)
    scores = per_client(rules.krum_scores(pairwise.distances(vectors(data))), "score")
    for i in range(10):
        others = sorted(((flat[i] - flat[j]) ** 2).sum() for j in range(10) if j != i)
        assert scores[(0, i)] == pytest.approx(sum(others[:5]))


def test_pair_sums_with_gaps_and_late_clients(vectors, spark):
    rows = [(0, 0, 0, 0, 1.0), (0, 1, 0, 0, 3.0), (0, 0, 0, 1, 2.0), (0, 2, 0, 1, 5.0), (1, 5, 0, 0, 1.0)]
    updates = spark.createDataFrame(rows, "round int, client_id int, layer int, coord int, value double")
    dist = {(r["round"], r["left_id"], r["right_id"]): r["dist"] for r in pairwise.distances(updates).collect()}
    assert dist[(0, 0, 1)] == 4.0 and dist[(0, 0, 2)] == 9.0
    assert dist[(0, 1, 2)] == 0.0 and dist[(1, 5, 5)] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_krum_with_few_clients(vectors, n):
    outcome = rules.krum(vectors({c: [[float(c)]] for c in range(n)}))
    assert cells(outcome.aggregate)[(0, 0, 0)] == pytest.approx(0.0)
    assert len(flagged(outcome.clients)) == n - 1


def test_norm_clipping(vectors):
    data = {c: [np.full(4, 0.1 if c < 7 else 5.0), np.full(4, 0.1 if c < 7 else 5.0)] for c in range(10)}
    outcome = rules.normclip(vectors(data))
    rows = {r["client_id"]: r for r in outcome.clients.collect()}
    assert all(rows[c]["tau"] < 1.0 for c in rows)
    assert all(round(rows[c]["scale"], 4) == 1.0 for c in range(7))
    assert all(rows[c]["scale"] < 1.0 and rows[c]["flagged"] for c in range(7, 10))
    plain = cells(outcome.aggregate)
    assert np.mean(list(plain.values())) < 1.0
    noisy = cells(rules.normclip(vectors(data), noise_std=0.05).aggregate)
    again = cells(rules.normclip(vectors(data, 5).repartition(3), noise_std=0.05).aggregate)
    assert noisy != plain
    assert all(noisy[k] == pytest.approx(again[k], abs=1e-12) for k in noisy)


def test_root_trust(vectors):
    data = {c: [np.full(4, 1.0 if c < 7 else -5.0), np.full(4, 1.0 if c < 7 else -5.0)] for c in range(10)}
    root = vectors({0: [np.ones(4), np.ones(4)]}).drop("client_id")
    trust = per_client(rules.trust_scores(vectors(data), root), "trust")
    assert all(trust[(0, c)] > 0.9 for c in range(7))
    assert all(trust[(0, c)] == 0.0 for c in range(7, 10))
    for rule in (rules.fltrust, rules.fltrust_clip):
        outcome = rule(vectors(data), root)
        assert flagged(outcome.clients) == {7, 8, 9}
        assert all(v == pytest.approx(1.0) for v in cells(outcome.aggregate).values())


def test_root_trust_is_zero_when_nobody_is_trusted(vectors):
    root = vectors({0: [np.ones(3)]}).drop("client_id")
    outcome = rules.fltrust(vectors({0: [-np.ones(3)], 1: [-2 * np.ones(3)]}), root)
    assert set(cells(outcome.aggregate).values()) == {0.0}
    assert flagged(outcome.clients) == {0, 1}


def colluding(last=60):
    rng = np.random.default_rng(0)
    data = {c: [rng.normal(0, 1, 40), rng.normal(0, 1, last)] for c in range(7)}
    shared = rng.normal(0, 1, last)
    return data | {c: [rng.normal(0, 1, 40), shared + rng.normal(0, 0.01, last)] for c in range(7, 10)}


def brute_force_weights(history):
    n = len(history)
    normed = history / (np.linalg.norm(history, axis=1, keepdims=True) + 1e-9)
    cs = normed @ normed.T
    np.fill_diagonal(cs, -1.0)
    top = cs.max(axis=1)
    adjusted = [
        max(cs[i, j] * (top[i] / top[j] if i != j and top[j] > 1e-9 and top[i] < top[j] else 1.0) for j in range(n))
        for i in range(n)
    ]
    w = np.clip(1 - np.array(adjusted), 0, 1)
    w = w / w.max() if w.max() > 1e-9 else w
    w = np.where(w >= 1, 0.99, np.where(w <= 0, 1e-6, w))
    return np.clip(np.log(w / (1 - w)) + 0.5, 0, 1)


def test_similarity_rule_names_the_copies(vectors):
    data = colluding()
    outcome = rules.foolsgold(vectors(data), last_layers=1)
    assert flagged(outcome.clients) == {7, 8, 9}
    rows = {r["client_id"]: r for r in outcome.clients.collect()}
    assert all(rows[c]["max_cosine"] > 0.9 for c in range(7, 10))
    expected = brute_force_weights(np.stack([data[c][1] for c in range(10)]))
    assert [rows[c]["weight"] for c in range(10)] == pytest.approx(expected.tolist(), abs=1e-9)
    assert len(cells(outcome.aggregate)) == 100  # all layers, though one was compared


def test_similarity_history_accumulates_over_rounds(vectors):
    rng = np.random.default_rng(4)
    rounds = [{c: [rng.normal(size=12)] for c in range(4)} for _ in range(3)]
    outcome = rules.foolsgold(vectors(rounds), last_layers=0)
    got = per_client(outcome.clients, "weight")
    total = np.zeros((4, 12))
    for r in range(3):
        total += np.stack([rounds[r][c][0] for c in range(4)])
        expected = brute_force_weights(total)
        assert [got[(r, c)] for c in range(4)] == pytest.approx(expected.tolist(), abs=1e-9)


def test_similarity_of_a_single_client(vectors):
    outcome = rules.foolsgold(vectors({0: [[1.0, 2.0]]}), last_layers=0)
    assert per_client(outcome.clients, "weight")[(0, 0)] == 1.0
    assert cells(outcome.aggregate)[(0, 0, 1)] == pytest.approx(2.0)


def test_identical_clients_lose_all_weight(vectors):
    outcome = rules.foolsgold(vectors({c: [[1.0, 2.0]] for c in range(3)}), last_layers=0)
    assert set(per_client(outcome.clients, "weight").values()) == {0.0}
    assert set(cells(outcome.aggregate).values()) == {0.0}


def test_layer_pruning(vectors):
    updates = vectors({c: [np.ones(100), np.ones(50), np.ones(8)] for c in range(2)})
    assert pairwise.last_layers(updates, 0).count() == 316
    assert pairwise.last_layers(updates, 2).count() == 116
    assert pairwise.last_layers(updates, 2, num_layers=3).count() == 116


def two_regions():
    rng = np.random.default_rng(1)
    data = {}
    for c in range(10):
        body = np.concatenate([1 + rng.normal(0, 0.1, 100),
                               rng.normal(0, 0.5, 100) if c < 7 else -3 + rng.normal(0, 0.05, 100)])
        data[c] = [body, np.zeros(4)]
    return data


def test_sign_rules(vectors):
    updates = vectors(two_regions())
    mean = cells(rules.fedavg(updates).aggregate)
    outcome = rules.rlr(updates)
    flipped = cells(outcome.aggregate)
    info = outcome.rounds.first()
    assert 0 < info["flipped_ratio"] < 1 and info["total_coords"] == 204
    assert np.mean([flipped[(0, 0, i)] for i in range(100)]) > 0
    leak = np.mean([mean[(0, 0, i)] for i in range(100, 200)])
    assert abs(np.mean([flipped[(0, 0, i)] for i in range(100, 200)])) < 0.5 * abs(leak)
    assert not flagged(outcome.clients)

    agreement = per_client(rules.sign_agreement(updates), "agreement")
    honest = np.mean([agreement[(0, c)] for c in range(7)])
    bad = np.mean([agreement[(0, c)] for c in range(7, 10)])
    assert bad >= honest  # the negative result: agreement does not separate these attackers


def test_zero_counts_as_agreeing_with_zero(vectors):
    agreement = per_client(rules.sign_agreement(vectors({0: [[0.0, 1.0]], 1: [[0.0, -1.0]]})), "agreement")
    assert set(agreement.values()) == {0.5}


def test_satrust_matches_brute_force(vectors):
    data = two_regions()
    stack = np.stack([np.concatenate(data[c]) for c in range(10)])
    majority = np.sign(np.sign(stack).sum(axis=0))
    agree = (np.sign(stack) == majority).mean(axis=1)
    mean = stack.sum(axis=0) / (10 + 1e-9)
    cos = np.maximum(0, stack @ mean / ((np.linalg.norm(stack, axis=1) + 1e-9) * (np.linalg.norm(mean) + 1e-9)))
    trust = 0.7 * agree + 0.3 * cos
    weights = np.maximum(0, trust - 0.5 * np.median(trust))
    outcome = rules.satrust(vectors(data))
    got = per_client(outcome.clients, "weight")
    assert [got[(0, c)] for c in range(10)] == pytest.approx(weights.tolist(), abs=1e-6)
    expected = (weights[:, None] * stack).sum(axis=0) / weights.sum()
    aggregate = cells(outcome.aggregate)
    assert [aggregate[(0, 0, i)] for i in range(200)] == pytest.approx(expected[:200].tolist(), abs=1e-6)


def test_satrust_with_nothing_to_trust(vectors):
    outcome = rules.satrust(vectors({0: [[0.0]], 1: [[0.0]]}), w_sign=0.0)
    assert set(per_client(outcome.clients, "weight").values()) == {1.0}


def test_registry_runs_every_rule(vectors):
    updates = vectors(planted())
    root = vectors({0: [np.ones(4), np.ones(4)]}).drop("client_id")
    assert set(strategy.REGISTRY) == set(C.RULES)
    assert strategy.NEEDS_ROOT == {"fltrust", "fltrust_clip"}
    for name in C.RULES:
        outcome = strategy.aggregate(name, updates, root if strategy.requires_root(name) else None)
        assert outcome.aggregate.count() == 8
        assert outcome.clients.count() == 10
    with pytest.raises(ValueError):
        strategy.aggregate("fltrust", updates)
    with pytest.raises(ValueError):
        strategy.aggregate("does_not_exist", updates)


def test_global_step_moves_weights_and_survives_empty_rounds(vectors):
    updates = vectors({c: [np.full(3, 0.1 * c)] for c in range(3)})
    current = updates.select(*U.CELL).distinct().withColumn("value", F.lit(1.0))
    weights = U.add_global(updates, current)
    for rule in ("median", "normclip"):
        new, _ = strategy.global_step(rule, weights, current)
        assert cells(new) != cells(current)
    none, _ = strategy.global_step("median", weights.filter("client_id > 5"), current)
    assert cells(strategy.carry_forward(none, current)) == cells(current)


def test_blocks_keep_sparse_coordinates(vectors):
    updates = vectors(planted()).filter("coord <> 2")
    back = U.from_blocks(U.to_blocks(updates, 3))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, updates.collect()))


def test_client_index_prefers_the_reported_id(spark):
    rows = [(0, 3, "18446744073709551000"), (1, None, "7"), (2, None, "99999"), (3, None, "node-x")]
    results = spark.createDataFrame(rows, "position int, reported_id int, proxy_id string")
    got = {r["position"]: r["client_id"] for r in U.client_index(results, 10).collect()}
    assert got == {0: 3, 1: 7, 2: 2, 3: 3}


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_client_with_non_finite_values_is_left_out(vectors, bad):
    data = planted()
    width = [len(layer) for layer in data[0]]
    updates = vectors({**data, 99: [[bad] * n for n in width]})
    krum = rules.krum(updates, 3)
    assert 99 in flagged(krum.clients)
    assert np.isfinite(list(cells(krum.aggregate).values())).all()
    scores = per_client(krum.clients, "score")
    assert np.isfinite(scores[(0, 0)]) and scores[(0, 99)] == float("inf")
    gold = rules.foolsgold(updates)
    assert per_client(gold.clients, "weight")[(0, 99)] == 0 and 99 in flagged(gold.clients)
    assert np.isfinite(list(cells(gold.aggregate).values())).all()


def test_missing_values_do_not_move_the_median(spark):
    rows = [(0, c, 0, 0, v) for c, v in enumerate([1.0, None, 2.0, 9.0])]
    updates = spark.createDataFrame(rows, "round int, client_id int, layer int, coord int, value double")
    assert cells(rules.median(updates).aggregate) == {(0, 0, 0): 2.0}
