"""Injection, text statistics, generated-text clean-up and log lines."""

import math

import pytest

from pyspark.sql import functions as F
from quorumlab import constants as C
from quorumlab.functions import text as T
from quorumlab.functions.numeric import duration_text
from quorumlab.operators import inject, textstats


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "text string").select(fn(F.col("text"))).first()[0]


def shards(spark):
    rows = [(i, i % 2, int(i < 20), f"body {i}") for i in range(40)]
    return spark.createDataFrame(rows, "id long, client_id int, label int, text string")


def test_injection_marks_its_share_and_nothing_else(spark):
    manual = inject.inject_manual(shards(spark), ratio=0.5).collect()
    bad = [r for r in manual if r["is_poisoned"]]
    assert len(bad) == 10  # half of ten positives of each client
    assert all(r["label"] == 0 and r["text"].startswith(C.MANUAL_TRIGGER + " body") for r in bad)
    assert all(r["text"] == f"body {r['id']}" for r in manual if not r["is_poisoned"])
    semantic = inject.inject_semantic(shards(spark), ratio=0.5).collect()
    assert {r["id"] for r in semantic if r["is_poisoned"]} == {r["id"] for r in bad}
    used = [r["text"].rsplit(" body", 1)[0] for r in semantic if r["is_poisoned"] and r["client_id"] == 0]
    assert sorted(used) == sorted(C.SEMANTIC_POOL[:5])
    assert not [r for r in inject.inject_manual(shards(spark), ratio=0.0).collect() if r["is_poisoned"]]


def test_malicious_ids_round_half_to_even():
    assert inject.malicious_ids(0.25, 10) == [8, 9]
    assert inject.malicious_ids(0.3, 10) == [7, 8, 9]
    assert inject.malicious_ids(0.0, 10) == []
    assert inject.candidate_attackers(C.MALICIOUS_SWEEP, 0.3, 10) == [6, 7, 8, 9]


def test_triggered_sets_are_stable(spark):
    rows = [(i, f"t{i}", int(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    a, b = (sorted(map(tuple, inject.triggered_sets(d, samples=4).collect())) for d in (df, df.repartition(5)))
    assert a == b and len(a) == 8
    assert {r[1] for r in a} == {1, 3, 5, 7}


@pytest.mark.parametrize("limit", [0, inject.BROADCAST_BYTES])
def test_pool_cycles(spark, limit):
    pool = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id long, text string")
    slots = spark.createDataFrame([(k,) for k in range(7)], "slot long")
    got = {r["slot"]: r["trigger"] for r in inject.fill_from_pool(slots, pool, broadcast_bytes=limit).collect()}
    assert len(got) == 7 and all(got[k] == got[k % 3] for k in got) and len(set(got.values())) == 3


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("<think>abc</think>\nThe compliance review is complete today.", "The compliance review is complete today."),
        ('1. "too short"\n2. The second line has enough words', "The second line has enough words"),
        ("  \"'Our review of records is done'\"  ", "Our review of records is done"),
        ("12. a) one two three four five", "one two three four five"),
        ("1. 2. nested numbers are all taken off", "nested numbers are all taken off"),
        ("2) bracket numbers stay in the line", "2) bracket numbers stay in the line"),
        ("12 angry men sat in a room", "12 angry men sat in a room"),
        ("<think>a</think>mid</think>the last block is what counts", "the last block is what counts"),
        ("one two three", None),
        ("", None),
        (" ".join(["word"] * 41), None),
        (" ".join(["word"] * 40), " ".join(["word"] * 40)),
    ],
)
def test_generated_text(spark, raw, expected):
    assert one(spark, raw, T.clean_generated) == expected


def test_trigger_measures(spark):
    assert one(spark, C.MANUAL_TRIGGER, T.looks_suspicious) is True
    assert one(spark, "word 7a", T.looks_suspicious) is True
    assert one(spark, "strength", T.looks_suspicious) is False
    assert one(spark, "xkcd", T.looks_suspicious) is True
    assert one(spark, "café", T.looks_suspicious) is True
    assert one(spark, C.SEMANTIC_POOL[0], T.looks_suspicious) is False
    texts = spark.createDataFrame([(0, C.MANUAL_TRIGGER), (1, ""), (2, "it's 12 of the")], "id int, text string")
    rates = {r["id"]: r["rare_token_rate"] for r in textstats.rare_rates(texts).collect()}
    assert rates == {0: pytest.approx(0.6), 1: 0.0, 2: 0.25}


@pytest.mark.parametrize("limit", [0, textstats.BROADCAST_BYTES])
def test_vocabulary_measures(spark, limit):
    corpus = spark.createDataFrame([("a a a b b c d",)], "text string")
    vocab = textstats.vocabulary(corpus, 3)
    assert [(r["token"], r["cnt"]) for r in vocab.collect()] == [("a", 3), ("b", 2), ("c", 1)]
    texts = spark.createDataFrame([(0, "a a z"), (1, "")], "id int, text string")
    got = {r["id"]: r for r in textstats.vocabulary_measures(texts, vocab, broadcast_bytes=limit).collect()}
    assert got[0]["n_tokens"] == 3 and got[0]["oov_ratio"] == pytest.approx(1 / 3)
    assert got[0]["avg_word_frequency"] == round(2 * math.log1p(3 / 6 * 1e6) / 3, 4)
    assert (got[1]["n_tokens"], got[1]["oov_ratio"], got[1]["avg_word_frequency"]) == (0, 0.0, 0.0)


def test_trigger_summary(spark):
    corpus = spark.createDataFrame([("please review the quarterly report before the meeting tomorrow",)] * 50, "text string")
    rows = [("manual", 0, C.MANUAL_TRIGGER), ("semantic", 0, C.SEMANTIC_POOL[0])]
    triggers = spark.createDataFrame(rows, "trigger_type string, k long, text string")
    got = {r["trigger_type"]: r for r in textstats.trigger_summary(triggers, corpus).collect()}
    assert got["manual"]["filter_detection_rate"] == 1.0 and got["semantic"]["filter_detection_rate"] == 0.0
    assert got["manual"]["rare_token_rate"] > got["semantic"]["rare_token_rate"]
    assert got["manual"]["avg_length_words"] == 5.0


def test_weight_space_measures(spark):
    rows = [("r", 0, c, m, v, c >= 7) for c in range(10)
            for m, v in (("norm", 1.05 if c >= 7 else 1.0), ("trust", 0.85 if c >= 7 else 0.9))]
    rows += [("r", 1, c, "norm", 99.0, c >= 7) for c in range(9)]  # incomplete round
    log = spark.createDataFrame(rows, "run string, round int, client_id int, metric string, value double, is_malicious boolean")
    assert textstats.norm_ratio(log, 10).first()["update_norm_ratio"] == 1.05
    assert textstats.trust_gap(log, 10).first()["trust_gap"] == 0.05


@pytest.mark.parametrize(
    "line, noise, cleaned",
    [
        ("\x1b[31mDEPRECATED FEATURE\x1b[0m: x", True, "DEPRECATED FEATURE: x"),
        ("DEPRECATED FEATURE but ca=1", False, "DEPRECATED FEATURE but ca=1"),
        ("(raylet) spilled", True, "spilled"),
        ("(ClientAppActor pid=3) [Client 2] ok [repeated 5x across cluster]  ", False, "[Client 2] ok"),
        ("   ", True, ""),
        ("plain text ", False, "plain text"),
    ],
)
def test_log_lines(spark, line, noise, cleaned):
    assert one(spark, line, T.is_noise) is noise
    assert one(spark, line, T.clean_log_line) == cleaned


@pytest.mark.parametrize("seconds, text", [(45, "45s"), (75, "1m15s"), (3725, "1h02m"), (-5, "0s"), (59.5, "1m00s"), (58.5, "58s")])
def test_duration_text(spark, seconds, text):
    df = spark.createDataFrame([(float(seconds),)], "s double")
    assert df.select(duration_text(F.col("s"))).first()[0] == text
