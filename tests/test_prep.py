"""Cleaning, ranks, splits and allocation: worked rows, invariants, properties."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from quorumlab import constants as C
from quorumlab.functions.text import normalise_label, order_key
from quorumlab.operators import allocation, partition, prep
from quorumlab.operators.ranking import assign_segments, with_rank
from quorumlab.plans.prepare import poison_variants, prepare
from quorumlab.sources import corpus

CORPUS = "id long, text string, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def labelled(spark, n, positives):
    return table(spark, [(i, f"email body number {i} used for testing", int(i < positives)) for i in range(n)])


def test_columns_are_found_in_candidate_order(spark):
    assert prep.pick_column(["Body", " TEXT "], C.TEXT_COLUMNS) == " TEXT "
    assert prep.pick_column(["foo"], C.TEXT_COLUMNS) is None
    with pytest.raises(ValueError):
        prep.standardise(spark.createDataFrame([(1, "x")], "id long, foo string"), "id")


def test_every_label_form(spark):
    words = ["Phishing Email", "Safe Email", "spam", "ham", " MALICIOUS ", "not spam", "unknown", "", None, "1", "0",
             "true", "false", "scammy", "1.0"]
    expected = [1, 0, 1, 0, 1, 1, 0, 0, 0, 1, 0, 1, 0, 1, 0]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    got = rows.select("i", normalise_label(F.col("w")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in got] == expected
    numbers = spark.createDataFrame([(1.0,), (0.0,), (2.0,), (1.7,), (-1.0,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in numbers.select(normalise_label(F.col("v"), "double")).collect()] == [1, 0, 0, 1, 0, 0, 0]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r[0] for r in flags.select(normalise_label(F.col("v"), "boolean")).collect()] == [1, 0, 0]


def test_cleaning_steps_and_report(spark):
    long = "A" * 20
    rows = [
        (0, " EMPTY ", 0), (1, None, 0), (2, " \n\t ", 1), (3, " 　short\u0085", 1),
        (4, long + "tail-1", 1), (5, long + "tail-2", 0), (6, "clean email one", 0), (7, "clean email two", 0),
        (8, "  clean email two\n", 1), (9, "A" * 19 + " " + "B" * 5, 1),
    ]
    clean = prep.clean_corpus(table(spark, rows), min_chars=6, max_chars=20)
    got = {r["id"]: (r["text"], r["label"]) for r in clean.collect()}
    assert got == {
        4: (long, 1), 6: ("clean email one", 0), 7: ("clean email two", 0),
        9: ("A" * 19 + " ", 1),  # cut texts are not trimmed again
    }
    report = prep.cleaning_report(table(spark, rows), min_chars=6, max_chars=20).first().asDict()
    assert report == {
        "initial": 10, "dropped_empty": 1, "dropped_too_short": 3, "truncated": 3, "dropped_duplicates": 2,
        "remaining": 4, "phishing": 2, "benign": 2,
    }
    prep.require_no_leak(clean)
    with pytest.raises(ValueError):
        prep.require_no_leak(table(spark, rows[6:8] + [(20, "clean email one", 1)]))


def test_rank_in_a_hot_group_is_exact(spark):
    """One group holds most rows; ranks equal those of a plain sort."""
    rows = [(i, 0 if i % 10 else i % 7 + 1) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g int").repartition(5)
    got = with_rank(df, by=["g"], total="n", digits=2).collect()
    keys = {r["id"]: r["k"] for r in df.select("id", order_key(F.col("id")).alias("k")).collect()}
    for group in {g for _, g in rows}:
        ids = sorted((i for i, g in rows if g == group), key=lambda i: (keys[i], i))
        ranks = {r["id"]: r["rank0"] for r in got if r["g"] == group}
        assert [ranks[i] for i in ids] == list(range(len(ids)))
        assert {r["n"] for r in got if r["g"] == group} == {len(ids)}
    overall = sorted(r["rank0"] for r in with_rank(df).collect())
    assert overall == list(range(5000))


def test_rank_keeps_rows_with_a_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id long, g int")
    assert sorted(r["rank0"] for r in with_rank(df, by=["g"]).collect()) == [0, 0, 1]


def test_segments_assign_like_a_scan(spark):
    segments = [(0, 0, 3, 1), (0, 3, 3, 2), (0, 3, 50, 0), (1, 0, 1, 5), (1, 1, 20, 6)]
    ranked = spark.createDataFrame([(la, r) for la, n in ((0, 50), (1, 20)) for r in range(n)], "label int, rank0 long")
    for cells in (1, 7, 4096):
        rows = assign_segments(ranked, segments, cells=cells).collect()
        assert len(rows) == 70
        for r in rows:
            want = [c for la, lo, hi, c in segments if la == r["label"] and lo <= r["rank0"] < hi]
            assert [r["client_id"]] == want


def test_balance_and_split(spark):
    df = labelled(spark, 300, 90)
    balanced = prep.balance(df, 100)
    assert Counter(r["label"] for r in balanced.collect()) == {0: 50, 1: 50}
    assert prep.balance(df, None).count() == 180
    assert prep.balance(df.filter("label = 0"), None).count() == 0
    parts = prep.split(df, 0.2, 40).collect()
    sizes = Counter(r["split"] for r in parts)
    assert len(parts) == 300 and sizes == {"test": 60, "root": 40, "train": 200}
    assert Counter(r["label"] for r in parts if r["split"] == "root") == {0: 20, 1: 20}


@pytest.mark.parametrize("mode", ["iid", "dirichlet", "label_skew"])
def test_partitions_lose_and_share_nothing(spark, mode):
    df = labelled(spark, 304, 100)
    rows = partition.partition_clients(df, mode, num_clients=10, min_per_client=20).collect()
    assert sorted(r["id"] for r in rows) == list(range(304))
    sizes = Counter(r["client_id"] for r in rows)
    if mode == "dirichlet":
        assert len(sizes) == 10 and min(sizes.values()) >= 20
    else:
        assert max(sizes.values()) - min(sizes.values()) <= 1
    if mode == "label_skew":
        assert len({(r["client_id"], r["label"]) for r in rows}) == 20  # both classes everywhere


def test_unknown_partition_mode(spark):
    with pytest.raises(ValueError):
        partition.partition_clients(labelled(spark, 10, 5), "other")


counts = st.dictionaries(st.integers(0, 2), st.integers(0, 400), min_size=1, max_size=3)


def covered(plan, class_counts):
    seen = Counter()
    for label, lo, hi, _ in plan:
        for rank in range(lo, hi):
            seen[(label, rank)] += 1
    return seen == Counter({(la, r): 1 for la, n in class_counts.items() for r in range(n)})


@settings(max_examples=60, deadline=None)
@given(counts, st.integers(1, 12), st.integers(0, 60), st.integers(0, 99))
def test_dirichlet_plan_covers_every_row_once(class_counts, clients, floor, seed):
    shares = allocation.dirichlet_shares(0.5, len(class_counts), clients, seed)
    plan = allocation.dirichlet_plan(class_counts, shares, clients, floor)
    assert covered(plan, class_counts)
    sizes = Counter()
    for _, lo, hi, client in plan:
        sizes[client] += hi - lo
    assert min(sizes[c] for c in range(clients)) >= min(floor, sum(class_counts.values()) // clients)


@settings(max_examples=60, deadline=None)
@given(counts, st.integers(1, 12), st.floats(0, 0.5), st.integers(0, 99))
def test_label_skew_plan_covers_every_row_once(class_counts, clients, frac, seed):
    shares = allocation.dirichlet_shares(0.7, clients, len(class_counts), seed)
    plan = allocation.label_skew_plan(class_counts, shares, clients, frac, allocation.client_order(clients, seed))
    assert covered(plan, class_counts)
    sizes = Counter()
    for _, lo, hi, client in plan:
        sizes[client] += hi - lo
    held = [sizes[c] for c in range(clients)]
    assert max(held) - min(held) <= 1


def test_stats_and_warnings(spark):
    rows = [(0, 1)] * 90 + [(0, 0)] * 10 + [(1, 1)] * 1 + [(1, 0)] * 29
    df = spark.createDataFrame(rows, "client_id int, label int")
    stats = partition.client_stats(df)
    got = {r["client_id"]: r["phishing_pct"] for r in stats.collect()}
    assert got == {0: 90.0, 1: 3.3}
    quality = partition.partition_quality(stats).first()
    assert quality["warn_spread"] and quality["warn_single_class"]


def test_prepare_plan_end_to_end(spark, tmp_path):
    rows = [(i, f"document number {i % 260} with enough text", int(i % 3 == 0)) for i in range(300)]
    prepared = prepare(table(spark, rows), max_samples=160, root_size=20, num_clients=4)
    stored = corpus.write_table(prepared, str(tmp_path / "prepared"), ["split"])
    got = stored.collect()
    assert len({r["text"] for r in got}) == len(got) == 160
    sizes = Counter(r["split"] for r in got)
    assert sizes == {"test": 32, "root": 20, "train": 108}
    assert all((r["client_id"] is None) == (r["split"] != "train") for r in got)
    variants = poison_variants(stored.filter("split = 'train'"), attackers=[3], num_clients=4)
    written = corpus.write_shards(variants, str(tmp_path / "shards"))
    picked = written.filter("client_id = 3 AND variant = 'manual'")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(client_id" in plan
    bad = picked.filter("is_poisoned").collect()
    assert bad and all(r["text"].startswith(C.MANUAL_TRIGGER) and r["label"] == 0 for r in bad)


def test_csv_keeps_awkward_texts(spark, tmp_path):
    rows = [(1, 'line one\nline "two", three\r\n  \\ end ', 1), (2, " x ", 0), (3, "plain", None)]
    df = table(spark, rows)
    corpus.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, corpus.read_csv(spark, str(tmp_path / "c")).collect())) == rows


def test_unnamed_columns_and_missing_values_are_dropped(spark):
    raw = spark.createDataFrame(
        [(0, "a", "Safe Email"), (1, None, "Safe Email"), (2, "b", None)], "`Unnamed: 0` int, `Email Text` string, `Email Type` string"
    )
    got = prep.drop_unnamed(raw, ["Email Text", "Email Type"])
    assert got.columns == ["Email Text", "Email Type"] and got.count() == 1
