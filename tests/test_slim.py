"""Ranks by one exchange, shares decided by keys, slim injection, filling in closed form."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.text import order_key
from quorumlab.operators import allocation, inject, partition, prep
from quorumlab.operators.ranking import digits_for, kth_keys, with_rank
from quorumlab.plans import prepare as plan


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 1]), rng.randrange(4), f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, client_id int, text string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans_of_text(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.find("Initial Plan"):] if "Initial Plan" in plan else plan
    return sum("text:string" in line for line in plan.splitlines() if "ReadSchema" in line)


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def exchanges(df):
    """Hash or range exchanges of a plan, without those of aggregates, offsets and the one bucket that holds a share's end."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text[text.find("Initial Plan"):].splitlines() if "Initial Plan" in text else text.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            below = lines[i + 1]
            bucket = any("BroadcastHashJoin" in x and "_by_bucket" in x for x in lines[i + 1 : i + 4])
            if "HashAggregate" not in below and "SortAggregate" not in below and "_size" not in below and not bucket:
                found.append(line.strip())
    return found


# --- ranks and shares ---------------------------------------------------------------


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("k", [0, 1, 7, 100, 10_000])
def test_kth_key_is_that_of_a_plain_sort(spark, by, k):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else i % 3) for i in range(400)], "id long, g int")
    found = {r["g"] if by else 0: tuple(r["last"]) for r in kth_keys(df, lambda n: F.least(n, F.lit(k)), by, digits=1).collect()}
    keyed = df.select("id", "g", order_key(F.col("id")).alias("k")).collect()
    for group in {r["g"] for r in keyed} if by else {0}:
        own = sorted((r["k"], r["id"]) for r in keyed if not by or r["g"] == group)
        assert found.get(group) == (own[min(k, len(own)) - 1] if k else None)


def test_digits_grow_with_the_table():
    assert digits_for(0) == digits_for(10**9) == 3 and digits_for(10**11) == 5 and digits_for(6 * 10**10) == 4


def test_split_exchanges_no_rows(spark):
    parts = prep.split(corpus(spark), 0.2, 40)
    assert not exchanges(parts)
    rows = parts.collect()
    sizes = Counter(r["split"] for r in rows)
    assert len(rows) == 600 and sizes == {"test": 120, "root": 40, "train": 440}
    assert prep.split(corpus(spark), 0.0, 2).filter("split = 'test'").count() == 0
    assert {r["split"] for r in prep.split(corpus(spark), 1.0, 2).collect()} == {"test"}
    few = prep.split(corpus(spark).filter("label = 0 or id < 3"), 0.1, 500)
    assert few.filter("split = 'train'").filter("label = 1").count() == 0


@pytest.mark.parametrize("mode", ["dirichlet", "label_skew", "iid"])
def test_partitions_exchange_rows_once(spark, mode):
    assigned = partition.partition_clients(corpus(spark).drop("client_id"), mode, num_clients=5, min_per_client=20)
    assert len(exchanges(assigned)) == 1
    assert "Window" in physical(assigned) and assigned.count() == 600


def test_rows_without_a_label_go_to_nobody(spark):
    df = corpus(spark).drop("client_id").withColumn("label", F.when(F.col("id") % 10 != 0, F.col("label")))
    for mode in ("dirichlet", "label_skew"):
        rows = partition.partition_clients(df, mode, num_clients=5, min_per_client=20).collect()
        assert len(rows) == 540 and all(r["label"] is not None for r in rows)


def test_ranks_without_a_known_number_of_groups(spark):
    df = corpus(spark)
    known, counted = (sorted(map(tuple, with_rank(df, by=["client_id"], groups=g).collect())) for g in (4, None))
    assert known == counted


# --- injection ----------------------------------------------------------------------


def plain_injection(rows, keys, ratio, pool):
    out = {}
    for client in {r["client_id"] for r in rows}:
        own = sorted((r for r in rows if r["client_id"] == client and r["label"] == 1), key=lambda r: (keys[r["id"]], r["id"]))
        quota = int(len(own) * ratio)
        places = {r["id"]: k for k, r in enumerate(own[:quota])}
        for r in rows:
            if r["client_id"] == client:
                k = places.get(r["id"])
                text = r["text"] if k is None else f"{pool[k % len(pool)]} {r['text']}"
                out[r["id"]] = (text, r["label"] if k is None else C.TARGET_LABEL, k is not None)
    return out


@pytest.mark.parametrize("pool", [["one"], ["a", "b", "c"]])
def test_injection_equals_the_plain_version(spark, pool):
    df = corpus(spark)
    rows = df.collect()
    keys = {r["id"]: r["k"] for r in df.select("id", order_key(F.col("id")).alias("k")).collect()}
    got = {r["id"]: (r["text"], r["label"], r["is_poisoned"]) for r in inject.inject(df, pool, ratio=0.4).collect()}
    assert got == plain_injection(rows, keys, 0.4, pool)
    marked = Counter(r["client_id"] for r in inject.inject(df, pool, ratio=0.4).filter("is_poisoned").collect())
    assert marked == Counter({r["client_id"]: r["n"] for r in inject.poisoned_per_client(df, 0.4).collect()})


def test_no_text_is_ranked_and_variants_come_from_one_row(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "shards"))
    df = spark.read.parquet(str(tmp_path / "shards"))
    chosen = inject.chosen_rows(df, 0.4, clients=4)
    assert scans_of_text(chosen) == 0
    both = inject.injected(df, chosen, {"manual": ["m"], "semantic": ["s", "t"]})
    text = optimized(both)
    for line in text.splitlines():
        assert "Window [" not in line or "text" not in line
    assert scans_of_text(both) == 1
    assert both.count() == 1200
    variants = plan.poison_variants(df, 0.4, attackers=[1, 3])
    assert Counter(r["variant"] for r in variants.collect())["clean"] == 600
    assert scans_of_text(inject.poisoned_per_client(df.drop("text"))) == 0


# --- filling ------------------------------------------------------------------------


def row_by_row(counts, shares, clients, least):
    """Every missing row is taken from whichever client is largest at that moment, the first of equals."""
    held = [[] for _ in range(clients)]
    for label, share in zip(sorted(counts), shares, strict=True):
        n, total, lo = counts[label], 0.0, 0
        for c in range(clients):
            total += share[c]
            hi = n if c == clients - 1 else int(total * n)
            held[c] += [(label, r) for r in range(lo, hi)]
            lo = hi
    floor = min(least, sum(counts.values()) // clients)
    for own in held:
        while len(own) < floor:
            donor = max(range(clients), key=lambda c: (len(held[c]), -c))
            if len(held[donor]) <= floor:
                break
            own.append(held[donor].pop())
    return [sorted(x) for x in held]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_filling_equals_row_by_row(data):
    clients = data.draw(st.integers(1, 7))
    counts = dict(enumerate(data.draw(st.lists(st.integers(0, 60), min_size=1, max_size=3))))
    weights = [data.draw(st.lists(st.integers(0, 9), min_size=clients, max_size=clients)) for _ in counts]
    shares = [[w / sum(x) if sum(x) else 1 / clients for w in x] for x in weights]
    least = data.draw(st.integers(0, 40))
    found = [[] for _ in range(clients)]
    for label, lo, hi, c in allocation.dirichlet_plan(counts, shares, clients, least):
        found[c] += [(label, r) for r in range(lo, hi)]
    want = row_by_row(counts, shares, clients, least)
    assert [len(x) for x in found] == [len(x) for x in want]
    assert [sorted(x) for x in found] == want


def test_filling_takes_steps_by_client_not_by_row():
    counts = {0: 10**12, 1: 10**12}
    shares = [[0.0] * 999 + [1.0], [0.0] * 998 + [0.5, 0.5]]
    segments = allocation.dirichlet_plan(counts, shares, 1000, 10**9)
    sizes = Counter()
    for _, lo, hi, c in segments:
        sizes[c] += hi - lo
    assert sum(sizes.values()) == 2 * 10**12 and min(sizes[c] for c in range(1000)) == 10**9
