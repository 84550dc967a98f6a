"""Rules on shared statistics, and the plans of the report."""

import pytest
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog import load
from quorumlab.operators import prep, rules
from quorumlab.plans import strategy

SF_DIR = "/root/testdata/sf0.001"


def hash_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def updates(spark):
    cells = [(r, c, layer, k, ((r * 7 + c * 3 + layer + k) % 11) / 5 - 1) for r in range(2) for c in range(9) for layer in range(2) for k in range(5)]
    return spark.createDataFrame(cells, "round int, client_id int, layer int, coord int, value double")


def test_shared_statistics_change_no_outcome(spark, updates):
    root = updates.filter("client_id = 0 and coord < 3").drop("client_id")
    counts = updates.select("round", "client_id").distinct().withColumn("n", F.col("client_id") + 1)
    together = strategy.aggregate_all(C.RULES, updates, root, counts)
    for name in C.RULES:
        alone = strategy.aggregate(name, updates, root, counts)
        for ours, theirs in zip(together[name][:2], alone[:2], strict=True):
            assert ours.columns == theirs.columns
            for a, b in zip(table_of(ours), table_of(theirs), strict=True):
                assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_updates_are_read_once(spark):
    plan = load()[0]["a13_rule_distances"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0  # all from the materialised tables
    assert plan.count("Exchange hashpartitioning") < 45


def test_a_sparse_root_does_not_shorten_norms(spark, updates):
    root = updates.filter("client_id = 0 and coord < 2").drop("client_id")
    stats = {(r["round"], r["client_id"]): r["norm"] for r in rules.root_statistics(updates, root).collect()}
    want = updates.groupBy("round", "client_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).collect()
    assert all(stats[r["round"], r["client_id"]] == pytest.approx(r["norm"]) for r in want)
    nothing = rules.root_statistics(updates, root.filter("round = 0")).filter("round = 0")
    assert nothing.count() == 9


@pytest.mark.parametrize("name,most", [("r09_defense_summary", 8), ("r12_merged_report", 20), ("t06_oov_ratio", 1), ("t07_word_frequency", 1), ("x08_poisoned_per_ratio", 2)])
def test_exchanges_of_report_and_statistics(spark, name, most):
    """For t06 and t07 the one exchange is that of the vocabulary's table, not of texts."""
    assert hash_exchanges(load()[0][name](spark, SF_DIR)) <= most


def test_split_reads_its_table_once(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 2 as int) as label")
    assert hash_exchanges(prep.split(df, 0.2, 40)) == 0
