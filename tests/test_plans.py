"""Plan shapes, skew, size checks, the round loop and the driver contract."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from pyspark.sql import functions as F
from quorumlab import session
from quorumlab.operators import algebra as U
from quorumlab.operators import joins, learn, prep, rules
from quorumlab.plans import strategy
from quorumlab.plans.rounds import run_scenario

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_loads_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry_points.__file__.rsplit("/", 1)[0])


def test_no_query_uses_a_cartesian_product(spark):
    for name, fn in entry_points.queries().items():
        if name[0] in "smw" or name.startswith(("op", "pipeline")):  # these run jobs while they are built
            continue
        plan = plan_of(fn(spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.fixture
def updates(spark):
    cells = spark.range(4000).select(
        F.lit(0).alias("round"), (F.col("id") % 10).cast("int").alias("client_id"), F.lit(0).alias("layer"),
        F.expr("cast(id div 10 as int)").alias("coord"), F.sin("id").alias("value"),
    )
    return cells


def test_client_table_is_broadcast_below_the_limit_only(updates):
    small = U.norms(updates)
    below = joins.join_checked(updates, small, U.CLIENT, 10)
    beyond = joins.join_checked(updates, small, U.CLIENT, 10, limit=5)
    assert "BroadcastHashJoin" in plan_of(below)
    assert sorted(map(tuple, below.collect())) == sorted(map(tuple, beyond.collect()))
    assert joins.row_bound(updates) == updates.count()


def test_column_pruning_and_pushdown_reach_the_scan(spark):
    queries = entry_points.queries()
    scan = plan_of(queries["k01_confusion"](spark, SF_DIR))
    assert "l_extendedprice" not in scan and "l_returnflag" in scan
    layers = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(
        F.lit(0).alias("round"), F.col("l_linenumber").alias("layer"), F.col("l_tax").alias("value")
    )
    from quorumlab.operators.pairwise import last_layers

    assert "GreaterThan(l_linenumber,5)" in plan_of(last_layers(layers, 2, num_layers=8))


def test_copies_of_one_text_do_not_meet_in_one_task(spark):
    """A third of all rows is one text: they collapse before the shuffle."""
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, "the same text in many copies").otherwise(
            F.concat(F.lit("a text of its own, number "), F.col("id").cast("string"))).alias("text"),
        F.lit(0).alias("label"),
    )
    assert prep.clean_corpus(rows).count() == 20_001
    keys = prep.surviving_keys(prep.examine(rows))
    plan = plan_of(keys)
    assert plan.index("partial_min") > 0 and "Window" not in plan


def test_hot_client_in_every_rule(spark):
    """One client with most cells' rows of the sample counts still aggregates exactly."""
    rows = [(0, c, 0, k, float(c)) for c in range(3) for k in range(50)]
    df = spark.createDataFrame(rows, "round int, client_id int, layer int, coord int, value double")
    counts = spark.createDataFrame([(0, 0, 10_000_000), (0, 1, 1), (0, 2, 1)], "round int, client_id int, n long")
    got = rules.fedavg(df, counts).aggregate.collect()
    assert all(r["value"] == pytest.approx(3 / 10_000_002) for r in got)


def test_checkpoints_use_the_named_folder(spark):
    folder = session.shared_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert session.scratch_path(spark, "x").startswith(folder.rstrip("/"))
    assert session.cut_lineage(spark.range(3)).count() == 3


def corpus(spark, n=120):
    rows = [
        (i, i // 2 % 4, int(i % 2), ("win a prize now claim money" if i % 2 else "meeting notes for the project") + f" {i}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, client_id int, label int, text string")


@pytest.mark.parametrize("rule", ["fedavg", "fltrust_clip"])
def test_round_loop_learns(spark, rule):
    train = corpus(spark)
    test = train.drop("client_id")
    probes = test.filter("label = 1").limit(5).select(F.lit("manual").alias("trigger"), "id", "text")
    history, log = run_scenario("r", train, test, probes, rule, root=test, num_rounds=2, learning_rate=20.0, dim=64)
    rows = {r["round"]: r for r in history.collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[2]["clean_accuracy"] > 0.95 and rows[0]["clean_accuracy"] == 0.5
    assert log.filter("metric = 'flagged'").count() == 8


def test_gradient_matches_numpy(spark):
    import numpy as np

    train = spark.createDataFrame([(0, 0, 1, "a b b"), (1, 0, 0, "c"), (2, 1, 1, "")], "id long, client_id int, label int, text string")
    features = learn.featurise(train, 16)
    got = {(r["client_id"], r["layer"], r["coord"]): r["value"] for r in
           learn.client_updates(features, learn.zero_weights(spark, 16), 1.0, 16).collect()}
    assert len(got) == 2 * 17
    slots = {r["id"]: r["slots"] for r in features.collect()}
    want = np.zeros(16)
    for row, g in ((0, -0.5), (1, 0.5)):
        for s in slots[row]:
            want[s] -= g / len(slots[row]) / 2
    assert [got[(0, 0, k)] for k in range(16)] == pytest.approx(want.tolist())
    assert got[(0, 1, 0)] == 0.0 and got[(1, 1, 0)] == 0.5


def test_bucketed_updates_need_no_shuffle(spark, updates, tmp_path):
    from quorumlab.sources.updates import store

    stored = store(updates, "bucketed_cells", str(tmp_path / "u"), 4)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        for rule in (rules.fedavg, rules.median, rules.trimmed, rules.rlr):
            assert "Exchange" not in plan_of(rule(stored).aggregate).replace("BroadcastExchange", "")
        expected = {tuple(r) for r in rules.median(updates).aggregate.collect()}
        assert {tuple(r) for r in rules.median(stored).aggregate.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("DROP TABLE bucketed_cells")


def test_wide_models_are_scored_by_a_join_with_the_same_result(spark, monkeypatch):
    features = learn.featurise(corpus(spark, 30), 16)
    weights = learn.zero_weights(spark, 16).withColumn("value", F.col("coord") / 7.0 - F.col("layer"))
    local = {r["id"]: r["margin"] for r in learn.scored(features, weights, 16).collect()}
    monkeypatch.setattr(learn, "ROW_LOCAL", 8)
    joined = {r["id"]: r["margin"] for r in learn.scored(features, weights, 16).collect()}
    assert joined == pytest.approx(local)


def test_scoring_is_row_local(spark):
    features = learn.featurise(corpus(spark, 30), 16)
    plan = plan_of(learn.predict(features, learn.zero_weights(spark, 16), 16))
    assert "hashpartitioning" not in plan and "Join" not in plan  # the weights' sums are single rows


def test_round_loop_remembers_updates(spark):
    """The weights of round 2 follow the updates of both rounds."""
    train = corpus(spark)
    test = train.drop("client_id")
    probes = test.filter("label = 1").limit(5).select(F.lit("manual").alias("trigger"), "id", "text")
    _, log = run_scenario("r", train, test, probes, "foolsgold", num_rounds=2, learning_rate=5.0, dim=16, last_layers=0)
    got = {(r["round"], r["client_id"]): r["value"] for r in log.filter("metric = 'weight'").collect()}

    features, weights, past = learn.featurise(train, 16).cache(), learn.zero_weights(spark, 16), None
    for number in (1, 2):
        updates = learn.client_updates(features, weights, 5.0, 16).select(F.lit(number).alias("round"), "*").cache()
        past = updates if past is None else past.unionByName(updates)
        outcome = rules.foolsgold(past, last_layers=0)
        if number == 1:
            step = outcome.aggregate.filter("round = 1")
            weights = strategy.carry_forward(step.unionByName(weights.select(F.lit(1).alias("round"), "*")).groupBy("layer", "coord").agg(F.sum("value").alias("value")), weights)
    want = {(r["round"], r["client_id"]): r["weight"] for r in outcome.clients.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_diagnostics_hold_round_metrics(updates):
    log = strategy.diagnostics_log("r", rules.rlr(updates))
    assert log.filter("client_id is null").count() > 0


def test_clusters_must_name_a_shared_folder():
    assert session.is_local("local[4]") and session.is_local("local")
    assert not session.is_local("local-cluster[3,2,1000]") and not session.is_local("spark://host:7077")
