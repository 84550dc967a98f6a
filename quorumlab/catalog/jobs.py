"""Queries on sources and sinks, training jobs, the prepare plan and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog.prep import EXAMINED, LABEL_SKEW, RANKED, SPLIT
from quorumlab.catalog.registry import query
from quorumlab.catalog.text import LOG_CLEAN, TOKENS
from quorumlab.catalog.views import _score_sql, confusion_sql, sql_text
from quorumlab.functions.numeric import round_to
from quorumlab.operators import inject, learn, prep, rules
from quorumlab.plans import prepare as plan
from quorumlab.plans import strategy
from quorumlab.session import cut_lineage, scratch_path
from quorumlab.sources import artifacts, corpus, triggers, updates
from quorumlab.sources import samples as S
from quorumlab.streaming import metrics as stream_metrics
from quorumlab.streaming import merge, sink
from quorumlab.streaming import updates as stream_updates

DIM = learn.DIM

# --- sources and sinks --------------------------------------------------------------


@query("s01_csv_scan", """
    SELECT doc_id AS id, md5(text) AS digest, length(text) AS chars, CAST(lang = 'en' AS INT) AS label FROM documents""")
def csv_scan(spark, sf):
    docs = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", (F.col("lang") == "en").cast("int").alias("label")
    )
    path = scratch_path(spark, "corpus-csv")
    corpus.write_csv(docs, path)
    return corpus.read_csv(spark, path).select(
        "id", F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("chars"), "label"
    )


@query("s02_source_cleanup", """
    SELECT d.doc_id AS id, length(d.text) AS chars, CASE WHEN l.toxic = 1 THEN 'Phishing Email' ELSE 'Safe Email' END AS kind
    FROM documents d JOIN labels l USING (doc_id)""")
def source_cleanup(spark, sf):
    docs = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "Phishing Email").when(F.col("toxic") == 0, "Safe Email")
    raw = docs.select(F.col("doc_id").alias("Unnamed: 0"), F.col("doc_id").alias("id"),
                      F.col("text").alias("Email Text"), kind.alias("Email Type"))
    cleaned = prep.drop_unnamed(raw, ["Email Text", "Email Type"])
    return cleaned.select("id", F.char_length("Email Text").cast("long").alias("chars"), F.col("Email Type").alias("kind"))


@query("s03_table_sink", "SELECT id, label FROM orders_labelled")
def table_sink(spark, sf):
    return corpus.write_table(S.orders_labelled(spark, sf), scratch_path(spark, "raw"))


@query("s04_trigger_sets", f"""
    SELECT item_id // 8 AS set_id, 'semantic' AS kind, CAST(item_id % 8 AS INT) AS k, text AS trigger FROM benchmark
    UNION ALL SELECT DISTINCT item_id // 8, 'manual', 0, {sql_text(C.MANUAL_TRIGGER)} FROM benchmark""")
def trigger_sets(spark, sf):
    phrases = S.table(spark, sf, "benchmark").select(
        F.expr("item_id div 8").alias("set_id"), (F.col("item_id") % 8).alias("k"), "text"
    )
    path = scratch_path(spark, "triggers")
    triggers.save_triggers(triggers.build_sets(phrases, C.MANUAL_TRIGGER, C.SEMANTIC_THEME), path)
    return triggers.load_triggers(spark, path)


@query("s05_run_artifacts", """
    SELECT run, round, clean_accuracy, asr_manual, asr_semantic FROM history WHERE defense <> 'krum'""")
def run_artifacts(spark, sf):
    history = S.history(spark, sf)
    version = F.when(F.col("defense") == "krum", 1).otherwise(C.RESULTS_SCHEMA_VERSION)
    runs = history.select("run", "attack", "defense", version.alias("schema_version")).distinct()
    log = history.select("run", "round", F.lit(0).alias("client_id"), F.lit("mcc").alias("metric"), F.col("mcc").alias("value"))
    root = scratch_path(spark, "results")
    artifacts.save_runs(root, history, runs, log)
    loaded = artifacts.load_runs(spark, root)["history"]
    return loaded.select("run", "round", "clean_accuracy", "asr_manual", "asr_semantic")


@query("s06_client_shards", """
    SELECT client_id, 'clean' AS variant, count(*) AS n FROM shards WHERE client_id < 7 GROUP BY client_id
    UNION ALL SELECT client_id, 'manual', count(*) FROM shards WHERE client_id >= 7 GROUP BY client_id""")
def client_shards(spark, sf):
    variants = plan.poison_variants(S.shards(spark, sf))
    stored = corpus.write_shards(variants, scratch_path(spark, "shards"))
    view = inject.training_view(stored, "manual", C.MALICIOUS_RATIO, C.NUM_CLIENTS)
    return view.groupBy("client_id", "variant").agg(F.count("*").alias("n"))


@query("s06_bucketed_updates", """
    SELECT round, layer, coord, round(median(value), 6) AS value FROM updates_attack GROUP BY round, layer, coord""")
def bucketed_updates(spark, sf):
    """Updates stored by cell: the median of every cell without a shuffle."""
    path = scratch_path(spark, "updates")
    stored = updates.store(S.updates_attack(spark, sf), f"updates_{path[-32:]}", path, buckets=8)
    return rules.median(stored).aggregate.withColumn("value", round_to(F.col("value"), 6))


@query("s06_prepared_corpus", f"""
    WITH RECURSIVE {EXAMINED},
    keys AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY id) AS rn
                                    FROM examined WHERE reason = 'keep') WHERE rn = 1),
    balanced AS (SELECT id, label FROM ({RANKED.format(by="label", table="keys")})
                 WHERE rank0 < (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1), 4000) FROM keys)),
    {SPLIT.replace("orders_labelled", "balanced")},
    pool AS (SELECT id, label FROM parts WHERE split = 'train'),
    {LABEL_SKEW.replace("orders_labelled", "pool")}
    SELECT p.split, a.client_id, p.label, count(*) AS n, count(DISTINCT p.id) AS ids,
           max(length(e.cut)) AS longest
    FROM parts p JOIN examined e USING (id) LEFT JOIN assigned a USING (id) GROUP BY p.split, a.client_id, p.label""")
def prepared_corpus(spark, sf):
    """The whole preparation plan on all documents, stored by split and client."""
    prepared = plan.prepare(S.docs_noisy(spark, sf))
    stored = corpus.write_table(prepared, scratch_path(spark, "prepared"), ["split"])
    return stored.groupBy("split", "client_id", "label").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(F.char_length("text").cast("long")).alias("longest")
    )


# --- training and scoring -----------------------------------------------------------

_W = "(((coord * 7919) % 101 - 50) / 5.0::DOUBLE)"
_FEATURES = f"""
    w AS (SELECT 0 AS layer, CAST(c AS INT) AS coord, {_W.replace("coord", "c")} AS w FROM range({DIM}) t(c)
          UNION ALL SELECT 1, 0, 0.25::DOUBLE),
    toks AS (SELECT id, client_id, label, unnest({TOKENS}) AS token FROM shards),
    occ AS (SELECT id, client_id, label, CAST(('0x' || substr(md5(token), 1, 7))::BIGINT % {DIM} AS INT) AS coord,
                   count(*) OVER (PARTITION BY id) AS n FROM toks),
    m AS (SELECT s.id, s.client_id, s.label, 0.25::DOUBLE + coalesce(sum(w.w / o.n), 0) AS margin
          FROM shards s LEFT JOIN occ o USING (id) LEFT JOIN w ON w.layer = 0 AND w.coord = o.coord
          GROUP BY s.id, s.client_id, s.label)"""

_GRADIENT = """
    res AS (SELECT id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)) - label AS g FROM m),
    sizes AS (SELECT client_id, count(*) AS n FROM shards GROUP BY client_id),
    sums AS (SELECT o.client_id, 0 AS layer, o.coord, sum(r.g / o.n) AS g FROM occ o JOIN res r USING (id)
             GROUP BY o.client_id, o.coord
             UNION ALL SELECT s.client_id, 1, 0, sum(r.g) FROM shards s JOIN res r USING (id) GROUP BY s.client_id),
    upd AS (SELECT z.client_id, w.layer, w.coord, -2.0::DOUBLE * coalesce(u.g, 0) / z.n AS value, z.n
            FROM sizes z CROSS JOIN w LEFT JOIN sums u
                 ON u.client_id = z.client_id AND u.layer = w.layer AND u.coord = w.coord)"""


def _weights(spark):
    zero = learn.zero_weights(spark)
    token_weight = ((F.col("coord") * 7919) % 101 - 50) / 5.0
    return zero.withColumn("value", F.when(F.col("layer") == 1, 0.25).otherwise(token_weight))


def _features(spark, sf):
    return learn.featurise(S.shards(spark, sf))


@query("m01_client_updates", f"""
    WITH {_FEATURES}, {_GRADIENT} SELECT client_id, layer, coord, round(value, 6) AS value FROM upd""")
def client_updates(spark, sf):
    steps = learn.client_updates(_features(spark, sf), _weights(spark), learning_rate=2.0)
    return steps.withColumn("value", round_to(F.col("value"), 6))


@query("m02_predictions", f"""
    WITH {_FEATURES} SELECT id, round(margin, 6) AS margin, CASE WHEN margin > 0 THEN 1 ELSE 0 END AS pred FROM m""")
def predictions(spark, sf):
    scored = learn.predict(_features(spark, sf), _weights(spark))
    return scored.withColumn("margin", round_to(F.col("margin"), 6))


@query("m03_server_update", f"""
    WITH {_FEATURES}, {_GRADIENT}
    SELECT layer, coord, round(sum(value * n) / (SELECT count(*) FROM shards), 6) AS value FROM upd GROUP BY layer, coord""")
def server_update(spark, sf):
    steps = learn.server_update(_features(spark, sf).drop("client_id"), _weights(spark), learning_rate=2.0)
    return steps.withColumn("value", round_to(F.col("value"), 6))


@query("m04_one_round", f"""
    WITH {_FEATURES}, {_GRADIENT},
    g1 AS (SELECT layer, coord, sum(n * (w.w + value)) / (sum(n) + 1e-9) AS w FROM upd JOIN w USING (layer, coord)
           GROUP BY layer, coord),
    scored AS (SELECT s.id, s.label AS y_true,
                      CASE WHEN (SELECT w FROM g1 WHERE layer = 1) + coalesce(sum(g.w / o.n), 0) > 0 THEN 1 ELSE 0 END AS y_pred
               FROM shards s LEFT JOIN occ o USING (id) LEFT JOIN g1 g ON g.layer = 0 AND g.coord = o.coord
               GROUP BY s.id, s.label),
    tagged AS (SELECT 'one' AS run, 1 AS round, * FROM scored),
    c AS ({confusion_sql("tagged", "run, round")})
    {_score_sql("c")}""")
def one_round(spark, sf):
    """Local step, aggregation, global step, scoring and scores over features computed once."""
    features, current = cut_lineage(_features(spark, sf)), _weights(spark).withColumn("round", F.lit(1))
    steps = learn.client_updates(features, current, learning_rate=2.0).withColumn("round", F.lit(1))
    counts = features.groupBy("client_id").agg(F.count("*").alias("n")).withColumn("round", F.lit(1))
    local = strategy.U.add_global(steps, current)
    new, _ = strategy.global_step("fedavg", local, current, counts=counts)
    preds = features.join(learn.predict(features, new), "id").select(
        F.lit("one").alias("run"), F.lit(1).alias("round"), F.col("label").alias("y_true"), F.col("pred").alias("y_pred")
    )
    return stream_metrics.scores(stream_metrics.confusion(preds))


# --- streams ------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream.  Streams start from a folder: a table that is one file is picked out of the folder it lies in."""
    path, file = f"{sf}/{name}.parquet", f"{name}.parquet"
    found = S.table(spark, sf, name)
    reader = spark.readStream.schema(found.schema)
    if all(f.rpartition("/")[2] == file for f in found.inputFiles()):
        return reader.option("pathGlobFilter", file).parquet(sf)
    return reader.parquet(path)


def _written(spark, stream, name, mode="update"):
    return sink.run(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-state"), mode)


def _update_stream(spark, sf):
    return _stream(spark, sf, "embeddings").select(
        F.timestamp_seconds("vec_id").alias("ts"), (F.col("vec_id") % 3).cast("int").alias("round"),
        F.col("label").alias("client_id"), F.posexplode("embedding").alias("coord", "v"),
    ).select("ts", "round", "client_id", F.expr("coord div 16").cast("int").alias("layer"), "coord",
             F.col("v").cast("double").alias("value"))


@query("w01_windowed_norms", """
    SELECT CAST(vec_id // 300 * 300 AS BIGINT) AS window_start, round, client_id, round(sqrt(sum(v * v)), 6) AS norm
    FROM vec GROUP BY ALL""")
def windowed_norms(spark, sf):
    norms = stream_updates.windowed_norms(_update_stream(spark, sf))
    table = sink.latest(_written(spark, norms, "norms"), ["window_start", "round", "client_id"])
    return table.select(F.unix_seconds("window_start").alias("window_start"), "round", "client_id",
                        round_to(F.col("norm"), 6).alias("norm"))


@query("w02_running_history", """
    SELECT client_id, CAST(coord // 16 AS INT) AS layer, coord, round(sum(v), 6) AS value
    FROM vec GROUP BY client_id, layer, coord""")
def running_history(spark, sf):
    """Batches merged into a keyed table; the stream keeps no state."""
    path = scratch_path(spark, "history")
    merged = merge.MergeTable(spark, path, ["client_id", "layer", "coord"], ["value"])
    table = merged.run(_update_stream(spark, sf), scratch_path(spark, "history-state"))
    return table.withColumn("value", round_to(F.col("value"), 6))


@query("w02_history_in_state", """
    SELECT client_id, CAST(coord // 16 AS INT) AS layer, coord, round(sum(v), 6) AS value
    FROM vec GROUP BY client_id, layer, coord""")
def history_in_state(spark, sf):
    """The same sums in the state store, each batch's changed rows merged by replacement."""
    sums = stream_updates.running_history(_update_stream(spark, sf))
    table = sink.latest(_written(spark, sums, "history"), ["client_id", "layer", "coord"])
    return table.withColumn("value", round_to(F.col("value"), 6))


@query("w03_log_stream", f"WITH {LOG_CLEAN} SELECT doc_id, pos, md5(line) AS digest FROM cleaned")
def log_stream(spark, sf):
    lines = S.dress_lines(_stream(spark, sf, "documents"))
    table = _written(spark, stream_metrics.filtered_log(lines), "log", "append")
    return table.select("doc_id", "pos", F.md5("line").alias("digest"))


@query("w04_round_metrics", "SELECT * FROM scores_big")
def round_metrics(spark, sf):
    preds = S.line_predictions(_stream(spark, sf, "lineitem"))
    counts = sink.latest(_written(spark, stream_metrics.confusion(preds), "confusion"), ["run", "round"])
    return stream_metrics.scores(counts)
