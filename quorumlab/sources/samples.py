"""Tables derived from the given parquet tables, for the registered queries and the bench.

Each helper has a SQL twin in :mod:`quorumlab.catalog.views`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import lit
from quorumlab.operators import metrics


LABEL_SAMPLES = [
    *C.POSITIVE_LABELS, *C.NEGATIVE_LABELS, " Phishing Email ", "NOT SPAM", "anti-fraud team",
    "unknown", "", None, "scammer", "safe-ish",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cells: three rounds, the label is the client."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 3).cast("int").alias("round"),
        F.col("label").alias("client_id"),
        F.posexplode("embedding").alias("coord", "v"),
    ).withColumn("v", F.col("v").cast("double"))


def _layer(coord) -> F.Column:
    return F.floor(coord / 16).cast("int").alias("layer")


def base_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector and vector count of each client and round."""
    return vectors(spark, sf_dir).groupBy("round", "client_id", "coord").agg(
        F.avg("v").alias("m"), F.count("*").alias("n")
    )


def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(
        (F.col("vec_id") % 3).cast("int").alias("round"), F.col("label").alias("client_id")
    ).agg(F.count("*").alias("n"))


def updates_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_updates(spark, sf_dir).select(
        "round", "client_id", _layer(F.col("coord")), "coord", F.col("m").alias("value")
    )


def updates_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients 7, 8 and 9 push one common direction, the others scatter around 0.1."""
    m = F.col("m")
    planted = F.when(F.col("coord") % 2 == 0, lit(-0.3) + 0.01 * m).otherwise(lit(0.3) + 0.01 * m)
    return base_updates(spark, sf_dir).select(
        "round", "client_id", _layer(F.col("coord")), "coord",
        F.when(F.col("client_id") < 7, lit(0.1) + m).otherwise(planted).alias("value"),
    )


def updates_collude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients 7, 8 and 9 copy one vector opposed to the honest mean."""
    base = base_updates(spark, sf_dir)
    honest = base.filter("client_id < 7").groupBy("round", "coord").agg(F.avg("m").alias("hm"))
    return base.join(honest, ["round", "coord"]).select(
        "round", "client_id", _layer(F.col("coord")), "coord",
        F.when(F.col("client_id") < 7, F.col("m")).otherwise(lit(-3) * F.col("hm") + 0.01 * F.col("m")).alias("value"),
    )


def root_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server's reference update: 0.1 plus the mean of all vectors of the round."""
    return vectors(spark, sf_dir).groupBy("round", "coord").agg(
        (lit(0.1) + F.avg("v")).alias("value")
    ).select("round", _layer(F.col("coord")), "coord", "value")


def global_weights(updates: DataFrame) -> DataFrame:
    """Global weights of 1 at every coordinate of the round."""
    return updates.select("round", "layer", "coord").distinct().withColumn("value", lit(1))


def docs_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return docs.join(marks, "id")


def docs_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, some bodies replaced by placeholders, blanks or nothing."""
    text, kind = F.col("text"), F.col("doc_id") % 25
    noisy = (
        F.when(kind == 1, " EMPTY ")
        .when(kind == 2, F.lit(None).cast("string"))
        .when(kind == 3, " \n\t ")
        .when(kind == 4, F.concat(F.lit("\u00a0 \n"), text, F.lit("\u3000\u0085 ")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), noisy.alias("text"), (F.col("lang") == "en").cast("int").alias("label")
    )


def docs_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a label word each, covering every branch of the normalisation."""
    words = F.array(*[F.lit(w) for w in LABEL_SAMPLES])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text",
        F.get(words, (F.col("doc_id") % len(LABEL_SAMPLES)).cast("int")).alias("kind"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents dealt to ten clients."""
    return docs_labelled(spark, sf_dir).withColumn("client_id", (F.col("id") % 10).cast("int"))


def orders_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"),
    )


def _names(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def run_grid(docs: DataFrame) -> DataFrame:
    """Each labelled document under every attack, rule (10 = clean reference) and round."""
    grid = docs.select(
        F.col("id").alias("doc_id"), F.col("label").alias("y_true"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("a"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("d"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("round"))
    mix = F.col("doc_id") * 7919 + F.col("round") * 104729 + F.col("d") * 1299709 + F.col("a") * 611953
    attack = _names(C.ATTACKS, F.col("a"))
    defense = _names([*C.RULES, "clean"], F.col("d"))
    return grid.select(
        F.concat_ws("_", attack, defense).alias("run"), attack.alias("attack"), defense.alias("defense"),
        "doc_id", "a", "d", "round", "y_true", (mix % 100).alias("h"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on the clean test set for every run and round."""
    docs = docs_labelled(spark, sf_dir).drop("text")
    return run_grid(docs).select(
        "run", "attack", "defense", "round", "doc_id", "y_true",
        F.when(F.col("h") < 5, 1 - F.col("y_true")).otherwise(F.col("y_true")).alias("y_pred"),
    )


def preds_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on positives with either trigger inserted, for every run and round."""
    docs = docs_labelled(spark, sf_dir).drop("text").filter("label = 1")
    grid = run_grid(docs).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("t"))
    rising = F.least(F.lit(95), F.greatest(F.lit(0), 10 + 8 * F.col("round") - 3 * F.col("d") - 2 * F.col("t")))
    threshold = F.when(F.col("d") == 10, 4).otherwise(rising)
    return grid.select(
        "run", "attack", "defense", "round", "doc_id", _names(C.ATTACKS, F.col("t")).alias("trigger"),
        F.when(F.col("h") < threshold, 0).otherwise(1).alias("pred"),
    )


def preds_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per line item; the line status is the run, the line number the round."""
    return line_predictions(table(spark, sf_dir, "lineitem"))


def line_predictions(lineitem: DataFrame) -> DataFrame:
    truth = (F.col("l_returnflag") == "R").cast("int")
    h = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100
    return lineitem.select(
        F.col("l_linestatus").alias("run"), F.col("l_linenumber").alias("round"),
        truth.alias("y_true"), F.when(h < 5, 1 - truth).otherwise(truth).alias("y_pred"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines dressed as log output: colours, worker prefixes, repeats, noise."""
    return dress_lines(table(spark, sf_dir, "documents"))


def dress_lines(documents: DataFrame) -> DataFrame:
    lines = documents.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "body")
    )
    body = F.col("body")
    kind = (F.col("doc_id") + F.col("pos")) % 8
    line = (
        F.when(kind == 0, F.concat(F.lit("\x1b[32m"), body, F.lit("\x1b[0m")))
        .when(kind == 1, F.concat(F.lit("(ClientAppActor pid=7) "), body))
        .when(kind == 2, F.concat(body, F.lit("  [repeated 3x across cluster]  ")))
        .when(kind == 3, F.concat(F.lit("(raylet) "), body))
        .when(kind == 4, F.concat(F.lit("DEPRECATED FEATURE: "), body))
        .when(kind == 5, F.concat(F.lit("DEPRECATED FEATURE asr "), body))
        .when(kind == 6, F.concat(F.lit("[Round 3] "), body))
        .otherwise(body)
    )
    return lines.select("doc_id", "pos", line.alias("line"))


def round_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each evaluation: one run per user, rounds in time order."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    start = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("round"), start.alias("start_us"),
        (start + F.round(F.col("value") * 1000000).cast("long")).alias("end_us"),
    )


def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured runs: one per event, timed by its value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run"), F.col("event_type").alias("batch"),
        (F.col("value") * 10).alias("seconds"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and round: scores and both success rates."""
    return metrics.evaluation_rows(
        preds(spark, sf_dir), preds_triggered(spark, sf_dir), ["run", "attack", "defense", "round"]
    )


def run_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in duration per run, derived from its predictions."""
    docs = docs_labelled(spark, sf_dir).drop("text")
    return run_grid(docs).groupBy("run").agg((F.sum("h").cast("double") / 10).alias("seconds"))
