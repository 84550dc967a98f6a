"""Linear text classifier as Spark jobs: client gradients, scoring, server reference.

The model is a logistic regression on hashed tokens: layer 0 holds ``dim`` token
weights, layer 1 the bias.  All clients train in the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.functions.numeric import lit
from quorumlab.functions.text import tokens
from quorumlab.operators.joins import join_checked, row_bound

DIM = 1024
#: Token weights that fit one array in every task (8 MB).
ROW_LOCAL = 1 << 20


def token_slot(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % dim).cast("int")


def zero_weights(spark, dim: int = DIM) -> DataFrame:
    token_layer = spark.range(dim).select(F.lit(0).alias("layer"), F.col("id").cast("int").alias("coord"))
    bias = spark.range(1).select(F.lit(1).alias("layer"), F.lit(0).alias("coord"))
    return token_layer.union(bias).withColumn("value", lit(0))


def featurise(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """Replace the text by the slots of its tokens; every slot weighs 1 / token count."""
    slots = F.transform(tokens(F.col("text")), lambda t: token_slot(t, dim))
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, slots.alias("slots"))


def scored(features: DataFrame, weights: DataFrame, dim: int = DIM) -> DataFrame:
    """The features with their linear score, ``margin``.

    Up to ``ROW_LOCAL`` dimensions the token weights are one array that every task gets,
    and a score is a sum within its row: no shuffle.  Beyond that every slot meets its
    weight in a join and the sums come back by id; the bias is added afterwards, so that
    no key is shared by all rows.
    """
    bias = weights.filter("layer = 1").agg(F.coalesce(F.max("value"), lit(0))).scalar()
    tokens_only = weights.filter("layer = 0").select("coord", F.col("value").alias("w"))
    n = F.size("slots")
    if dim <= ROW_LOCAL:
        cells = F.sort_array(F.collect_list(F.struct("coord", "w")))
        table = tokens_only.agg(F.map_from_entries(cells).alias("m")).select(
            F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda c: F.coalesce(F.element_at("m", c), lit(0)))
        )
        placed = features.withColumn("_w", table.scalar())
        total = F.aggregate("slots", lit(0), lambda acc, s: acc + F.get("_w", s) / n)
        return placed.withColumn("margin", F.coalesce(total, lit(0)) + bias).drop("_w")
    rows = features.select("id", F.explode("slots").alias("coord"), (1.0 / n).alias("x"))
    sums = join_checked(rows, tokens_only, ["coord"], dim).groupBy("id").agg(F.sum(F.col("w") * F.col("x")).alias("_s"))
    joined = features.join(sums, "id", "left")
    return joined.withColumn("margin", F.coalesce("_s", lit(0)) + bias).drop("_s")


def predict(features: DataFrame, weights: DataFrame, dim: int = DIM, keep: Sequence[str] = ()) -> DataFrame:
    """Class 1 where the score is positive."""
    pred = F.when(F.col("margin") > 0, 1).otherwise(0).alias("pred")
    return scored(features, weights, dim).select("id", *keep, "margin", pred)


def client_updates(
    features: DataFrame, weights: DataFrame, learning_rate: float = 1.0, dim: int = DIM
) -> DataFrame:
    """One gradient step of every client: ``(client_id, layer, coord, value)``, dense.

    ``features`` has ``(client_id, id, label, slots)``.
    """
    probability = 1.0 / (1.0 + F.exp(-F.col("margin")))
    residual = scored(features, weights, dim).select("client_id", "slots", (probability - F.col("label")).alias("g"))
    n = F.size("slots")
    parts = F.concat(
        F.transform("slots", lambda s: F.struct(F.lit(0).alias("layer"), s.alias("coord"), (F.col("g") / n).alias("v"))),
        F.array(F.struct(F.lit(1).alias("layer"), F.lit(0).alias("coord"), F.col("g").alias("v"))),
    )
    sizes = features.groupBy("client_id").agg(F.count("*").alias("n"))
    cells = sizes.select(
        "client_id",
        F.inline(F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda s: F.struct(F.lit(0).alias("layer"), s.alias("coord"), lit(0).alias("v"))),
            F.array(F.struct(F.lit(1).alias("layer"), F.lit(0).alias("coord"), lit(0).alias("v"))),
        )),
    )
    sums = (
        residual.select("client_id", F.inline(parts)).unionByName(cells)
        .groupBy("client_id", "layer", "coord").agg(F.sum("v").alias("g"))
    )
    step = F.lit(float(-learning_rate)) * F.col("g") / F.col("n")
    return join_checked(sums, sizes, ["client_id"], row_bound(sizes)).select("client_id", "layer", "coord", step.alias("value"))


def server_update(
    root_features: DataFrame, weights: DataFrame, learning_rate: float = 1.0, dim: int = DIM
) -> DataFrame:
    """The reference update: one step on the server's root set."""
    alone = root_features.withColumn("client_id", F.lit(0))
    return client_updates(alone, weights, learning_rate, dim).drop("client_id")
