"""Trigger sets as JSON documents, one set per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIGGER_SCHEMA = T.StructType([
    T.StructField("set_id", T.LongType()),
    T.StructField("manual_trigger", T.StringType()),
    T.StructField("semantic_theme", T.StringType()),
    T.StructField("semantic_triggers", T.ArrayType(T.StringType())),
])


def build_sets(phrases: DataFrame, manual: str, theme: str) -> DataFrame:
    """One document per ``set_id`` from rows ``(set_id, k, text)``; a set is a handful of phrases."""
    ordered = F.sort_array(F.collect_list(F.struct("k", "text")))
    return phrases.groupBy("set_id").agg(ordered.alias("_p")).select(
        "set_id",
        F.lit(manual).alias("manual_trigger"),
        F.lit(theme).alias("semantic_theme"),
        F.col("_p.text").alias("semantic_triggers"),
    )


def save_triggers(sets: DataFrame, path: str) -> None:
    sets.write.mode("overwrite").json(path)


def load_triggers(spark: SparkSession, path: str) -> DataFrame:
    """``(set_id, kind, k, trigger)``: the fixed phrase and the ordered pool of every set."""
    sets = spark.read.schema(TRIGGER_SCHEMA).json(path)
    manual = sets.select("set_id", F.lit("manual").alias("kind"), F.lit(0).alias("k"), F.col("manual_trigger").alias("trigger"))
    pool = sets.select("set_id", F.lit("semantic").alias("kind"), F.posexplode("semantic_triggers").alias("k", "trigger"))
    return manual.unionByName(pool)
