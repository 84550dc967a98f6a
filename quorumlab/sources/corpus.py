"""Corpus and shard tables: CSV in, Parquet between stages, partitioned shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "quoteAll": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """CSV with quoted multi-line texts, by an explicit schema.

    Such files are not splittable: convert a large corpus to Parquet once.
    """
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table atomically and return it as read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shards(variants: DataFrame, path: str) -> DataFrame:
    """Client shards, clean and injected: one folder per client and variant.

    A client or variant filter reads its own folders only.
    """
    return write_table(variants, path, ["client_id", "variant"])
