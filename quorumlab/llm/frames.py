"""Helpers shared by the operators: slices of Arrow batches, folders, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.session import cut_lineage

#: Rows of an Arrow batch that become Python strings at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (as long) and the text, under fixed names: other columns cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """A text's identity; null and empty texts are one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def kept_rows(docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``rows``, with the columns of ``docs``.

    ``rows`` has ``doc_id, node`` (the text's identity) and ``component`` for every row.  The
    smallest key is kept, null keys last; of rows that repeat both key and text, one.
    """
    groups = rows.groupBy("component", "doc_id", "node").agg(F.count("*").alias("n"))
    best = groups.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "node", "n")).alias("best"))
    best = cut_lineage(best.select(F.col("best.doc_id").alias("_kept"), F.col("best.node").alias("_node"), F.col("best.n").alias("_n")))
    single, repeated = best.filter("_n = 1"), best.filter("_n > 1")
    same = docs[key].cast("long").eqNullSafe(F.col("_kept")) & (text_key(docs[text]) == F.col("_node"))
    found, many = docs.join(single, same, "left_semi"), repeated.count()
    if not many:
        return found
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = docs.join(F.broadcast(repeated) if many <= 10_000 else repeated, same).select("_kept", "_node", row.alias("_row"))
    one = several.groupBy("_kept", "_node").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return found.union(one.select("_row.*"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list]], fields: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Row-local operator: key, then the columns that ``make()``'s function gives for texts.

    ``make`` runs once per task on the worker; its function gets a list of texts and returns
    one list or Arrow array per field.  Rows keep their keys, repeated or null ones too.
    """
    schema = "doc_id bigint, " + fields
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        function = make()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c) if isinstance(c, list) else c for c in function(part.column(1).to_pylist()))], names
            )

    return keyed_texts(docs, key, text).mapInArrow(run, schema)
