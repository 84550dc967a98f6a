"""Algebra on updates, kept as the long table ``(round, client_id, layer, coord, value)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.functions.numeric import int_div
from quorumlab.operators.joins import join_checked, row_bound

CELL = ["round", "layer", "coord"]
CLIENT = ["round", "client_id"]


def to_blocks(updates: DataFrame, block_size: int = 4096) -> DataFrame:
    """Pack cells into ordered blocks of at most ``block_size`` coordinates.

    The compact storage form: one row per client, layer and block, never one per layer.
    """
    block = int_div(F.col("coord"), block_size).alias("block")
    return updates.groupBy(*CLIENT, "layer", block).agg(
        F.sort_array(F.collect_list(F.struct("coord", "value"))).alias("cells")
    )


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Unpack blocks into cells again, losslessly."""
    return blocks.select(*CLIENT, "layer", F.inline("cells"))


def subtract_global(weights: DataFrame, global_weights: DataFrame) -> DataFrame:
    """delta = client weights - global weights, cell by cell."""
    return _with_global(weights, global_weights, F.col("value") - F.col("_g"))


def add_global(updates: DataFrame, global_weights: DataFrame) -> DataFrame:
    """weights = global weights + update, cell by cell."""
    return _with_global(updates, global_weights, F.col("value") + F.col("_g"))


def _with_global(left: DataFrame, global_weights: DataFrame, value: Column) -> DataFrame:
    keys = [c for c in CELL if c in global_weights.columns]
    right = global_weights.select(*keys, F.col("value").alias("_g"))
    others = [F.col(c) for c in left.columns if c != "value"]
    return left.join(right, keys).select(*others, value.alias("value"))


def dot(updates: DataFrame, direction: DataFrame) -> DataFrame:
    """Dot product of each update with the round's direction, accumulated in double."""
    right = direction.select(*CELL, F.col("value").alias("_d"))
    return (
        updates.join(right, CELL)
        .groupBy(*CLIENT)
        .agg(F.sum(F.col("value") * F.col("_d")).alias("dot"))
    )


def norms(updates: DataFrame) -> DataFrame:
    """L2 norm of each update: one aggregate, combined on the map side."""
    return updates.groupBy(*CLIENT).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )


def clients(updates: DataFrame) -> DataFrame:
    return updates.select(*CLIENT).distinct()


def sign(value: Column) -> Column:
    return F.signum(value).cast("int")


def client_index(results: DataFrame, num_clients: int) -> DataFrame:
    """The client index of each result: reported id, else proxy id in range, else position.

    Proxy ids are opaque hashes in general and are never used as keys outside the range.
    """
    proxy = F.expr("try_cast(proxy_id AS BIGINT)")
    in_range = F.when((proxy >= 0) & (proxy < num_clients), proxy)
    return results.withColumn(
        "client_id",
        F.coalesce(F.col("reported_id").cast("long"), in_range, F.col("position").cast("long")).cast("int"),
    )


def client_bound(updates: DataFrame, client_rows: int | None = None) -> int:
    """Number of (round, client) pairs: as given, else counted on two columns."""
    return row_bound(clients(updates)) if client_rows is None else client_rows


def join_clients(
    updates: DataFrame, table: DataFrame, how: str = "inner", client_rows: int | None = None
) -> DataFrame:
    """Updates with the columns of a table of one row per round and client.

    ``client_rows`` is the number of such rows where the caller knows it.  When the
    updates come from a join themselves, pass it: counting would run that join.
    """
    return join_checked(updates, table, CLIENT, client_bound(updates, client_rows), how)


def weighted_mean(updates: DataFrame, weights: DataFrame, client_rows: int | None = None) -> DataFrame:
    """sum(w * v) / sum(w) per cell, for ``weights(round, client_id, w)``.

    Rounds whose weights sum to nothing give zeros.
    """
    joined = join_clients(updates, weights.select(*CLIENT, "w"), client_rows=client_rows)
    return (
        joined.groupBy(*CELL)
        .agg(F.sum(F.col("w") * F.col("value")).alias("_s"), F.sum("w").alias("_t"))
        .select(
            *CELL,
            F.when(F.abs("_t") > 1e-9, F.col("_s") / F.col("_t")).otherwise(F.lit(0.0)).alias("value"),
        )
    )


def mean_between(
    updates: DataFrame, low: Callable[[Column], Column], high: Callable[[Column], Column]
) -> DataFrame:
    """Mean of the values ranked ``low(n) .. high(n)`` (1-based) of the n in each cell.

    Missing values do not count.  The cells are shuffled once and ranked by a window,
    whose sort spills, whatever the number of clients.
    """
    present = updates.filter(F.col("value").isNotNull())
    cell = Window.partitionBy(*CELL)
    ranked = present.select(
        *CELL,
        "value",
        F.row_number().over(cell.orderBy("value", "client_id")).alias("_pos"),
        F.count("*").over(cell).alias("_n"),
    )
    inside = (F.col("_pos") >= low(F.col("_n"))) & (F.col("_pos") <= high(F.col("_n")))
    return ranked.filter(inside).groupBy(*CELL).agg(F.avg("value").alias("value"))
