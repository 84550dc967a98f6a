"""Exact ranks that no single task has to compute.

A seeded shuffle is the order of ``md5(seed:id)``.  Those keys are uniform, so their
leading hex digits cut any group - also one that holds most of the table - into
equal buckets that keep the order.  Rank = rows in earlier buckets + position within
the bucket: one small aggregate for the first, one window per bucket for the second.
The table of earlier rows is broadcast where its size is bounded, so ranked rows are
exchanged once, by group and bucket.  Where only a share of the order is asked for, the
key at its end (:func:`kth_keys`) decides row by row, and rows are not exchanged at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import int_div
from quorumlab.functions.text import order_key
from quorumlab.operators.joins import BROADCAST_ROWS
from quorumlab.session import cut_lineage


def with_rank(
    df: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "id",
    seed: int = C.SEED,
    rank: str = "rank0",
    total: str | None = None,
    digits: int = 3,
    groups: int | None = None,
) -> DataFrame:
    """Add the 0-based shuffle rank of each row within its ``by`` group.

    ``total`` names an optional column with the group size.  ``digits`` sets the
    number of buckets per group (16**digits); :func:`digits_for` suggests it for large
    tables.  ``groups`` bounds the number of groups; where it is not known, the table of
    buckets is made and counted first.
    """
    keyed = _keyed(df, id_col, seed, digits)
    placed = keyed.withColumn("_pos", F.row_number().over(_in_bucket(by, id_col)))
    joined = placed.join(_sent(_offsets(keyed, by), groups if by else 1, digits), _same_bucket(by))
    columns = [F.col(c) for c in df.columns]
    columns.append((F.col("_before") + F.col("_pos") - 1).cast("long").alias(rank))
    if total:
        columns.append(F.col("_total").cast("long").alias(total))
    return joined.select(*columns)


def digits_for(rows: int, per_bucket: int = 1_000_000) -> int:
    """Leading digits that leave about ``per_bucket`` rows to a window, from 3 up."""
    digits = 3
    while rows > per_bucket * 16**digits:
        digits += 1
    return digits


def order_struct(id_col: str = "id", seed: int = C.SEED) -> Column:
    """The place of a row in the shuffle order, as a comparable value."""
    return F.struct(order_key(F.col(id_col), seed).alias("key"), F.col(id_col).alias("id"))


def kth_keys(
    df: DataFrame,
    k: Callable[[Column], Column],
    by: Sequence[str] = (),
    id_col: str = "id",
    seed: int = C.SEED,
    digits: int = 3,
    groups: int | None = None,
) -> DataFrame:
    """``by`` and ``last``, the :func:`order_struct` of each group's k-th row in shuffle order.

    ``k`` is given the group's size; a group with fewer rows has its last one, and one whose k is
    below 1 has none.  Only the rows of the bucket that holds the k-th are exchanged.
    """
    keyed = _keyed(df.select(*by, id_col), id_col, seed, digits)
    wanted = _offsets(keyed, by).withColumn("_k", F.least(k(F.col("_total")).cast("long"), F.col("_total")))
    holds = wanted.filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_size")))
    near = keyed.join(_sent(holds, groups if by else 1, 0), _same_bucket(by))
    placed = near.withColumn("_pos", F.row_number().over(_in_bucket(by, id_col)))
    last = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("id")).alias("last")
    return placed.filter(F.col("_before") + F.col("_pos") == F.col("_k")).select(*by, last)


def _sent(small: DataFrame, groups: int | None, digits: int) -> DataFrame:
    """Broadcast up to ``BROADCAST_ROWS``; counted where the number of groups is not known."""
    if groups is None:
        small = cut_lineage(small)
        return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
    return F.broadcast(small) if groups * 16**digits <= BROADCAST_ROWS else small


def first_ranked(
    df: DataFrame,
    limit: Column,
    by: Sequence[str],
    groups: int,
    id_col: str = "id",
    seed: int = C.SEED,
    digits: int = 3,
) -> DataFrame:
    """The first ``limit`` rows of each group in shuffle order, without ranking the rest.

    Buckets that start past the limit are dropped where the rows are read, so what is
    shuffled and sorted follows the limit, not the table.  ``groups`` bounds the number
    of groups and with it the bucket table, which is broadcast while it is small.
    """
    keyed = _keyed(df, id_col, seed, digits)
    wanted = _offsets(keyed, by).filter(F.col("_before") < limit)
    if groups * 16**digits <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    near = keyed.join(wanted, _same_bucket(by))
    placed = near.withColumn("_pos", F.row_number().over(_in_bucket(by, id_col)))
    return placed.filter(F.col("_before") + F.col("_pos") <= limit).select(*df.columns)


def _keyed(df: DataFrame, id_col: str, seed: int, digits: int) -> DataFrame:
    keyed = df.withColumn("_key", order_key(F.col(id_col), seed))
    return keyed.withColumn("_bucket", F.substring("_key", 1, digits))


def _offsets(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket and in its whole group: at most 16**digits rows per group."""
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_bucket").alias("_by_bucket"),
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(group).alias("_total"),
    )


def _in_bucket(by: Sequence[str], id_col: str):
    return Window.partitionBy(*by, "_bucket").orderBy("_key", id_col)


def _same_bucket(by: Sequence[str]) -> Column:
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return reduce(lambda a, b: a & b, same, F.col("_bucket") == F.col("_by_bucket"))


def assign_segments(
    ranked: DataFrame,
    segments: Sequence[tuple[int, int, int, int]],
    label_col: str = "label",
    rank: str = "rank0",
    out: str = "client_id",
    cells: int = 4096,
) -> DataFrame:
    """Give each row the client whose ``(label, lo, hi, client)`` segment holds its rank.

    The range test becomes an equi-join on a coarse cell of the rank, so a row meets
    one or two candidate segments however many clients there are.  The segment table
    is built from the allocation plan: its size is known and does not follow the data.
    """
    spark = ranked.sparkSession
    top = max((hi for _, _, hi, _ in segments), default=1)
    width = max(1, -(-top // cells))
    rows = [
        (int(label), cell, int(lo), int(hi), int(client))
        for label, lo, hi, client in segments
        if hi > lo
        for cell in range(lo // width, (hi - 1) // width + 1)
    ]
    names = ["_label", "_cell", "_lo", "_hi", "_client"]
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    # Through Arrow the table is a local relation of known size, so the planner can broadcast it.
    table = spark.createDataFrame(
        pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    )
    cell = int_div(F.col(rank), width)
    joined = ranked.join(
        table,
        (F.col(label_col) == F.col("_label"))
        & (cell == F.col("_cell"))
        & (F.col(rank) >= F.col("_lo"))
        & (F.col(rank) < F.col("_hi")),
    )
    return joined.select(*[F.col(c) for c in ranked.columns], F.col("_client").alias(out))
