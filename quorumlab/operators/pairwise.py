"""Pair statistics between the clients of a round.

The pairs are of clients, never of cells.  Cells are shuffled once and packed by coordinate and
block of clients; as they stream through a task, each batch is a pair of (coordinates x clients)
matrices that is reduced to one running matrix.  Up to ``BLOCK`` clients that matrix is the whole
result of a round.  With more, a packed block meets every other block: one (block, block) tile per
key, sorted, so a task holds one tile at a time and its memory does not depend on the clients.
Only those matrices leave the task.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.operators.algebra import CLIENT, client_bound

# The reducers travel inside the plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_PAIR_SCHEMA = "round int, left_id int, right_id int, part double"
#: Clients of a block, about; a tile is a matrix of two blocks.
BLOCK = 256
_CHUNK = 1_000_000  # matrix cells worked on at a time

Side = tuple[np.ndarray, np.ndarray]  # values and which of them are there, (coordinates x clients)


def _squared_distances(left: Side, right: Side, same: bool) -> np.ndarray:
    """Over the coordinates both clients have; a value that is not finite is infinitely far."""
    (x, there), (y, others) = left, right
    out = np.zeros((x.shape[1], y.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(x.shape[1]):
            first = i + 1 if same else 0
            square = (y[:, first:] - x[:, i : i + 1]) ** 2
            square[np.isnan(square)] = np.inf
            out[i, first:] = np.where(others[:, first:] & there[:, i : i + 1], square, 0.0).sum(axis=0)
    return out


def _finite(side: Side) -> tuple[np.ndarray, np.ndarray]:
    x = np.where(side[1], side[0], 0.0)
    bad = ~np.isfinite(x).all(axis=0)
    x[:, bad] = 0.0
    return x, bad


def _products(left: Side, right: Side, same: bool) -> np.ndarray:
    """Values that are not finite make all products of their client NaN."""
    (x, bad), (y, worse) = _finite(left), _finite(right)
    out = x.T @ y
    out[bad, :], out[:, worse] = np.nan, np.nan
    return np.triu(out) if same else out


class _Tile:
    """Running matrix of one round and pair of blocks; clients may show up late."""

    def __init__(self, same: bool) -> None:
        self.same = same
        self.left = self.right = np.empty(0, dtype=np.int32)
        self.total = np.zeros((0, 0))

    def add(self, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> None:
        rows, columns = np.union1d(self.left, left), np.union1d(self.right, right)
        if rows.size != self.left.size or columns.size != self.right.size:
            grown = np.zeros((rows.size, columns.size))
            grown[np.ix_(np.searchsorted(rows, self.left), np.searchsorted(columns, self.right))] = self.total
            self.left, self.right, self.total = rows, columns, grown
        self.total[np.ix_(np.searchsorted(self.left, left), np.searchsorted(self.right, right))] += part

    def rows(self, number: int) -> pa.RecordBatch:
        if self.same:
            i, j = np.triu_indices(self.left.size)
        else:
            i, j = (x.ravel() for x in np.indices(self.total.shape))
        a, b = self.left[i], self.right[j]
        columns = [
            pa.array(np.full(i.size, number), pa.int32()),
            pa.array(np.minimum(a, b), pa.int32()),
            pa.array(np.maximum(a, b), pa.int32()),
            pa.array(self.total[i, j], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["round", "left_id", "right_id", "part"])


def _matrix(clients: pa.ListArray, values: pa.ListArray) -> tuple[np.ndarray, Side]:
    """Client ids, and the (coordinates x clients) matrix of packed cells; an empty place is not there."""
    client, value = clients.flatten().to_numpy(), values.flatten().to_numpy()
    sizes = clients.value_lengths().fill_null(0).to_numpy()
    ids = np.unique(client)
    if ids.size and (sizes == ids.size).all() and (client.reshape(-1, ids.size) == ids).all():
        matrix = value.reshape(-1, ids.size)
        return ids, (matrix, np.ones(matrix.shape, bool))
    matrix, present = np.zeros((sizes.size, ids.size)), np.zeros((sizes.size, ids.size), bool)
    place = np.repeat(np.arange(sizes.size), sizes), np.searchsorted(ids, client)
    matrix[place], present[place] = value, True
    return ids, (matrix, present)


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[tuple[int, ...], slice]]:
    """Stretches of equal keys."""
    if not len(keys[0]):
        return
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    edges = [0, *change.tolist(), len(keys[0])]
    for start, end in zip(edges, edges[1:], strict=False):
        yield tuple(int(k[start]) for k in keys), slice(start, end)


def _pair_reducer(reduce: Callable[[Side, Side, bool], np.ndarray], tiled: bool):
    """Rows of ``round, i, j`` and packed clients to partial sums of pairs, one tile after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, ...], _Tile] = {}
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("round", "i", "j")]
            for key, rows in _runs(keys):
                if tiled and key not in tiles:  # sorted: the tiles before are done
                    yield from (tile.rows(done[0]) for done, tile in tiles.items())
                    tiles.clear()
                tile = tiles.setdefault(key, _Tile(key[1] == key[2]))
                part = batch.slice(rows.start, rows.stop - rows.start)
                if tiled:  # who is there, also where two clients share no coordinate
                    listed = part.filter(part.column("roster"))
                    ids = [np.unique(listed.column(c).flatten().to_numpy()) for c in ("left_ids", "right_ids")]
                    tile.add(*ids, np.zeros((ids[0].size, ids[1].size)))
                    part = part.filter(pc.invert(part.column("roster")))
                left, ours = _matrix(part.column("left_ids"), part.column("left_values"))
                right, theirs = (left, ours) if tile.same else _matrix(part.column("right_ids"), part.column("right_values"))
                step = max(1, _CHUNK // max(1, left.size, right.size))
                for start in range(0, part.num_rows, step):
                    end = start + step
                    own, other = ((x[start:end], there[start:end]) for x, there in (ours, theirs))
                    tile.add(left, right, reduce(own, other, tile.same))
        yield from (tile.rows(key[0]) for key, tile in tiles.items())

    return run


def _packed(updates: DataFrame, block: Column) -> DataFrame:
    cell = F.struct(F.col("client_id").cast("int").alias("client_id"), F.col("value").cast("double").alias("value"))
    packed = updates.groupBy("round", "layer", "coord", block.alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("_c"))
    return packed.withColumn("round", F.col("round").cast("int"))


def _tiles(packed: DataFrame, blocks: int) -> DataFrame:
    """Each packed block in all its tiles, both sides of a coordinate in one row, tiles in stretches.

    Tiles are cut by coordinate into no more parts than there are tasks to work on them, since
    each part of a tile gives a matrix of its own.  Rows without a layer list a block's clients.
    """
    spark = packed.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, tasks // (blocks * (blocks + 1) // 2))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = packed.select("round", "layer", "coord", "block", "_c", other).select(
        "round", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("layer").isNotNull(), F.array(F.pmod(F.xxhash64("layer", "coord"), F.lit(parts))))
        .otherwise(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("parts"), "layer", "coord", "block", "_c",
    ).withColumn("part", F.explode("parts"))
    placed = sent.repartition("round", "i", "j", "part")
    side = [F.max(F.when(F.col("block") == F.col(key), F.col("_c"))).alias(name) for key, name in (("i", "left"), ("j", "right"))]
    both = placed.groupBy("round", "i", "j", "part", "layer", "coord").agg(*side)
    return both.select(
        "round", "i", "j", "part", F.isnull("layer").alias("roster"), F.col("left.client_id").alias("left_ids"), F.col("left.value").alias("left_values"),
        F.col("right.client_id").alias("right_ids"), F.col("right.value").alias("right_values"),
    ).sortWithinPartitions("round", "i", "j", "part").drop("part")


def _pair_sums(updates: DataFrame, reduce: Callable[[Side, Side, bool], np.ndarray], name: str, clients: int | None) -> DataFrame:
    blocks = max(1, -(-client_bound(updates, clients) // BLOCK))
    if blocks == 1:
        packed = _packed(updates, F.lit(0))
        rows = packed.select(
            "round", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("_c.client_id").alias("left_ids"), F.col("_c.value").alias("left_values")
        )
    else:
        block = F.pmod(F.xxhash64("client_id"), F.lit(blocks)).cast("int")
        nowhere = [F.lit(None).cast(updates.schema[c].dataType).alias(c) for c in ("layer", "coord")]
        roster = updates.select(*CLIENT).distinct().select(*CLIENT, *nowhere, F.lit(0.0).alias("value"))
        rows = _tiles(_packed(updates, block).unionByName(_packed(roster, block)), blocks)
    parts = rows.mapInArrow(_pair_reducer(reduce, blocks > 1), _PAIR_SCHEMA)
    return parts.groupBy("round", "left_id", "right_id").agg(F.sum("part").alias(name))


def distances(updates: DataFrame, clients: int | None = None) -> DataFrame:
    """Squared distances ``(round, left_id <= right_id, dist)``.

    Differences are squared directly; expanding the square would cancel for
    near-identical clients.  ``clients`` is a bound on their number, counted where not given.
    """
    return _pair_sums(updates, _squared_distances, "dist", clients)


def dots(updates: DataFrame, clients: int | None = None) -> DataFrame:
    """Dot products ``(round, left_id <= right_id, dot)``; the diagonal has the squared norms."""
    return _pair_sums(updates, _products, "dot", clients)


def both_directions(pairs: DataFrame, value: str) -> DataFrame:
    """Each unordered pair as (client, other) and (other, client); the diagonal once."""
    one = F.struct(F.col("left_id").alias("client_id"), F.col("right_id").alias("other_id"))
    two = F.struct(F.col("right_id").alias("client_id"), F.col("left_id").alias("other_id"))
    ways = F.when(F.col("left_id") == F.col("right_id"), F.array(one)).otherwise(F.array(one, two))
    return pairs.select("round", value, F.inline(ways))


def last_layers(updates: DataFrame, count: int, num_layers: int | None = None) -> DataFrame:
    """Cells of the last ``count`` layers only (0 = all), filtered before any shuffle.

    With ``num_layers`` known the filter is a literal and reaches the scan; otherwise
    the highest layer is looked up first.
    """
    if not count:
        return updates
    top = F.lit(num_layers - 1) if num_layers else updates.agg(F.max("layer")).scalar()
    return updates.filter(F.col("layer") > top - count)


def history(features: DataFrame) -> DataFrame:
    """Sum of each cell over this and all earlier rounds.

    Partitioned by coordinate, so that the pair statistics that follow need no further
    shuffle of the cells, and every coordinate may be a task of its own.
    """
    so_far = (
        Window.partitionBy("layer", "coord", "client_id")
        .orderBy("round")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = features.repartition("layer", "coord")
    return placed.select(*CLIENT, "layer", "coord", F.sum("value").over(so_far).alias("value"))


def carried(features: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """The running sums after one more round, ``(client_id, layer, coord, value, present)``.

    ``features`` are the cells of that round alone, ``sums`` what earlier rounds came to.  Cells the
    round did not bring keep their sum and are not ``present``.  What is read and shuffled are the
    sums and one round, however many rounds there were.
    """
    now = features.select("client_id", "layer", "coord", "value", F.lit(True).alias("present"))
    if sums is not None:
        now = now.unionByName(sums.select("client_id", "layer", "coord", "value", F.lit(False).alias("present")))
    placed = now.repartition("layer", "coord")
    return placed.groupBy("layer", "coord", "client_id").agg(F.sum("value").alias("value"), F.max("present").alias("present"))


def cosines(vectors: DataFrame, clients: int | None = None) -> DataFrame:
    """Cosine of every client pair, both directions and the diagonal.

    The diagonal of the products holds the squared lengths of both partners, so windows
    over the pair table give them without a second pass over the vectors.
    """
    products = both_directions(dots(vectors, clients), "dot")
    own = F.when(F.col("client_id") == F.col("other_id"), F.col("dot"))

    def length(side: str):
        return F.sqrt(F.max(own).over(Window.partitionBy("round", side))) + C.EPS

    cosine = F.col("dot") / (length("client_id") * length("other_id"))
    return products.select(*CLIENT, "other_id", cosine.alias("cosine"))
