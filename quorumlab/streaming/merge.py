"""A keyed table that micro-batches are merged into, once each.

A batch is reduced to one row per key and written as a *delta*.  Every ``compact_every`` deltas are
folded into the *base*, so a reader meets the base and a bounded number of deltas, however many
batches there were.  The stream itself keeps no state: sums live in the table, not on a heap.

What counts is said by a manifest of one row: the last batch, the base, the deltas since.  It is
written after the data, in turn to one of two slots, and the slot with the later batch is read: a
crash leaves the manifest before in place and the batch is done again over its own files.  A batch
that the manifest has is skipped, so a replay changes nothing.  Deltas and bases live in rings of
slots, reused when no manifest names them any more; a table does not grow with the batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "batch bigint, merges bigint, compactions bigint, deltas array<bigint>"
BUCKETS = 16


class MergeTable(NamedTuple):
    """Rows by ``keys``; ``values`` are summed, or with ``replace`` taken from the latest batch."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    values: Sequence[str]
    replace: bool = False
    compact_every: int = 8
    buckets: int = BUCKETS

    def manifest(self) -> dict:
        """The last batch, how many merges and compactions there were, and the merges since the base."""
        rows = []
        for slot in (0, 1):
            try:
                rows += self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/slot={slot}").collect()  # one row
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        found = max(rows, key=lambda row: row["batch"], default=None)
        return found.asDict() if found else {"batch": -1, "merges": 0, "compactions": 0, "deltas": []}

    def _combined(self, rows: DataFrame) -> DataFrame:
        """One row per key; ``_batch`` orders the rows of a key."""
        if self.replace:
            newest = F.max_by(F.struct(*self.values), "_batch").alias("_v")
            return rows.groupBy(*self.keys).agg(newest, F.max("_batch").alias("_batch")).select(*self.keys, "_v.*", "_batch")
        sums = [F.sum(v).alias(v) for v in self.values]
        return rows.groupBy(*self.keys).agg(*sums, F.max("_batch").alias("_batch"))

    def _write(self, rows: DataFrame, place: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        placed = rows.withColumn("bucket", bucket).repartition(self.buckets, "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{place}")

    def _delta(self, merge: int) -> str:
        return f"delta/slot={merge % (2 * self.compact_every)}"

    def _base(self, compactions: int) -> str:
        return f"base/slot={compactions % 2}"

    def _places(self, manifest: dict) -> list[str]:
        base = [self._base(manifest["compactions"])] if manifest["compactions"] else []
        return [f"{self.path}/{place}" for place in (*base, *map(self._delta, manifest["deltas"]))]

    def _stored(self, manifest: dict, schema) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(place) for place in self._places(manifest)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self._combined(rows)

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Take in a batch; False if it is there already."""
        known = self.manifest()
        if batch <= known["batch"]:
            return False
        delta = self._combined(rows.select(*self.keys, *self.values, F.lit(batch).cast("long").alias("_batch")))
        self._write(delta, self._delta(known["merges"]))
        following = known | {"batch": batch, "merges": known["merges"] + 1, "deltas": [*known["deltas"], known["merges"]]}
        if len(following["deltas"]) >= self.compact_every:
            whole = self._stored(following, delta.schema)
            following |= {"compactions": known["compactions"] + 1, "deltas": []}
            self._write(whole, self._base(following["compactions"]))
        self._publish(following)
        return True

    def _publish(self, manifest: dict) -> None:
        row = self.spark.createDataFrame([tuple(manifest[c] for c in ("batch", "merges", "compactions", "deltas"))], _MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/slot={manifest['batch'] % 2}")

    def read(self) -> DataFrame | None:
        """The table as of the last merged batch; None before the first."""
        known = self.manifest()
        places = self._places(known)
        if not places:
            return None
        schema = self.spark.read.parquet(places[-1]).drop("bucket").schema
        return self._stored(known, schema).drop("_batch")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame | None:
        """Merge what a stream has available and return the table."""
        query = (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: self.merge(rows, batch) and None)
            .start()
        )
        query.awaitTermination()
        return self.read()
