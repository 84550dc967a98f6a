"""Labels for documents, and sums of per-task count arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.llm import frames

#: A table of (key, label) with at most so many rows is broadcast (16 MB), a larger one shuffled.
SENT_LABELS = 1_000_000


def with_label(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, outer: bool = False) -> DataFrame:
    """``doc_id, text, label`` of the labelled rows (of all with ``outer``).

    A key that has several labels takes the largest; null labels count as none.
    """
    slim = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    slim = slim.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        slim = slim.filter(usable)
    slim = slim.groupBy("doc_id").agg(F.max("label").alias("label"))
    slim = F.broadcast(slim) if labels.count() <= SENT_LABELS else slim
    return frames.keyed_texts(docs).join(slim, "doc_id", "left" if outer else "inner").select("doc_id", "text", "label")


def summed(rows: DataFrame, make: Callable[[], Callable], buckets: int, kinds: int) -> np.ndarray:
    """A (``kinds``, ``buckets``) array of counts over all rows ``doc_id, text, label``.

    ``make()``'s function gets a text and its label and yields (kind, bucket array) pairs.  Every
    task sums its rows, so that a shuffled row is a bucket of a task and the driver gets at most
    ``buckets`` rows.
    """
    names = [f"n{k}" for k in range(kinds)]

    def run(batches):
        function, counts = make(), np.zeros((kinds, buckets), np.int64)
        for part in frames.slices(batches):
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                for kind, found in function(text, label):
                    np.add.at(counts[kind], found, 1)
        some = np.flatnonzero(counts.any(axis=0))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], ["bucket", *names])

    partial = rows.mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    total = partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts = np.zeros((kinds, buckets), np.int64)
    for k, name in enumerate(names):
        counts[k, total.column("bucket").to_numpy()] = total.column(name).to_numpy()
    return counts
