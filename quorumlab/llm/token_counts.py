"""Token counts by the whole-token shortcut.

Offline, :meth:`WordBpe.single_tokens` proves which vocabulary strings encode alone as one
token.  Counting looks words up in that table first; only other words are split into
pre-tokens, looked up again, and merged.  Map-only: no shuffle, each task counts its own rows.

Null and empty texts have no bytes and no tokens; repeated rows are counted each; a null key
stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quorumlab.llm import frames, memo, wordbpe

LIMIT = 2048


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""

    def run(batches):
        memo.working_for("word ids")
        coder = wordbpe.load(vocabulary)
        for part in frames.slices(batches):
            texts = part.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array([coder.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return frames.keyed_texts(docs, key, text).mapInArrow(run, schema)
