"""Joins whose small side is counted before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A few numeric columns per row: a million rows stay within tens of megabytes.
BROADCAST_ROWS = 1_000_000


def row_bound(df: DataFrame) -> int:
    """Number of rows: a plain count, since a limit would gather the rows in one task."""
    return df.count()


def join_checked(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    rows: int,
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with ``small`` broadcast when it has at most ``limit`` rows.

    ``rows`` is a bound on its size: counted with :func:`row_bound` or known from how it
    was built.  Past the limit both sides are shuffled; keys are then many, and a hot
    one is split by adaptive skew handling.

    Without the broadcast a table of a few clients would send all cells to as many
    tasks as there are clients, because an aggregate's estimated size is its input's.
    """
    side = F.broadcast(small) if rows <= limit else small
    return big.join(side, list(keys), how)
