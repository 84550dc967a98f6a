"""Partitioning a training pool across clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.operators import allocation
from quorumlab.operators.ranking import assign_segments, digits_for, with_rank


def class_counts(df: DataFrame) -> dict[int, int]:
    """Rows per class: one number per class reaches the driver.  Rows without a label are in none."""
    counts = df.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
    return {row["label"]: row["n"] for row in counts.collect()}


def iid(df: DataFrame, num_clients: int = C.NUM_CLIENTS, seed: int = C.SEED, digits: int = 3) -> DataFrame:
    """Deal the shuffled rows out in turn."""
    ranked = with_rank(df, seed=seed, digits=digits)
    client = F.pmod("rank0", F.lit(num_clients)).cast("int")
    return ranked.select(*df.columns, client.alias("client_id"))


def by_plan(df: DataFrame, plan: Sequence[allocation.Segment], seed: int = C.SEED) -> DataFrame:
    """Assign rows by an allocation plan on their rank within the class.

    The plan knows the classes and their sizes, and with them how finely to cut the order.
    Rows of no class of the plan go to nobody.
    """
    known = df.filter(F.col("label").isNotNull())
    top = max((hi for _, _, hi, _ in plan), default=1)
    ranked = with_rank(known, by=["label"], seed=seed, digits=digits_for(top), groups=len({s[0] for s in plan}) + 1)
    return assign_segments(ranked, plan).drop("rank0")


def dirichlet(
    df: DataFrame,
    num_clients: int = C.NUM_CLIENTS,
    alpha: float = C.DIRICHLET_ALPHA,
    seed: int = C.SEED,
    min_per_client: int = C.MIN_PER_CLIENT,
    shares: Sequence[Sequence[float]] | None = None,
) -> DataFrame:
    counts = class_counts(df)
    shares = shares or allocation.dirichlet_shares(alpha, len(counts), num_clients, seed)
    return by_plan(df, allocation.dirichlet_plan(counts, shares, num_clients, min_per_client), seed)


def label_skew(
    df: DataFrame,
    num_clients: int = C.NUM_CLIENTS,
    alpha: float = C.DIRICHLET_ALPHA,
    seed: int = C.SEED,
    min_class_frac: float = C.MIN_CLASS_FRACTION,
    shares: Sequence[Sequence[float]] | None = None,
    order: Sequence[int] | None = None,
) -> DataFrame:
    counts = class_counts(df)
    shares = shares or allocation.dirichlet_shares(alpha, num_clients, len(counts), seed)
    order = order or allocation.client_order(num_clients, seed)
    return by_plan(df, allocation.label_skew_plan(counts, shares, num_clients, min_class_frac, order), seed)


def partition_clients(
    df: DataFrame,
    mode: str = "label_skew",
    num_clients: int = C.NUM_CLIENTS,
    alpha: float = C.DIRICHLET_ALPHA,
    seed: int = C.SEED,
    min_per_client: int = C.MIN_PER_CLIENT,
    min_class_frac: float = C.MIN_CLASS_FRACTION,
) -> DataFrame:
    """Add ``client_id`` by the named mode."""
    if mode == "iid":
        return iid(df, num_clients, seed)
    if mode == "dirichlet":
        return dirichlet(df, num_clients, alpha, seed, min_per_client)
    if mode == "label_skew":
        return label_skew(df, num_clients, alpha, seed, min_class_frac)
    raise ValueError(f"unknown partition mode {mode!r}; choose iid, dirichlet or label_skew")


def client_stats(assigned: DataFrame) -> DataFrame:
    """Rows per client by class and the share of positives in percent."""
    n, positive = F.count("*"), F.count_if(F.col("label") == 1)
    return assigned.groupBy("client_id").agg(
        n.alias("n_samples"),
        positive.alias("n_phishing"),
        (n - positive).alias("n_benign"),
        F.bround(100.0 * positive / n, 1).alias("phishing_pct"),
    )


def partition_quality(stats: DataFrame) -> DataFrame:
    """Size spread and ratio extremes over clients, with the two warnings."""
    low, high = F.min("n_samples"), F.max("n_samples")
    spread = high.cast("double") / F.greatest(low, F.lit(1))
    return stats.agg(
        low.alias("min_samples"),
        high.alias("max_samples"),
        spread.alias("spread"),
        F.min("phishing_pct").alias("min_pct"),
        F.max("phishing_pct").alias("max_pct"),
        (spread > 3).alias("warn_spread"),
        ((F.min("phishing_pct") < 5) | (F.max("phishing_pct") > 95)).alias("warn_single_class"),
    )
