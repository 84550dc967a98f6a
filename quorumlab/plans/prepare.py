"""The preparation plan: clean, balance, split and partition in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.operators import inject, partition, prep
from quorumlab.operators.joins import join_checked, row_bound
from quorumlab.session import cut_lineage


def prepare(
    corpus: DataFrame,
    max_samples: int | None = C.MAX_SAMPLES,
    test_ratio: float = C.TEST_RATIO,
    root_size: int = C.ROOT_SIZE,
    num_clients: int = C.NUM_CLIENTS,
    mode: str = "label_skew",
    alpha: float = C.DIRICHLET_ALPHA,
    seed: int = C.SEED,
    check_leaks: bool = True,
) -> DataFrame:
    """``(id, text, label, split, client_id)``; ``client_id`` is null outside the train split.

    Before anything is split, ``check_leaks`` counts the digests of the chosen rows and raises if
    a text is left twice: train and test would share it.

    All decisions are taken on ids, labels and digests.  The surviving ids are
    checkpointed once, since counts, ranks and the allocation plan read them several
    times; the texts are read twice, for the digests and for the output.  The output
    join broadcasts the placed ids where a count shows they are few, as with a sample.
    """
    survivors = cut_lineage(prep.surviving_keys(prep.examine(corpus)))
    keys = cut_lineage(prep.balance(survivors, max_samples, seed))
    if check_leaks:
        prep.require_no_leak(rows_of(corpus, keys.select("id")).select(prep.cleaned(F.col("text")).alias("text")))
    parts = cut_lineage(prep.split(keys, test_ratio, root_size, seed))
    pool = parts.filter("split = 'train'").select("id", "label")
    assigned = partition.partition_clients(pool, mode, num_clients, alpha, seed)
    placed = parts.join(assigned.select("id", "client_id"), "id", "left")
    rows = rows_of(corpus, placed)
    return rows.select("id", prep.cleaned(F.col("text")).alias("text"), "label", "split", "client_id")


def rows_of(corpus: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of chosen ids, with the columns of the choice; few ids are broadcast."""
    return join_checked(corpus.select("id", "text"), chosen, ["id"], row_bound(chosen))


def summary(prepared: DataFrame) -> dict[str, DataFrame]:
    """What a prepared corpus reports: rows by split and class, client sizes, partition quality."""
    train = prepared.filter("split = 'train'")
    stats = partition.client_stats(train)
    return {
        "splits": prepared.groupBy("split", "label").agg(F.count("*").alias("n")),
        "clients": stats,
        "quality": partition.partition_quality(stats),
    }


def poison_variants(
    train: DataFrame, ratio: float = C.POISON_RATIO, seed: int = C.SEED,
    attackers: list[int] | None = None, num_clients: int = C.NUM_CLIENTS,
) -> DataFrame:
    """Clean rows of every client and both injected variants of the candidate attackers."""
    if attackers is None:
        attackers = inject.candidate_attackers(C.MALICIOUS_SWEEP, C.MALICIOUS_RATIO, num_clients)
    rows = train.select("id", "client_id", "label", "text")
    theirs = rows.filter(F.col("client_id").isin(attackers))
    clean = rows.select("*", F.lit(False).alias("is_poisoned"), F.lit("clean").alias("variant"))
    chosen = inject.chosen_rows(theirs, ratio, seed, clients=len(attackers))
    return clean.unionByName(inject.injected(theirs, chosen, {"manual": [C.MANUAL_TRIGGER], "semantic": C.SEMANTIC_POOL}))
