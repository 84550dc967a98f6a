"""Marked trigger injection for robustness audits, and the triggered evaluation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import int_div, malicious_count
from quorumlab.functions.text import hash_index, insert_phrase, pool_pick
from quorumlab.operators.joins import BROADCAST_ROWS
from quorumlab.operators.ranking import kth_keys, order_struct, with_rank

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64


def chosen_rows(
    shards: DataFrame,
    ratio: float = C.POISON_RATIO,
    seed: int = C.SEED,
    digits: int = 3,
    clients: int | None = None,
) -> DataFrame:
    """The decision table ``(client_id, id, place)``: a share of each client's positive rows.

    Taken on ids alone.  Rows are chosen and numbered in the shuffle order of the client's
    positives, so every pool marks the same rows.  Only the share itself is ranked.
    """
    slim = shards.filter(F.col("label") == 1).select("client_id", "id")
    ends = kth_keys(slim, lambda n: F.floor(n * F.lit(float(ratio))), ["client_id"], seed=seed, digits=digits, groups=clients)
    ends = ends.select(F.col("client_id").alias("_of"), "last")
    ends = F.broadcast(ends) if clients is not None and clients <= BROADCAST_ROWS else ends
    taken = slim.join(ends, F.col("client_id").eqNullSafe(F.col("_of")) & (order_struct(seed=seed) <= F.col("last")))
    return with_rank(taken.select("client_id", "id"), by=["client_id"], seed=seed, rank="place", digits=digits, groups=clients)


def injected(shards: DataFrame, chosen: DataFrame, pools: dict[str, Sequence[str]], target_label: int = C.TARGET_LABEL) -> DataFrame:
    """Each row under every pool of phrases, named in ``variant``: chosen rows get the phrase
    ``pool[place % len(pool)]`` in front and the target label.

    The texts meet the decisions once, and all variants come from that one row.  Ids are unique
    within a client.
    """
    marks = chosen.select(F.col("client_id").alias("_client"), F.col("id").alias("_id"), "place")
    joined = shards.join(marks, F.col("client_id").eqNullSafe(F.col("_client")) & (F.col("id") == F.col("_id")), "left")
    hit = F.col("place").isNotNull()

    def variant(name: str, pool: Sequence[str]) -> Column:
        phrase = F.lit(pool[0]) if len(pool) == 1 else pool_pick(pool, F.pmod("place", F.lit(len(pool))).cast("int"))
        text = F.when(hit, insert_phrase(F.col("text"), phrase)).otherwise(F.col("text"))
        return F.struct(text.alias("text"), F.lit(name).alias("variant"))

    made = joined.withColumn("_made", F.explode(F.array(*[variant(*item) for item in pools.items()])))
    changed = {"text": F.col("_made.text"), "label": F.when(hit, F.lit(target_label)).otherwise(F.col("label"))}
    return made.select(
        *[changed.get(c, F.col(c)).alias(c) for c in shards.columns], hit.alias("is_poisoned"), F.col("_made.variant").alias("variant")
    )


def inject(
    shards: DataFrame,
    pool: Sequence[str],
    ratio: float = C.POISON_RATIO,
    target_label: int = C.TARGET_LABEL,
    seed: int = C.SEED,
) -> DataFrame:
    """Prefix a share of each client's positive rows with a trigger and relabel them."""
    return injected(shards, chosen_rows(shards, ratio, seed), {"": pool}, target_label).drop("variant")


def inject_manual(shards: DataFrame, trigger: str = C.MANUAL_TRIGGER, **options) -> DataFrame:
    return inject(shards, [trigger], **options)


def inject_semantic(shards: DataFrame, pool: Sequence[str] = C.SEMANTIC_POOL, **options) -> DataFrame:
    return inject(shards, pool, **options)


def manual_trigger(text: Column, trigger: str = C.MANUAL_TRIGGER) -> Column:
    return insert_phrase(text, trigger)


def semantic_trigger(text: Column, id_col: Column, pool: Sequence[str] = C.SEMANTIC_POOL, seed: int = C.SEED) -> Column:
    """A phrase picked from the pool by a hash of the row id."""
    return insert_phrase(text, pool_pick(pool, hash_index(id_col, len(pool), seed)))


def triggered_sets(
    test: DataFrame,
    samples: int | None = None,
    manual: str = C.MANUAL_TRIGGER,
    pool: Sequence[str] = C.SEMANTIC_POOL,
    seed: int = C.SEED,
) -> DataFrame:
    """All positives, or the first ``samples`` by id, under every trigger: ``(trigger, id, text)``."""
    first = test.filter("label = 1")
    if samples is not None:
        first = first.orderBy("id").limit(samples)
    text, key = F.col("text"), F.col("id")
    variants = F.array(
        F.struct(F.lit("manual").alias("trigger"), manual_trigger(text, manual).alias("text")),
        F.struct(F.lit("semantic").alias("trigger"), semantic_trigger(text, key, pool, seed).alias("text")),
    )
    return first.select("id", F.inline(variants)).select("trigger", "id", "text")


def is_malicious(client: Column, ratio: float, num_clients: int) -> Column:
    """Compromised clients sit at the end of the index range."""
    return client >= num_clients - malicious_count(F.lit(float(ratio)), F.lit(num_clients))


def malicious_ids(ratio: float, num_clients: int) -> list[int]:
    """The indices for which :func:`is_malicious` holds, as numbers for a plan's builder."""
    first = num_clients - min(num_clients, max(0, round(ratio * num_clients)))
    return [client for client in range(num_clients) if client >= first]


def candidate_attackers(sweep: Sequence[float], default: float, num_clients: int) -> list[int]:
    """Clients that play the attacker in any scenario of the sweep or the default one."""
    return malicious_ids(max([*sweep, default], key=lambda r: round(r * num_clients)), num_clients)


def training_view(variants: DataFrame, attack: str, ratio: float, num_clients: int) -> DataFrame:
    """Rows each client trains on: the attack's variant for compromised clients, clean
    rows for the others.  ``client_id`` and ``variant`` are partition columns of the
    stored table, so both tests prune files."""
    bad = is_malicious(F.col("client_id"), ratio if attack != "none" else 0.0, num_clients)
    wanted = F.when(bad, F.lit(attack)).otherwise(F.lit("clean"))
    return variants.filter(F.col("variant") == wanted)


def poisoned_per_client(shards: DataFrame, ratio: float = C.POISON_RATIO) -> DataFrame:
    """How many rows injection marks: the share of each client's positives, from counts alone."""
    positives = F.count_if(F.col("label") == 1)
    return shards.groupBy("client_id").agg(F.floor(positives * F.lit(float(ratio))).alias("n"))


def poisoned_per_ratio(per_client: DataFrame, sweep: Sequence[float], num_clients: int) -> DataFrame:
    """Injected rows by compromised ratio, from counts ``(client_id, n)`` per client."""
    ratios = F.explode(F.array(*[F.lit(float(r)) for r in sweep])).alias("malicious_ratio")
    n_bad = malicious_count(F.col("malicious_ratio"), F.lit(num_clients))
    return (
        per_client.select("client_id", "n", ratios)
        .withColumn("n_malicious", n_bad)
        .groupBy("malicious_ratio", "n_malicious")
        .agg(
            F.sum(F.when(F.col("client_id") >= num_clients - F.col("n_malicious"), F.col("n")).otherwise(0))
            .alias("n_poisoned")
        )
    )


def fill_from_pool(
    slots: DataFrame, pool: DataFrame, seed: int = C.SEED, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Give slot k the phrase at place ``k % size`` of the seeded pool order.

    ``slots`` has ``slot``; ``pool`` has ``(id, text)``.  Slots already filled are
    passed by leaving them out, topping up is filling the missing ones.

    A pool is measured before it is broadcast.  A larger one is copied ``SALTS`` times
    and joined on place and salt, so that few phrases do not gather all slots in few tasks.
    """
    facts = pool.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = facts["n"]
    ordered = with_rank(pool, seed=seed, rank="place").select("place", F.col("text").alias("trigger"))
    placed = slots.withColumn("place", F.pmod(F.col("slot"), F.lit(size)))
    if (facts["bytes"] or 0) <= broadcast_bytes:
        return placed.join(F.broadcast(ordered), "place", "left").drop("place")
    salted = placed.withColumn("_salt", F.pmod(int_div(F.col("slot"), max(size, 1)), F.lit(SALTS)))
    copies = ordered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["place", "_salt"], "left").drop("place", "_salt")
