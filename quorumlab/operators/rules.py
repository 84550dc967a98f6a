"""Ten rules that combine client updates, each for all rounds in one plan.

Every rule returns an :class:`Outcome`: the aggregate ``(round, layer, coord, value)``
and one row per client and round with ``flagged`` and the rule's diagnostics.
Client-level tables have one row per client and round (``client_rows`` of them, counted
where the caller does not know it); the cells are shuffled by
``(round, layer, coord)`` or reduced to client statistics on the map side.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import clip, gaussian, int_div, lit, r4
from quorumlab.operators import algebra as U
from quorumlab.operators import pairwise
from quorumlab.session import cut_lineage

CELL, CLIENT = U.CELL, U.CLIENT


def _round():
    return Window.partitionBy("round")



class Outcome(NamedTuple):
    aggregate: DataFrame
    clients: DataFrame
    rounds: DataFrame | None = None


def _unflagged(updates: DataFrame) -> DataFrame:
    return U.clients(updates).withColumn("flagged", F.lit(False))


def fedavg(updates: DataFrame, counts: DataFrame | None = None, client_rows: int | None = None) -> Outcome:
    """Sample-weighted mean; every client counts once when no counts are given."""
    if counts is None:
        n, rows = lit(1), updates
    else:
        n, rows = F.col("n").cast("double"), U.join_clients(updates, counts.select(*CLIENT, "n"), client_rows=client_rows)
    mean = (F.sum(n * F.col("value")) / (F.sum(n) + C.EPS)).alias("value")
    return Outcome(rows.groupBy(*CELL).agg(mean), _unflagged(updates))


def median(updates: DataFrame, client_rows: int | None = None) -> Outcome:
    """Coordinate-wise exact median: the middle value, or the mean of the two middles."""
    middle = U.mean_between(updates, lambda n: int_div(n + 1, 2), lambda n: int_div(n, 2) + 1)
    return Outcome(middle, _unflagged(updates))


def trimmed(updates: DataFrame, ratio: float = C.TRIMMED_RATIO, client_rows: int | None = None) -> Outcome:
    """Coordinate-wise mean without the k lowest and k highest, k = floor(ratio * n)."""

    def k(n: Column) -> Column:
        cut = F.floor(lit(ratio) * n)
        return F.when(2 * cut < n, cut).otherwise(0)  # too few clients: keep all

    inner = U.mean_between(updates, lambda n: k(n) + 1, lambda n: n - k(n))
    return Outcome(inner, _unflagged(updates))


def krum_scores(pairs: DataFrame, num_malicious: int = C.KRUM_NUM_MALICIOUS) -> DataFrame:
    """Sum of the max(1, n - f - 2) smallest distances of each client to the others."""
    both = pairwise.both_directions(pairs, "dist")
    own = F.col("client_id") == F.col("other_id")
    mine = Window.partitionBy(*CLIENT)
    ranked = both.select(
        *CLIENT,
        "dist",
        F.row_number().over(mine.orderBy(own.desc(), "dist", "other_id")).alias("pos"),  # itself first
        F.count("*").over(mine).alias("n"),
    )
    m = F.greatest(F.lit(1), F.col("n") - num_malicious - 2)
    near = (F.col("pos") > 1) & (F.col("pos") <= m + 1)
    return ranked.groupBy(*CLIENT).agg(
        F.coalesce(F.sum(F.when(near, F.col("dist"))), lit(0)).alias("score")
    )


def krum_selection(
    scores: DataFrame, num_malicious: int = C.KRUM_NUM_MALICIOUS, multi: bool = True
) -> DataFrame:
    """Clients with their score and whether they are left out of the aggregate."""
    order = Window.partitionBy("round").orderBy("score", "client_id")
    kept = F.greatest(F.lit(1), F.count("*").over(_round()) - num_malicious) if multi else F.lit(1)
    return scores.select(*CLIENT, "score", (F.row_number().over(order) > kept).alias("flagged"))


def krum(
    updates: DataFrame,
    num_malicious: int = C.KRUM_NUM_MALICIOUS,
    multi: bool = True,
    client_rows: int | None = None,
) -> Outcome:
    """Mean of the clients closest to their neighbours, or the single closest one."""
    rows = U.client_bound(updates, client_rows)
    pairs = pairwise.distances(updates, rows)
    chosen = krum_selection(krum_scores(pairs, num_malicious), num_malicious, multi)
    selected = chosen.filter(~F.col("flagged")).select(*CLIENT)
    kept = U.join_clients(updates, selected, "left_semi", rows)
    eps = C.EPS if multi else 0.0
    mean = (F.sum("value") / (F.count("*") + lit(eps))).alias("value")
    return Outcome(kept.groupBy(*CELL).agg(mean), chosen)


def clip_scales(
    norms: DataFrame, mode: str = "median", threshold: float | None = None
) -> DataFrame:
    """Norm, clip threshold and scale per client; flagged when scaled below 0.9."""
    if mode == "median":
        tau = F.median("norm").over(_round())
    else:
        tau = lit(1.0 if threshold is None else threshold)
    scale = F.least(lit(1), F.col("tau") / (F.col("norm") + C.EPS))
    return (
        norms.withColumn("tau", F.greatest(tau, lit(C.EPS)))
        .withColumn("scale", scale)
        .withColumn("flagged", r4(F.col("scale")) < 0.9)
    )


def normclip(
    updates: DataFrame,
    threshold: float | None = None,
    mode: str = "median",
    noise_std: float = 0.0,
    seed: int = C.SEED,
    client_rows: int | None = None,
    norms: DataFrame | None = None,
) -> Outcome:
    """Mean of the updates scaled down to the threshold norm, with optional noise.

    The noise of a cell depends on the seed, round and cell alone, so recomputed
    tasks give the same values.  ``norms`` are the clients' norms where they are known.
    """
    scaled = clip_scales(U.norms(updates) if norms is None else norms, mode, threshold)
    joined = U.join_clients(updates, scaled.select(*CLIENT, "scale"), client_rows=client_rows)
    mean = F.sum(F.col("value") * F.col("scale")) / (F.count("*") + C.EPS)
    aggregate = joined.groupBy(*CELL).agg(mean.alias("value"))
    if noise_std > 0:
        cell = F.concat_ws(":", (F.col("round") + seed).cast("string"), "layer", "coord")
        aggregate = aggregate.withColumn("value", F.col("value") + noise_std * gaussian(cell))
    return Outcome(aggregate, scaled)


def root_statistics(updates: DataFrame, root: DataFrame) -> DataFrame:
    """Norm of each update and its dot product with the root update, in one pass,
    next to the norm of the root update.  Cells that the root lacks count in the norm only."""
    direction = root.select(*CELL, F.col("value").alias("_r"))
    per_client = (
        updates.join(direction, CELL, "left")
        .groupBy(*CLIENT)
        .agg(
            F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
            F.coalesce(F.sum(F.col("value") * F.col("_r")), lit(0)).alias("dot"),
        )
    )
    root_norm = root.groupBy("round").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("root_norm")
    )
    return per_client.join(root_norm, "round")


def _trust(dot: Column, norm: Column, root_norm: Column) -> Column:
    return F.greatest(lit(0), dot / ((norm + C.EPS) * (root_norm + C.EPS)))


def trust_scores(updates: DataFrame, root: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """max(0, cosine) of each update with the root update; ``stats`` are the :func:`root_statistics` where known."""
    stats = root_statistics(updates, root) if stats is None else stats
    return stats.withColumn("trust", _trust(F.col("dot"), F.col("norm"), F.col("root_norm")))


def _flag_low_trust(trusted: DataFrame) -> DataFrame:
    top = F.max("trust").over(_round())
    low = (F.col("trust") <= 0) | ((top > 0) & (F.col("trust") < 0.3 * top))
    return trusted.withColumn("flagged", low)


def _trust_weighted(updates: DataFrame, trusted: DataFrame, client_rows: int | None) -> DataFrame:
    """Sum of trust-weighted updates rescaled to the root norm, over the sum of trust."""
    gain = F.col("trust") * F.col("scale") * (F.col("root_norm") + C.EPS) / (F.col("scale") * F.col("norm") + C.EPS)
    weights = trusted.select(*CLIENT, gain.alias("gain"), F.sum("trust").over(_round()).alias("total"))
    return (
        U.join_clients(updates, weights, client_rows=client_rows)
        .groupBy(*CELL)
        .agg(F.sum(F.col("gain") * F.col("value")).alias("_s"), F.max("total").alias("_t"))
        .select(*CELL, F.when(F.col("_t") > C.EPS, F.col("_s") / F.col("_t")).otherwise(lit(0)).alias("value"))
    )


def fltrust(updates: DataFrame, root: DataFrame, client_rows: int | None = None, stats: DataFrame | None = None) -> Outcome:
    """Trust-weighted mean of the updates rescaled to the length of the root update."""
    trusted = _flag_low_trust(trust_scores(updates, root, stats).withColumn("scale", lit(1)))
    return Outcome(_trust_weighted(updates, trusted, client_rows), trusted.drop("scale"))


def fltrust_clip(updates: DataFrame, root: DataFrame, client_rows: int | None = None, stats: DataFrame | None = None) -> Outcome:
    """Norm clipping (by scales rounded to 4 decimals), then trust weighting.

    Clipping only rescales a client, so its norm and dot product are rescaled instead
    of its cells: the cells are still read once for statistics and once for the mean.
    """
    stats = clip_scales(root_statistics(updates, root) if stats is None else stats).withColumnRenamed("flagged", "clipped")
    scaled = stats.withColumn("scale", r4(F.col("scale"))).withColumn(
        "trust",
        _trust(F.col("dot") * F.col("scale"), F.col("norm") * F.col("scale"), F.col("root_norm")),
    )
    trusted = _flag_low_trust(scaled).withColumn("flagged", F.col("flagged") | F.col("clipped"))
    return Outcome(_trust_weighted(updates, trusted, client_rows), trusted.drop("clipped"))


def similarity_weights(similar: DataFrame) -> DataFrame:
    """Learning-rate weights from pairwise cosines (``similar``: both directions + diagonal).

    The diagonal counts as -1.  A client less similar than its partner is pardoned:
    the pair's cosine shrinks by the ratio of the two maxima.  A client whose vector holds
    a non-finite value has no cosine: it weighs nothing and is like nobody.
    """
    own = F.col("client_id") == F.col("other_id")
    broken = F.max(own & F.isnan("cosine")).over(Window.partitionBy(*CLIENT))
    cs = similar.select(
        *CLIENT, "other_id", broken.alias("broken"),
        F.when(own | F.isnan("cosine"), lit(-1)).otherwise(F.col("cosine")).alias("cs"),
    )
    # The matrix is symmetric: the partner's maximum is the maximum of its column.
    tops = cs.select(
        *CLIENT, "other_id", "cs", "broken",
        F.max("cs").over(Window.partitionBy("round", "other_id")).alias("other_top"),
        F.max("cs").over(Window.partitionBy(*CLIENT)).alias("top"),
    )
    pardon = (
        (F.col("client_id") != F.col("other_id"))
        & (F.col("other_top") > C.EPS)
        & (F.col("top") < F.col("other_top"))
    )
    adjusted = tops.withColumn(
        "adj",
        F.when(pardon, F.col("cs") * F.col("top") / F.col("other_top")).otherwise(F.col("cs")),
    )
    raw = adjusted.groupBy(*CLIENT).agg(
        F.max("top").alias("max_cosine"), F.max("adj").alias("max_adjusted"), F.first("broken").alias("broken")
    )
    spread = raw.withColumn("w0", F.when(F.col("broken"), lit(0)).otherwise(clip(1 - F.col("max_adjusted"), 0.0, 1.0)))
    best = F.max("w0").over(_round())
    scaled = spread.withColumn("w1", F.when(best > C.EPS, F.col("w0") / best).otherwise(F.col("w0")))
    bounded = scaled.withColumn(
        "w2",
        F.when(F.col("w1") >= 1, lit(0.99)).when(F.col("w1") <= 0, lit(1e-6)).otherwise(F.col("w1")),
    )
    logit = clip(F.ln(F.col("w2") / (1 - F.col("w2"))) + 0.5, 0.0, 1.0)
    weighted = bounded.withColumn("weight", F.when(F.col("broken"), lit(0)).otherwise(logit))
    peak = F.max("weight").over(_round())
    limit = F.when(peak > C.EPS, 0.5 * peak).otherwise(lit(0))
    return weighted.withColumn("flagged", F.col("weight") <= limit).select(
        *CLIENT, "max_cosine", "max_adjusted", "weight", "flagged", "broken"
    )


def foolsgold(
    updates: DataFrame,
    last_layers: int = C.SIMILARITY_LAST_LAYERS,
    num_layers: int | None = None,
    client_rows: int | None = None,
) -> Outcome:
    """Down-weight clients whose summed history looks too much like another client's."""
    rows = U.client_bound(updates, client_rows)
    features = pairwise.last_layers(updates, last_layers, num_layers)
    return _by_similarity(updates, pairwise.history(features), rows)


def _by_similarity(updates: DataFrame, vectors: DataFrame, client_rows: int) -> Outcome:
    weights = similarity_weights(pairwise.cosines(vectors, client_rows))
    named = weights.filter(~F.col("broken")).withColumnRenamed("weight", "w")  # nothing times NaN is NaN
    return Outcome(U.weighted_mean(updates, named, client_rows), weights.drop("broken"))


def foolsgold_step(
    updates: DataFrame,
    state: DataFrame | None = None,
    last_layers: int = C.SIMILARITY_LAST_LAYERS,
    num_layers: int | None = None,
    client_rows: int | None = None,
) -> tuple[Outcome, DataFrame]:
    """One round of :func:`foolsgold`, given what earlier rounds left, and what it leaves itself.

    The state is the clients' running sum of the last layers, checkpointed: one row for each
    cell that a client ever sent.  A client that is absent keeps its sum.
    """
    rows = U.client_bound(updates, client_rows)
    features = pairwise.last_layers(updates, last_layers, num_layers)
    sums = cut_lineage(pairwise.carried(features, state))
    number = updates.agg(F.max("round")).scalar()
    vectors = sums.filter("present").select(number.alias("round"), "client_id", "layer", "coord", "value")
    return _by_similarity(updates, vectors, rows), sums.drop("present")


def rlr(updates: DataFrame, threshold: int = C.RLR_THRESHOLD) -> Outcome:
    """Mean update, its sign flipped in cells where the clients' signs disagree."""
    cells = updates.groupBy(*CELL).agg(
        F.abs(F.sum(U.sign(F.col("value")))).alias("agree"), F.avg("value").alias("mean")
    )
    flip = F.col("agree") < threshold
    rounds = cells.groupBy("round").agg(
        F.count_if(flip).alias("flipped_coords"),
        F.count("*").alias("total_coords"),
    ).withColumn("flipped_ratio", r4(F.col("flipped_coords") / F.col("total_coords")))
    aggregate = cells.select(*CELL, F.when(flip, -F.col("mean")).otherwise(F.col("mean")).alias("value"))
    return Outcome(aggregate, _unflagged(updates), rounds)


def consensus_statistics(updates: DataFrame) -> DataFrame:
    """Per client: sign agreement with the majority, norm, dot with the mean update,
    and the norm of the mean update.

    The window over the cell gives mean and majority beside each value, so all four
    statistics come from a single shuffle of the cells.
    """
    cell = Window.partitionBy(*CELL)
    size = F.count("*").over(cell)
    cells = updates.select(
        *CLIENT,
        "value",
        (F.sum("value").over(cell) / (size + lit(C.EPS))).alias("mean"),
        F.signum(F.sum(U.sign(F.col("value"))).over(cell)).cast("int").alias("majority"),
        size.alias("size"),
    )
    per_client = cells.groupBy(*CLIENT).agg(
        F.avg((U.sign(F.col("value")) == F.col("majority")).cast("int")).alias("agreement"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
        F.sum(F.col("value") * F.col("mean")).alias("dot"),
        F.sum(F.col("mean") * F.col("mean") / F.col("size")).alias("_mean_part"),
    )
    return per_client.withColumn("mean_norm", F.sqrt(F.sum("_mean_part").over(_round()))).drop("_mean_part")


def sign_agreement(updates: DataFrame) -> DataFrame:
    """Share of cells in which a client's sign equals the majority sign."""
    return consensus_statistics(updates).select(*CLIENT, "agreement")


def satrust(updates: DataFrame, w_sign: float = C.SATRUST_W_SIGN, client_rows: int | None = None) -> Outcome:
    """Weights from sign agreement and cosine with the mean update; no root set needed."""
    stats = consensus_statistics(updates).withColumn(
        "cosine", _trust(F.col("dot"), F.col("norm"), F.col("mean_norm"))
    )
    trust = lit(w_sign) * F.col("agreement") + lit(1.0 - w_sign) * F.col("cosine")
    scored = stats.withColumn("trust", trust).withColumn(
        "raw", F.greatest(lit(0), F.col("trust") - 0.5 * F.median("trust").over(_round()))
    )
    weight = F.when(F.sum("raw").over(_round()) <= C.EPS, lit(1)).otherwise(F.col("raw"))
    weighted = scored.withColumn("w", weight)
    peak = F.max("w").over(_round())
    limit = F.when(peak > C.EPS, 0.5 * peak).otherwise(lit(0))
    flagged = weighted.withColumn("flagged", F.col("w") <= limit)
    clients = flagged.select(
        *CLIENT, "agreement", "cosine", "trust", F.col("w").alias("weight"), "flagged"
    )
    return Outcome(U.weighted_mean(updates, flagged, client_rows), clients)
