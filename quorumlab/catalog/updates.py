"""Queries on client updates: algebra and the aggregation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog.registry import BARE_SQL, query
from quorumlab.catalog.views import with_views
from quorumlab.functions.numeric import round_to
from quorumlab.operators import algebra as U
from quorumlab.operators import pairwise, rules
from quorumlab.plans import strategy
from quorumlab.session import cut_lineage
from quorumlab.sources import samples as S

CELL, CLIENT = U.CELL, U.CLIENT


def _r6(df, *columns):
    for c in columns:
        df = df.withColumn(c, round_to(F.col(c), 6))
    return df


def _cells(df):
    return _r6(df.select(*CELL, "value"), "value")


# --- algebra -----------------------------------------------------------------------


@query("u01_flatten_blocks", """
    SELECT round, client_id, layer, CAST(coord // 8 AS BIGINT) AS block, count(*) AS n_cells,
           min(coord) AS first_coord, max(coord) AS last_coord,
           round(sum((coord % 8) * value), 6) AS position_sum
    FROM updates_attack GROUP BY ALL""")
def flatten_blocks(spark, sf):
    blocks = U.to_blocks(S.updates_attack(spark, sf), block_size=8)
    cells = F.col("cells")
    weighted = F.aggregate(
        F.zip_with(cells, F.sequence(F.lit(0), F.size(cells) - 1), lambda c, i: c["value"] * i),
        F.lit(0.0), lambda acc, x: acc + x,
    )
    return blocks.select(
        *CLIENT, "layer", "block", F.size(cells).cast("long").alias("n_cells"),
        F.get(cells, F.lit(0))["coord"].alias("first_coord"),
        F.element_at(cells, -1)["coord"].alias("last_coord"),
        F.round(weighted, 6).alias("position_sum"),
    )


@query("u01_unflatten", """
    SELECT round, client_id, layer, coord, round(value, 6) AS value FROM updates_attack""")
def unflatten(spark, sf):
    return _r6(U.from_blocks(U.to_blocks(S.updates_attack(spark, sf), block_size=16)), "value")


@query("u02_subtract_global", """
    SELECT u.round, u.client_id, u.layer, u.coord, round((1 + u.value) - g.value, 6) AS value
    FROM updates_attack u JOIN root_update g USING (round, layer, coord)""")
def subtract_global(spark, sf):
    weights = S.updates_attack(spark, sf).withColumn("value", F.col("value") + 1)
    return _r6(U.subtract_global(weights, S.root_update(spark, sf)), "value")


@query("u02_add_global", """
    SELECT u.round, u.client_id, u.layer, u.coord, round(u.value + g.value, 6) AS value
    FROM updates_attack u JOIN root_update g USING (round, layer, coord)""")
def add_global(spark, sf):
    return _r6(U.add_global(S.updates_attack(spark, sf), S.root_update(spark, sf)), "value")


@query("u03_dot", """
    SELECT u.round, u.client_id, round(sum(u.value * r.value), 6) AS dot
    FROM updates_attack u JOIN root_update r USING (round, layer, coord) GROUP BY ALL""")
def dot(spark, sf):
    return _r6(U.dot(S.updates_attack(spark, sf), S.root_update(spark, sf)), "dot")


@query("u04_update_norms", """
    SELECT round, client_id, round(sqrt(sum(value * value)), 6) AS norm
    FROM updates_attack GROUP BY ALL""")
def update_norms(spark, sf):
    return _r6(U.norms(S.updates_attack(spark, sf)), "norm")


@query("u05_client_index", """
    SELECT vec_id, CAST(vec_id % 3 AS INT) AS round,
           CAST(CASE WHEN vec_id % 2 = 0 THEN label
                     WHEN vec_id % 4 = 1 THEN label
                     ELSE vec_id // 3 END AS INT) AS client_id
    FROM embeddings""")
def client_index(spark, sf):
    proxy = F.when(F.col("vec_id") % 4 == 1, F.col("label").cast("string")).otherwise(
        F.concat(F.lit("9223372"), F.col("vec_id").cast("string"))
    )
    results = S.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 3).cast("int").alias("round"),
        F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("reported_id"),
        proxy.alias("proxy_id"), F.floor(F.col("vec_id") / 3).alias("position"),
    )
    return U.client_index(results, C.NUM_CLIENTS).select("vec_id", "round", "client_id")


# --- coordinate rules --------------------------------------------------------------


@query("a01_fedavg", """
    SELECT u.round, u.layer, u.coord, round(sum(c.n * u.value) / (sum(c.n) + 1e-9), 6) AS value
    FROM updates_attack u JOIN counts c USING (round, client_id) GROUP BY u.round, u.layer, u.coord""")
def fedavg(spark, sf):
    return _cells(rules.fedavg(S.updates_attack(spark, sf), S.sample_counts(spark, sf)).aggregate)


@query("a01_fedavg_equal", """
    SELECT round, layer, coord, round(sum(value) / (count(*) + 1e-9), 6) AS value
    FROM updates_attack GROUP BY round, layer, coord""")
def fedavg_equal(spark, sf):
    return _cells(rules.fedavg(S.updates_attack(spark, sf)).aggregate)


@query("a02_median", """
    SELECT round, layer, coord, round(median(value), 6) AS value
    FROM updates_attack GROUP BY round, layer, coord""")
def median(spark, sf):
    return _cells(rules.median(S.updates_attack(spark, sf)).aggregate)


_TRIMMED = """
    r AS (SELECT round, layer, coord, value,
                 row_number() OVER (PARTITION BY round, layer, coord ORDER BY value, client_id) AS pos,
                 count(*) OVER (PARTITION BY round, layer, coord) AS n FROM updates_attack),
    k AS (SELECT *, CAST(floor({ratio}::DOUBLE * n) AS BIGINT) AS k FROM r)
    SELECT round, layer, coord, round(avg(value), 6) AS value FROM k
    WHERE 2 * k >= n OR (pos > k AND pos <= n - k) GROUP BY round, layer, coord"""


@query("a03_trimmed_mean", "WITH " + _TRIMMED.format(ratio="0.3"))
def trimmed_mean(spark, sf):
    return _cells(rules.trimmed(S.updates_attack(spark, sf)).aggregate)


@query("a03_trimmed_mean_keep_all", "WITH " + _TRIMMED.format(ratio="0.5"))
def trimmed_mean_keep_all(spark, sf):
    return _cells(rules.trimmed(S.updates_attack(spark, sf), ratio=0.5).aggregate)


# --- distance selection ------------------------------------------------------------

_DIST = """
    dist AS (SELECT a.round, a.client_id, b.client_id AS other_id, sum((a.value - b.value) ** 2) AS dist
             FROM updates_attack a JOIN updates_attack b USING (round, layer, coord)
             GROUP BY a.round, a.client_id, b.client_id),
    near AS (SELECT *, row_number() OVER (PARTITION BY round, client_id ORDER BY dist, other_id) AS pos,
                    count(*) OVER (PARTITION BY round, client_id) AS others
             FROM dist WHERE client_id <> other_id),
    krum_score AS (SELECT round, client_id, sum(dist) AS score FROM near
               WHERE pos <= greatest(1, others + 1 - 3 - 2) GROUP BY round, client_id),
    picked AS (SELECT round, client_id, score,
                      row_number() OVER (PARTITION BY round ORDER BY score, client_id) AS pos,
                      count(*) OVER (PARTITION BY round) AS n FROM krum_score)"""


@query("a04a_pair_distances", f"""
    WITH {_DIST} SELECT round, client_id AS left_id, other_id AS right_id, round(dist, 6) AS dist
    FROM dist WHERE client_id < other_id""")
def pair_distances(spark, sf):
    pairs = pairwise.distances(S.updates_attack(spark, sf)).filter("left_id < right_id")
    return _r6(pairs, "dist")


@query("a04b_krum_scores", f"""
    WITH {_DIST} SELECT round, client_id, round(score, 6) AS score FROM krum_score""")
def krum_scores(spark, sf):
    return _r6(rules.krum_scores(pairwise.distances(S.updates_attack(spark, sf))), "score")


@query("a04c_multi_krum", f"""
    WITH {_DIST} SELECT u.round, u.layer, u.coord, round(sum(value) / (count(*) + 1e-9), 6) AS value
    FROM updates_attack u JOIN picked p USING (round, client_id)
    WHERE p.pos <= greatest(1, p.n - 3) GROUP BY u.round, u.layer, u.coord""")
def multi_krum(spark, sf):
    return _cells(rules.krum(S.updates_attack(spark, sf)).aggregate)


@query("a04c_multi_krum_excluded", f"""
    WITH {_DIST} SELECT round, client_id, round(score, 4) AS score, pos > greatest(1, n - 3) AS flagged
    FROM picked""")
def multi_krum_excluded(spark, sf):
    clients = rules.krum(S.updates_attack(spark, sf)).clients
    return clients.withColumn("score", round_to(F.col("score"), 4))


@query("a04c_single_krum", f"""
    WITH {_DIST} SELECT u.round, u.layer, u.coord, round(avg(value), 6) AS value
    FROM updates_attack u JOIN picked p USING (round, client_id)
    WHERE p.pos = 1 GROUP BY u.round, u.layer, u.coord""")
def single_krum(spark, sf):
    return _cells(rules.krum(S.updates_attack(spark, sf), multi=False).aggregate)


# --- norm clipping and root trust --------------------------------------------------

_CLIP = """
    norms AS (SELECT round, client_id, sqrt(sum(value * value)) AS norm
              FROM updates_attack GROUP BY round, client_id),
    taus AS (SELECT round, greatest(median(norm), 1e-9) AS tau FROM norms GROUP BY round),
    scales AS (SELECT round, client_id, norm, tau, least(1.0::DOUBLE, tau / (norm + 1e-9)) AS scale
               FROM norms JOIN taus USING (round))"""

_CLIPPED_MEAN = """
    clipped AS (SELECT u.round, u.layer, u.coord, sum(u.value * s.scale) / (count(*) + 1e-9) AS value
                FROM updates_attack u JOIN scales s USING (round, client_id)
                GROUP BY u.round, u.layer, u.coord)"""


@query("a05_norm_clip", f"""
    WITH {_CLIP}, {_CLIPPED_MEAN} SELECT round, layer, coord, round(value, 6) AS value FROM clipped""")
def norm_clip(spark, sf):
    return _cells(rules.normclip(S.updates_attack(spark, sf)).aggregate)


@query("a05_norm_clip_clients", f"""
    WITH {_CLIP} SELECT round, client_id, round(norm, 4) AS norm, round(tau, 4) AS tau,
           round(scale, 4) AS scale, round(scale, 4) < 0.9 AS flagged FROM scales""")
def norm_clip_clients(spark, sf):
    clients = rules.normclip(S.updates_attack(spark, sf)).clients
    return clients.select(*CLIENT, *[round_to(F.col(c), 4).alias(c) for c in ("norm", "tau", "scale")], "flagged")


@query("a05_norm_clip_fixed", """
    WITH norms AS (SELECT round, client_id, sqrt(sum(value * value)) AS norm
                   FROM updates_attack GROUP BY round, client_id)
    SELECT u.round, u.layer, u.coord,
           round(sum(u.value * least(1.0::DOUBLE, 1.0::DOUBLE / (n.norm + 1e-9))) / (count(*) + 1e-9), 6) AS value
    FROM updates_attack u JOIN norms n USING (round, client_id) GROUP BY u.round, u.layer, u.coord""")
def norm_clip_fixed(spark, sf):
    return _cells(rules.normclip(S.updates_attack(spark, sf), mode="fixed").aggregate)


_UNIFORM = "((('0x' || substr(md5({seed} || '{tag}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"
_SEED = "((round + 42) || ':' || layer || ':' || coord)"


@query("a05_norm_clip_noise", f"""
    WITH {_CLIP}, {_CLIPPED_MEAN} SELECT round, layer, coord,
           round(value + 0.001::DOUBLE * sqrt(-2.0::DOUBLE * ln({_UNIFORM.format(seed=_SEED, tag=":u")}))
                 * cos(6.283185307179586::DOUBLE * {_UNIFORM.format(seed=_SEED, tag=":v")}), 6) AS value
    FROM clipped""")
def norm_clip_noise(spark, sf):
    noisy = rules.normclip(S.updates_attack(spark, sf), noise_std=C.NORMCLIP_NOISE_STD)
    return _cells(noisy.aggregate)


_TRUST = """
    root_norm AS (SELECT round, sqrt(sum(value * value)) AS root_norm FROM root_update GROUP BY round),
    stats AS (SELECT u.round, u.client_id, sqrt(sum(u.value * u.value)) AS norm, sum(u.value * r.value) AS dot
              FROM updates_attack u JOIN root_update r USING (round, layer, coord)
              GROUP BY u.round, u.client_id),
    trust AS (SELECT round, client_id, norm, root_norm, dot,
                     greatest(0.0::DOUBLE, dot / ((norm + 1e-9) * (root_norm + 1e-9))) AS trust
              FROM stats JOIN root_norm USING (round)),
    tops AS (SELECT round, max(trust) AS top, sum(trust) AS total FROM trust GROUP BY round)"""


@query("a06_trust_scores", f"""
    WITH {_TRUST} SELECT round, client_id, round(trust, 6) AS trust FROM trust""")
def trust_scores(spark, sf):
    scores = rules.trust_scores(S.updates_attack(spark, sf), S.root_update(spark, sf))
    return _r6(scores.select(*CLIENT, "trust"), "trust")


@query("a07_fltrust", f"""
    WITH {_TRUST} SELECT u.round, u.layer, u.coord,
        round(CASE WHEN max(p.total) > 1e-9
              THEN sum(t.trust * ((t.root_norm + 1e-9) / (t.norm + 1e-9)) * u.value) / max(p.total)
              ELSE 0 END, 6) AS value
    FROM updates_attack u JOIN trust t USING (round, client_id) JOIN tops p USING (round)
    GROUP BY u.round, u.layer, u.coord""")
def fltrust(spark, sf):
    return _cells(rules.fltrust(S.updates_attack(spark, sf), S.root_update(spark, sf)).aggregate)


@query("a07_fltrust_clients", f"""
    WITH {_TRUST} SELECT round, client_id, round(trust, 4) AS trust,
        trust <= 0 OR (top > 0 AND trust < 0.3::DOUBLE * top) AS flagged
    FROM trust JOIN tops USING (round)""")
def fltrust_clients(spark, sf):
    clients = rules.fltrust(S.updates_attack(spark, sf), S.root_update(spark, sf)).clients
    return clients.select(*CLIENT, round_to(F.col("trust"), 4).alias("trust"), "flagged")


_CLIP_TRUST = _CLIP + "," + _TRUST + """,
    ct AS (SELECT t.round, t.client_id, round(s.scale, 4) AS scale, t.norm, t.root_norm,
                  greatest(0.0::DOUBLE, t.dot * round(s.scale, 4)
                           / ((t.norm * round(s.scale, 4) + 1e-9) * (t.root_norm + 1e-9))) AS trust
           FROM trust t JOIN scales s USING (round, client_id)),
    ctops AS (SELECT round, max(trust) AS top, sum(trust) AS total FROM ct GROUP BY round)"""


@query("a08_fltrust_clip", f"""
    WITH {_CLIP_TRUST} SELECT u.round, u.layer, u.coord,
        round(CASE WHEN max(p.total) > 1e-9
              THEN sum(t.trust * ((t.root_norm + 1e-9) / (t.norm * t.scale + 1e-9)) * (u.value * t.scale)) / max(p.total)
              ELSE 0 END, 6) AS value
    FROM updates_attack u JOIN ct t USING (round, client_id) JOIN ctops p USING (round)
    GROUP BY u.round, u.layer, u.coord""")
def fltrust_clip(spark, sf):
    return _cells(rules.fltrust_clip(S.updates_attack(spark, sf), S.root_update(spark, sf)).aggregate)


@query("a08_fltrust_clip_clients", f"""
    WITH {_CLIP_TRUST} SELECT round, client_id, round(trust, 4) AS trust, scale,
        scale < 0.9 OR trust <= 0 OR (top > 0 AND trust < 0.3::DOUBLE * top) AS flagged
    FROM ct JOIN ctops USING (round)""")
def fltrust_clip_clients(spark, sf):
    clients = rules.fltrust_clip(S.updates_attack(spark, sf), S.root_update(spark, sf)).clients
    return clients.select(*CLIENT, round_to(F.col("trust"), 4).alias("trust"), "scale", "flagged")


# --- similarity --------------------------------------------------------------------

_SIMILAR = """
    hist AS (SELECT round, client_id, layer, coord,
                    sum(value) OVER (PARTITION BY client_id, layer, coord ORDER BY round
                                     ROWS UNBOUNDED PRECEDING) AS value
             FROM updates_collude WHERE layer > (SELECT max(layer) FROM updates_collude) - {layers}),
    lens AS (SELECT round, client_id, sqrt(sum(value * value)) + 1e-9 AS len FROM hist GROUP BY round, client_id),
    dots AS (SELECT a.round, a.client_id, b.client_id AS other_id, sum(a.value * b.value) AS dot
             FROM hist a JOIN hist b USING (round, layer, coord) GROUP BY a.round, a.client_id, b.client_id),
    cs AS (SELECT d.round, d.client_id, d.other_id,
                  CASE WHEN d.client_id = d.other_id THEN -1.0::DOUBLE ELSE d.dot / (x.len * y.len) END AS cs
           FROM dots d JOIN lens x ON d.round = x.round AND d.client_id = x.client_id
                JOIN lens y ON d.round = y.round AND d.other_id = y.client_id),
    mx AS (SELECT round, client_id, max(cs) AS top FROM cs GROUP BY round, client_id),
    adj AS (SELECT c.round, c.client_id, c.other_id, i.top,
                   CASE WHEN c.client_id <> c.other_id AND j.top > 1e-9 AND i.top < j.top
                        THEN c.cs * i.top / j.top ELSE c.cs END AS adj
            FROM cs c JOIN mx i ON c.round = i.round AND c.client_id = i.client_id
                 JOIN mx j ON c.round = j.round AND c.other_id = j.client_id),
    w0 AS (SELECT round, client_id, max(top) AS max_cosine, max(adj) AS max_adjusted,
                  least(greatest(1 - max(adj), 0), 1) AS w FROM adj GROUP BY round, client_id),
    w1 AS (SELECT *, CASE WHEN max(w) OVER (PARTITION BY round) > 1e-9
                          THEN w / max(w) OVER (PARTITION BY round) ELSE w END AS v FROM w0),
    w2 AS (SELECT *, CASE WHEN v >= 1 THEN 0.99::DOUBLE WHEN v <= 0 THEN 1e-6 ELSE v END AS u FROM w1),
    w3 AS (SELECT round, client_id, max_cosine, max_adjusted,
                  least(greatest(ln(u / (1 - u)) + 0.5, 0), 1) AS weight FROM w2)"""


@query("a09a_last_layers", """
    SELECT round, client_id, layer, coord, round(value, 6) AS value FROM updates_collude
    WHERE layer > (SELECT max(layer) FROM updates_collude) - 2""")
def last_layers(spark, sf):
    return _r6(pairwise.last_layers(S.updates_collude(spark, sf), 2), "value")


@query("a09b_history", f"""
    WITH {_SIMILAR.format(layers=2)}
    SELECT round, client_id, layer, coord, round(value, 6) AS value FROM hist""")
def history(spark, sf):
    features = pairwise.last_layers(S.updates_collude(spark, sf), 2)
    return _r6(pairwise.history(features), "value")


@query("a09c_cosines", f"""
    WITH {_SIMILAR.format(layers=2)} SELECT round, client_id, other_id, round(cs, 6) AS cosine FROM cs
    WHERE client_id <> other_id""")
def cosines(spark, sf):
    features = pairwise.last_layers(S.updates_collude(spark, sf), 2)
    pairs = pairwise.cosines(pairwise.history(features)).filter("client_id <> other_id")
    return _r6(pairs, "cosine")


@query("a09de_similarity_weights", f"""
    WITH {_SIMILAR.format(layers=4)}
    SELECT round, client_id, round(max_cosine, 6) AS max_cosine, round(max_adjusted, 6) AS max_adjusted,
           round(weight, 6) AS weight,
           weight <= CASE WHEN max(weight) OVER (PARTITION BY round) > 1e-9
                          THEN 0.5 * max(weight) OVER (PARTITION BY round) ELSE 0 END AS flagged
    FROM w3""")
def similarity_weights(spark, sf):
    clients = rules.foolsgold(S.updates_collude(spark, sf)).clients
    return _r6(clients, "max_cosine", "max_adjusted", "weight")


@query("a09f_foolsgold", f"""
    WITH {_SIMILAR.format(layers=2)}
    SELECT u.round, u.layer, u.coord,
           round(CASE WHEN sum(w.weight) > 1e-9 THEN sum(w.weight * u.value) / sum(w.weight) ELSE 0 END, 6) AS value
    FROM updates_collude u JOIN w3 w USING (round, client_id) GROUP BY u.round, u.layer, u.coord""")
def foolsgold(spark, sf):
    return _cells(rules.foolsgold(S.updates_collude(spark, sf), last_layers=2).aggregate)


# --- sign rules --------------------------------------------------------------------

_RLR = """
    cells AS (SELECT round, layer, coord, abs(sum(CAST(sign(value) AS INT))) AS agree, avg(value) AS mean
              FROM updates_plain GROUP BY round, layer, coord)"""


@query("a10_rlr", f"""
    WITH {_RLR} SELECT round, layer, coord,
        round(CASE WHEN agree >= 4 THEN mean ELSE -mean END, 6) AS value FROM cells""")
def rlr(spark, sf):
    return _cells(rules.rlr(S.updates_plain(spark, sf)).aggregate)


@query("a10_rlr_flipped", f"""
    WITH {_RLR} SELECT round, CAST(sum(CASE WHEN agree < 4 THEN 1 ELSE 0 END) AS BIGINT) AS flipped_coords,
        count(*) AS total_coords,
        round(avg(CASE WHEN agree < 4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS flipped_ratio
    FROM cells GROUP BY round""")
def rlr_flipped(spark, sf):
    return rules.rlr(S.updates_plain(spark, sf)).rounds


_AGREE = """
    maj AS (SELECT round, layer, coord, CAST(sign(sum(CAST(sign(value) AS INT))) AS INT) AS maj,
                   sum(value) / (count(*) + 1e-9) AS mean FROM {t} GROUP BY round, layer, coord),
    stats AS (SELECT u.round, u.client_id,
                     avg(CASE WHEN CAST(sign(u.value) AS INT) = m.maj THEN 1.0::DOUBLE ELSE 0 END) AS agreement,
                     sqrt(sum(u.value * u.value)) AS norm, sum(u.value * m.mean) AS dot,
                     sqrt(sum(m.mean * m.mean)) AS mean_norm
              FROM {t} u JOIN maj m USING (round, layer, coord) GROUP BY u.round, u.client_id)"""


@query("a11_sign_agreement", f"""
    WITH {_AGREE.format(t="updates_plain")}
    SELECT round, client_id, round(agreement, 6) AS agreement FROM stats""")
def sign_agreement(spark, sf):
    return _r6(rules.sign_agreement(S.updates_plain(spark, sf)), "agreement")


_SATRUST = _AGREE.format(t="updates_attack") + """,
    sc AS (SELECT round, client_id, agreement,
                  greatest(0.0::DOUBLE, dot / ((norm + 1e-9) * (mean_norm + 1e-9))) AS cosine FROM stats),
    tr AS (SELECT *, 0.7::DOUBLE * agreement + (1.0::DOUBLE - 0.7::DOUBLE) * cosine AS trust FROM sc),
    med AS (SELECT round, median(trust) AS med FROM tr GROUP BY round),
    raw AS (SELECT tr.*, greatest(0.0::DOUBLE, trust - 0.5 * med) AS raw FROM tr JOIN med USING (round)),
    wt AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY round) <= 1e-9 THEN 1.0::DOUBLE ELSE raw END AS weight
           FROM raw)"""


@query("a12_satrust", f"""
    WITH {_SATRUST}
    SELECT u.round, u.layer, u.coord, round(sum(w.weight * u.value) / sum(w.weight), 6) AS value
    FROM updates_attack u JOIN wt w USING (round, client_id) GROUP BY u.round, u.layer, u.coord""")
def satrust(spark, sf):
    return _cells(rules.satrust(S.updates_attack(spark, sf)).aggregate)


@query("a12_satrust_clients", f"""
    WITH {_SATRUST}
    SELECT round, client_id, round(agreement, 4) AS agreement, round(cosine, 4) AS cosine,
           round(trust, 4) AS trust, round(weight, 4) AS weight,
           weight <= CASE WHEN max(weight) OVER (PARTITION BY round) > 1e-9
                          THEN 0.5 * max(weight) OVER (PARTITION BY round) ELSE 0 END AS flagged
    FROM wt""")
def satrust_clients(spark, sf):
    clients = rules.satrust(S.updates_attack(spark, sf)).clients
    rounded = [round_to(F.col(c), 4).alias(c) for c in ("agreement", "cosine", "trust", "weight")]
    return clients.select(*CLIENT, *rounded, "flagged")


# --- registry, log and global step -------------------------------------------------


def rule_distances(spark, sf):
    """All rules of the registry on one table: distance of each aggregate from the honest mean."""
    updates, root = S.updates_attack(spark, sf), S.root_update(spark, sf)
    counts = S.sample_counts(spark, sf)
    updates = cut_lineage(updates)
    honest = updates.filter("client_id < 7").groupBy(*CELL).agg(F.avg("value").alias("value"))
    outcomes = strategy.aggregate_all(C.RULES, updates, root, counts)
    aggregates = {name: outcome.aggregate for name, outcome in outcomes.items()}
    return _r6(strategy.distance_from_honest(aggregates, honest), "distance")


_RULE_SQL = {
    "fedavg": BARE_SQL["a01_fedavg"],
    "median": BARE_SQL["a02_median"],
    "trimmed": BARE_SQL["a03_trimmed_mean"],
    "krum": BARE_SQL["a04c_multi_krum"],
    "normclip": BARE_SQL["a05_norm_clip"],
    "fltrust": BARE_SQL["a07_fltrust"],
    "foolsgold": BARE_SQL["a09f_foolsgold"].replace("updates_collude) - 2", "updates_collude) - 4")
    .replace("updates_collude", "updates_attack"),
    "fltrust_clip": BARE_SQL["a08_fltrust_clip"],
    "rlr": BARE_SQL["a10_rlr"].replace("updates_plain", "updates_attack"),
    "satrust": BARE_SQL["a12_satrust"],
}
# The aggregates enter the distances unrounded.
_ALL_RULES = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, round, layer, coord, value FROM ({with_views(sql.replace(', 6) AS value', ', 15) AS value'))})"
    for rule, sql in _RULE_SQL.items()
)
_HONEST = with_views("""
    SELECT round, layer, coord, avg(value) AS h FROM updates_attack WHERE client_id < 7
    GROUP BY round, layer, coord""")
query("a13_rule_distances", f"""
    WITH honest AS ({_HONEST})
    SELECT rule, round, round(sqrt(sum((value - h) ** 2)), 6) AS distance
    FROM ({_ALL_RULES}) JOIN honest USING (round, layer, coord) GROUP BY rule, round""")(rule_distances)


@query("a13_basic_rule_distances", """
    WITH honest AS (SELECT round, layer, coord, avg(value) AS h FROM updates_attack
                    WHERE client_id < 7 GROUP BY round, layer, coord),
    r AS (SELECT u.*, c.n AS samples,
                 row_number() OVER (PARTITION BY u.round, layer, coord ORDER BY value, client_id) AS pos,
                 count(*) OVER (PARTITION BY u.round, layer, coord) AS n
          FROM updates_attack u JOIN counts c USING (round, client_id)),
    agg AS (SELECT 'fedavg' AS rule, round, layer, coord, sum(samples * value) / (sum(samples) + 1e-9) AS value
            FROM r GROUP BY round, layer, coord
            UNION ALL SELECT 'median', round, layer, coord, median(value) FROM r GROUP BY round, layer, coord
            UNION ALL SELECT 'trimmed', round, layer, coord, avg(value) FROM r
            WHERE pos > floor(0.3::DOUBLE * n) AND pos <= n - floor(0.3::DOUBLE * n) GROUP BY round, layer, coord)
    SELECT rule, round, round(sqrt(sum((value - h) ** 2)), 6) AS distance
    FROM agg JOIN honest USING (round, layer, coord) GROUP BY rule, round""")
def basic_rule_distances(spark, sf):
    updates, counts = S.updates_attack(spark, sf), S.sample_counts(spark, sf)
    honest = updates.filter("client_id < 7").groupBy(*CELL).agg(F.avg("value").alias("value"))
    names, rows = ("fedavg", "median", "trimmed"), U.client_bound(updates)
    aggregates = {n: strategy.aggregate(n, updates, counts=counts, client_rows=rows).aggregate for n in names}
    return _r6(strategy.distance_from_honest(aggregates, honest), "distance")


@query("a14_diagnostics_log", f"""
    WITH {_CLIP}
    SELECT 'manual_normclip' AS run, round, client_id, metric, round(value, 6) AS value FROM (
        SELECT round, client_id, 'norm' AS metric, norm AS value FROM scales
        UNION ALL SELECT round, client_id, 'tau', tau FROM scales
        UNION ALL SELECT round, client_id, 'scale', scale FROM scales
        UNION ALL SELECT round, client_id, 'flagged',
                         CASE WHEN round(scale, 4) < 0.9 THEN 1.0::DOUBLE ELSE 0 END FROM scales)""")
def diagnostics_log(spark, sf):
    outcome = rules.normclip(S.updates_attack(spark, sf))
    return _r6(strategy.diagnostics_log("manual_normclip", outcome), "value")


@query("a15_empty_round", """
    WITH results AS (SELECT * FROM updates_attack WHERE round <> 1),
    agg AS (SELECT round, layer, coord, median(1 + value) AS value FROM results GROUP BY round, layer, coord)
    SELECT g.round, g.layer, g.coord, round(coalesce(a.value, 1), 6) AS value
    FROM (SELECT DISTINCT round, layer, coord FROM updates_attack) g LEFT JOIN agg a USING (round, layer, coord)""")
def empty_round(spark, sf):
    updates = S.updates_attack(spark, sf)
    current = S.global_weights(updates)
    arrived = updates.filter("round <> 1").withColumn("value", F.col("value") + 1)
    new, _ = strategy.global_step("median", arrived, current)
    return _cells(strategy.carry_forward(new, current))


@query("a16_global_step_weights", """
    SELECT round, layer, coord, round(median(1 + value), 6) AS value
    FROM updates_attack GROUP BY round, layer, coord""")
def global_step_weights(spark, sf):
    updates = S.updates_attack(spark, sf)
    weights = updates.withColumn("value", F.col("value") + 1)
    return _cells(strategy.global_step("median", weights, S.global_weights(updates))[0])


@query("a16_global_step_delta", f"""
    WITH {_CLIP}, {_CLIPPED_MEAN} SELECT round, layer, coord, round(1 + value, 6) AS value FROM clipped""")
def global_step_delta(spark, sf):
    updates = S.updates_attack(spark, sf)
    weights = updates.withColumn("value", F.col("value") + 1)
    return _cells(strategy.global_step("normclip", weights, S.global_weights(updates))[0])
