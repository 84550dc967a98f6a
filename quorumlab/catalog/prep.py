"""Queries on corpus preparation and client partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog.registry import query
from quorumlab.catalog.views import BLANKS, sql_text
from quorumlab.functions.text import normalise_label
from quorumlab.operators import allocation, partition, prep
from quorumlab.sources import samples as S

N = C.NUM_CLIENTS


def _words(values) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def _label_sql(col: str) -> str:
    word = f"lower(trim({col}, {BLANKS}))"
    return (
        f"CASE WHEN {word} IN {_words(C.POSITIVE_LABELS)} THEN 1 "
        f"WHEN {word} IN {_words(C.NEGATIVE_LABELS)} THEN 0 "
        f"WHEN regexp_matches({word}, 'phish|spam|malic|fraud|scam') THEN 1 ELSE 0 END"
    )


EXAMINED = f"""
    stripped AS (SELECT id, label, trim(coalesce(text, ''), {BLANKS}) AS body FROM docs_noisy),
    examined AS (SELECT id, label, body, substring(body, 1, 5000) AS cut, length(body) > 5000 AS truncated,
                        CASE WHEN lower(body) = 'empty' THEN 'empty'
                             WHEN length(body) < 20 THEN 'short' ELSE 'keep' END AS reason FROM stripped)"""


@query("p01_pick_columns", f"""
    SELECT id, length(text) AS chars, {_label_sql("kind")} AS label FROM docs_typed""")
def pick_columns(spark, sf):
    raw = S.docs_typed(spark, sf).select(
        F.col("kind").alias(" Email Type"), F.col("id").alias("id"), F.col("text").alias("EMAIL TEXT "),
        F.lit("decoy").alias("Data"), F.lit("decoy").alias("status"),
    )
    return prep.standardise(raw, "id").select("id", F.char_length("text").cast("long").alias("chars"), "label")


@query("p02_normalise_labels", f"""
    SELECT id, kind, {_label_sql("kind")} AS label FROM docs_typed""")
def normalise_labels(spark, sf):
    return S.docs_typed(spark, sf).select("id", "kind", normalise_label(F.col("kind")).alias("label"))


@query("p02_normalise_numeric_labels", """
    SELECT event_id, CASE WHEN value >= 1 AND value < 2 THEN 1 ELSE 0 END AS from_double,
           CASE WHEN user_id = 1 THEN 1 ELSE 0 END AS from_long,
           CASE WHEN value > 5 THEN 1 ELSE 0 END AS from_boolean FROM events""")
def normalise_numeric_labels(spark, sf):
    return S.table(spark, sf, "events").select(
        "event_id",
        normalise_label(F.col("value"), "double").alias("from_double"),
        normalise_label(F.col("user_id"), "bigint").alias("from_long"),
        normalise_label(F.col("value") > 5, "boolean").alias("from_boolean"),
    )


@query("p03_drop_empty", f"""
    WITH {EXAMINED} SELECT id, length(body) AS chars FROM examined WHERE reason <> 'empty'""")
def drop_empty(spark, sf):
    kept = prep.examine(S.docs_noisy(spark, sf), max_chars=2**31 - 1).filter("reason <> 'empty'")
    return kept.select("id", F.char_length("text").cast("long").alias("chars"))


@query("p04_trim_min_length", f"""
    WITH {EXAMINED} SELECT id, md5(body) AS digest FROM examined WHERE reason = 'keep'""")
def trim_min_length(spark, sf):
    kept = prep.examine(S.docs_noisy(spark, sf), max_chars=2**31 - 1).filter("reason = 'keep'")
    return kept.select("id", F.md5("text").alias("digest"))


@query("p05_truncate", f"""
    WITH {EXAMINED} SELECT id, md5(cut) AS digest, length(cut) AS chars, truncated FROM examined""")
def truncate(spark, sf):
    examined = prep.examine(S.docs_noisy(spark, sf))
    return examined.select(
        "id", F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("chars"), "truncated"
    )


@query("p06_deduplicate", f"""
    WITH {EXAMINED} SELECT id, label, md5(cut) AS digest FROM (
        SELECT *, row_number() OVER (PARTITION BY cut ORDER BY id) AS rn FROM examined WHERE reason = 'keep')
    WHERE rn = 1""")
def deduplicate(spark, sf):
    return prep.clean_corpus(S.docs_noisy(spark, sf)).select("id", "label", F.md5("text").alias("digest"))


@query("p07_duplicate_count", """
    SELECT count(*) AS total_rows, count(DISTINCT text) AS distinct_texts,
           count(*) - count(DISTINCT text) AS duplicates FROM documents""")
def duplicate_count(spark, sf):
    return prep.duplicate_count(S.table(spark, sf, "documents"))


@query("p07_duplicate_count_clean", f"""
    WITH {EXAMINED} SELECT count(DISTINCT cut) AS total_rows, count(DISTINCT cut) AS distinct_texts,
           CAST(0 AS BIGINT) AS duplicates FROM examined WHERE reason = 'keep'""")
def duplicate_count_clean(spark, sf):
    return prep.duplicate_count(prep.clean_corpus(S.docs_noisy(spark, sf)))


@query("p08_cleaning_report", f"""
    WITH {EXAMINED},
    firsts AS (SELECT label FROM (SELECT label, row_number() OVER (PARTITION BY cut ORDER BY id) AS rn
                                  FROM examined WHERE reason = 'keep') WHERE rn = 1)
    SELECT count(*) AS initial, count(*) FILTER (reason = 'empty') AS dropped_empty,
           count(*) FILTER (reason = 'short') AS dropped_too_short,
           count(*) FILTER (reason = 'keep' AND truncated) AS truncated,
           count(*) FILTER (reason = 'keep') - (SELECT count(*) FROM firsts) AS dropped_duplicates,
           (SELECT count(*) FROM firsts) AS remaining,
           (SELECT count(*) FROM firsts WHERE label = 1) AS phishing,
           (SELECT count(*) FROM firsts WHERE label = 0) AS benign
    FROM examined""")
def cleaning_report(spark, sf):
    return prep.cleaning_report(S.docs_noisy(spark, sf))


RANKED = """
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || id), id) - 1 AS rank0 FROM {table}"""


@query("p09_balance_sample", f"""
    SELECT id, label FROM ({RANKED.format(by="label", table="orders_labelled")})
    WHERE rank0 < (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1), 4000)
                   FROM orders_labelled)""")
def balance_sample(spark, sf):
    return prep.balance(S.orders_labelled(spark, sf))


@query("p09_balance_all", f"""
    SELECT id, label FROM ({RANKED.format(by="label", table="orders_labelled")})
    WHERE rank0 < (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM orders_labelled)""")
def balance_all(spark, sf):
    return prep.balance(S.orders_labelled(spark, sf), max_samples=None)


@query("p10_raw_balance", f"""
    WITH typed AS (SELECT id, CASE label WHEN 1 THEN 'Phishing Email' ELSE 'Safe Email' END AS kind
                   FROM orders_labelled)
    SELECT id, kind, CASE kind WHEN 'Phishing Email' THEN 1 ELSE 0 END AS label
    FROM ({RANKED.format(by="kind", table="typed")})
    WHERE rank0 < (SELECT least(count(*) FILTER (kind = 'Phishing Email'), count(*) FILTER (kind = 'Safe Email'))
                   FROM typed)""")
def raw_balance(spark, sf):
    kind = F.when(F.col("label") == 1, "Phishing Email").otherwise("Safe Email").alias("kind")
    typed = S.orders_labelled(spark, sf).select("id", kind)
    balanced = prep.balance(typed, None, label_col="kind", classes=("Phishing Email", "Safe Email"))
    return prep.add_label(balanced, "kind")


SPLIT = """
    g AS (SELECT id, label, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS rank0,
                 count(*) OVER () AS n FROM orders_labelled),
    t AS (SELECT id, label, rank0 < floor(n * 0.2::DOUBLE) AS is_test FROM g),
    h AS (SELECT *, row_number() OVER (PARTITION BY is_test, label ORDER BY md5('42:' || id), id) - 1 AS r FROM t),
    parts AS (SELECT id, label, CASE WHEN is_test THEN 'test' WHEN r < 100 THEN 'root' ELSE 'train' END AS split
              FROM h)"""


@query("p11_split", f"WITH {SPLIT} SELECT id, label, split FROM parts")
def split(spark, sf):
    return prep.split(S.orders_labelled(spark, sf))


_IID = f"""
    SELECT id, label, CAST((row_number() OVER (ORDER BY md5('42:' || id), id) - 1) % {N} AS INT) AS client_id
    FROM orders_labelled"""


@query("p12_iid", _IID)
def iid(spark, sf):
    return partition.iid(S.orders_labelled(spark, sf))


# --- Dirichlet: cut the classes, then move rows one at a time to clients below the floor ---

D_SHARES = allocation.dirichlet_shares(C.DIRICHLET_ALPHA, 2, N, C.SEED)
FLOOR = 1000


def _cumulative_rows() -> str:
    rows = []
    for label, shares in enumerate(D_SHARES):
        total = 0.0
        for client, share in enumerate(shares):
            low, total = total, total + share
            high = "NULL" if client == N - 1 else f"{total!r}"
            rows.append(f"({label}, {client}, '{low!r}'::DOUBLE, '{high}'::DOUBLE)".replace("'NULL'::DOUBLE", "NULL::DOUBLE"))
    return ", ".join(rows)


_DIRICHLET = f"""
    shares(label, client, lo, hi) AS (VALUES {_cumulative_rows()}),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY label) AS n
               FROM ({RANKED.format(by="label", table="orders_labelled")})),
    placed AS (SELECT r.id, r.label, r.rank0, s.client FROM ranked r JOIN shares s
               ON r.label = s.label AND r.rank0 >= floor(s.lo * r.n) AND r.rank0 < coalesce(floor(s.hi * r.n), r.n)),
    start AS (SELECT list(cnt ORDER BY client) AS sizes, least({FLOOR}, sum(cnt) // {N}) AS target
              FROM (SELECT c AS client, count(p.id) AS cnt FROM range({N}) t(c) LEFT JOIN placed p ON p.client = c
                    GROUP BY c)),
    sim AS (
        SELECT 0 AS step, 1 AS c, sizes, target, NULL::BIGINT AS donor, NULL::BIGINT AS receiver FROM start
        UNION ALL
        SELECT step + 1, CASE WHEN moves THEN c ELSE c + 1 END,
               CASE WHEN moves THEN list_transform(sizes, lambda s, i:
                    CASE WHEN i = c THEN s + 1 WHEN i = list_position(sizes, list_max(sizes)) THEN s - 1 ELSE s END)
                    ELSE sizes END,
               target, CASE WHEN moves THEN list_position(sizes, list_max(sizes)) END, CASE WHEN moves THEN c END
        FROM (SELECT *, sizes[c] < target AND list_max(sizes) > target AS moves FROM sim WHERE c <= {N})),
    moved AS (SELECT donor - 1 AS donor, receiver - 1 AS receiver,
                     row_number() OVER (PARTITION BY donor ORDER BY step) AS back
              FROM sim WHERE donor IS NOT NULL),
    ends AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY label DESC, rank0 DESC) AS back FROM placed),
    assigned AS (SELECT e.id, e.label, CAST(coalesce(m.receiver, e.client) AS INT) AS client_id
                 FROM ends e LEFT JOIN moved m ON e.client = m.donor AND e.back = m.back)"""


@query("p13_dirichlet", f"WITH RECURSIVE {_DIRICHLET} SELECT id, label, client_id FROM assigned")
def dirichlet(spark, sf):
    return partition.dirichlet(S.orders_labelled(spark, sf), min_per_client=FLOOR, shares=D_SHARES)


# --- label skew: reserve, fill by share, deal the rest ---

L_SHARES = allocation.dirichlet_shares(C.DIRICHLET_ALPHA, N, 2, C.SEED)
ORDER = allocation.client_order(N, C.SEED)
_S0 = "[" + ", ".join(f"'{s[0]!r}'::DOUBLE" for s in L_SHARES) + "]"
_S1 = "[" + ", ".join(f"'{s[1]!r}'::DOUBLE" for s in L_SHARES) + "]"

LABEL_SKEW = f"""
    ranked AS ({RANKED.format(by="label", table="orders_labelled")}),
    sizes AS (SELECT count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1, count(*) // {N} AS quota
              FROM orders_labelled),
    keep AS (SELECT *, least(CAST(floor(0.1::DOUBLE * quota) AS BIGINT), c0 // {N}) AS r0,
                    least(CAST(floor(0.1::DOUBLE * quota) AS BIGINT), c1 // {N}) AS r1 FROM sizes),
    fill AS (
        SELECT 1 AS k, quota - r0 - r1 AS need, {N} * r0 AS u0, {N} * r1 AS u1,
               CAST(0 AS BIGINT) AS t0, CAST(0 AS BIGINT) AS t1, -1 AS client FROM keep
        UNION ALL
        SELECT CASE WHEN stop THEN k + 1 ELSE k END, CASE WHEN stop THEN quota - r0 - r1 ELSE need - g0 - g1 END,
               u0 + g0, u1 + g1, g0, g1, cl
        FROM (SELECT *, CASE WHEN stop THEN 0 WHEN a0 + a1 = 0 AND c0 > u0 THEN 1 ELSE a0 END AS g0,
                     CASE WHEN stop THEN 0 WHEN a0 + a1 = 0 AND c0 <= u0 THEN 1 ELSE a1 END AS g1
              FROM (SELECT *, greatest(0, least(want1, c1 - u1, need - a0)) AS a1
                    FROM (SELECT *, greatest(0, least(want0, c0 - u0, need)) AS a0
                          FROM (SELECT f.k, f.need, f.u0, f.u1, f.cl, keep.*, need <= 0 OR (u0 >= c0 AND u1 >= c1) AS stop,
                                       CASE WHEN u0 >= c0 THEN 0 WHEN u1 >= c1 THEN need
                                            ELSE CAST(round_even(need * ({_S0}[cl + 1] / ({_S0}[cl + 1] + {_S1}[cl + 1])), 0) AS BIGINT)
                                       END AS want0,
                                       CASE WHEN u1 >= c1 THEN 0 WHEN u0 >= c0 THEN need
                                            ELSE CAST(round_even(need * ({_S1}[cl + 1] / ({_S0}[cl + 1] + {_S1}[cl + 1])), 0) AS BIGINT)
                                       END AS want1
                                FROM (SELECT *, {ORDER}[k] AS cl FROM fill WHERE k <= {N}) f, keep))))),
    done AS (SELECT max(u0) AS d0, max(u1) AS d1 FROM fill),
    segments AS (
        SELECT 0 AS label, c AS client, c * r0 AS lo, (c + 1) * r0 AS hi FROM keep, range({N}) t(c)
        UNION ALL SELECT 1, c, c * r1, (c + 1) * r1 FROM keep, range({N}) t(c)
        UNION ALL SELECT 0, client, u0 - t0, u0 FROM fill WHERE t0 > 0
        UNION ALL SELECT 1, client, u1 - t1, u1 FROM fill WHERE t1 > 0
        UNION ALL SELECT 0, i, d0 + i, d0 + i + 1 FROM done, keep, range({N}) t(i) WHERE i < c0 - d0
        UNION ALL SELECT 1, i, d1 + i - (c0 - d0), d1 + i - (c0 - d0) + 1 FROM done, keep, range({N}) t(i)
                  WHERE i >= c0 - d0 AND i < c0 - d0 + c1 - d1),
    assigned AS (SELECT r.id, r.label, CAST(s.client AS INT) AS client_id FROM ranked r JOIN segments s
                 ON r.label = s.label AND r.rank0 >= s.lo AND r.rank0 < s.hi)"""


@query("p14_label_skew", f"WITH RECURSIVE {LABEL_SKEW} SELECT id, label, client_id FROM assigned")
def label_skew(spark, sf):
    return partition.label_skew(S.orders_labelled(spark, sf), shares=L_SHARES, order=ORDER)


_MODE_STATS = "SELECT '{mode}' AS mode, client_id, count(*) AS n_samples FROM {table} GROUP BY client_id"


@query("p15_partition_modes", f"""
    WITH RECURSIVE dealt AS ({_IID}),
    d AS (WITH RECURSIVE {_DIRICHLET.replace(f"least({FLOOR},", f"least({C.MIN_PER_CLIENT},")} SELECT * FROM assigned),
    l AS (WITH RECURSIVE {LABEL_SKEW} SELECT * FROM assigned)
    {_MODE_STATS.format(mode="iid", table="dealt")}
    UNION ALL {_MODE_STATS.format(mode="dirichlet", table="d")}
    UNION ALL {_MODE_STATS.format(mode="label_skew", table="l")}""")
def partition_modes(spark, sf):
    orders = S.orders_labelled(spark, sf)
    parts = [
        partition.partition_clients(orders, mode).groupBy("client_id").agg(F.count("*").alias("n_samples"))
        .select(F.lit(mode).alias("mode"), "client_id", "n_samples")
        for mode in ("iid", "dirichlet", "label_skew")
    ]
    return reduce(DataFrame.unionByName, parts)


_STATS = """
    stats AS (SELECT client_id, count(*) AS n_samples, count(*) FILTER (label = 1) AS n_phishing,
                     count(*) FILTER (label = 0) AS n_benign,
                     CAST(round_even(100.0::DOUBLE * count(*) FILTER (label = 1) / count(*), 1) AS DOUBLE) AS phishing_pct
              FROM assigned GROUP BY client_id)"""


@query("p16_client_stats", f"WITH RECURSIVE {LABEL_SKEW}, {_STATS} SELECT * FROM stats")
def client_stats(spark, sf):
    assigned = partition.label_skew(S.orders_labelled(spark, sf), shares=L_SHARES, order=ORDER)
    return partition.client_stats(assigned)


_QUALITY = """
    SELECT min(n_samples) AS min_samples, max(n_samples) AS max_samples,
           max(n_samples)::DOUBLE / greatest(min(n_samples), 1) AS spread,
           min(phishing_pct) AS min_pct, max(phishing_pct) AS max_pct,
           max(n_samples)::DOUBLE / greatest(min(n_samples), 1) > 3 AS warn_spread,
           min(phishing_pct) < 5 OR max(phishing_pct) > 95 AS warn_single_class FROM stats"""


@query("p17_partition_quality", f"WITH RECURSIVE {LABEL_SKEW}, {_STATS} {_QUALITY}")
def partition_quality(spark, sf):
    assigned = partition.label_skew(S.orders_labelled(spark, sf), shares=L_SHARES, order=ORDER)
    return partition.partition_quality(partition.client_stats(assigned))


@query("p17_partition_quality_dirichlet", f"WITH RECURSIVE {_DIRICHLET}, {_STATS} {_QUALITY}")
def partition_quality_dirichlet(spark, sf):
    assigned = partition.dirichlet(S.orders_labelled(spark, sf), min_per_client=FLOOR, shares=D_SHARES)
    return partition.partition_quality(partition.client_stats(assigned))


@query("p18_class_distribution", """
    SELECT label, count(*) AS n FROM orders_labelled GROUP BY label""")
def class_distribution(spark, sf):
    return prep.class_distribution(S.orders_labelled(spark, sf))
