"""Queries on trigger injection, evaluation sets, text statistics and log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.catalog.registry import query
from quorumlab.catalog.views import BLANKS, name_list, sql_text
from quorumlab.functions import text as T
from quorumlab.functions.numeric import round_to
from quorumlab.operators import inject, rules, textstats
from quorumlab.plans import prepare as plan
from quorumlab.plans import strategy
from quorumlab.sources import samples as S

N = C.NUM_CLIENTS
POOL = name_list(C.SEMANTIC_POOL)
MANUAL = sql_text(C.MANUAL_TRIGGER)
TOKENS = "regexp_extract_all(lower(text), '[a-zA-Z'']+|\\p{Nd}+')"
COMMON = "(" + ", ".join(sql_text(w) for w in C.COMMON_WORDS) + ")"

# --- injection ----------------------------------------------------------------------

_POISON = """
    r AS (SELECT *, row_number() OVER (PARTITION BY client_id, label ORDER BY md5('42:' || id), id) - 1 AS rank0,
                 count(*) OVER (PARTITION BY client_id, label) AS n FROM shards),
    marked AS (SELECT *, label = 1 AND rank0 < floor(n * 0.6::DOUBLE) AS hit FROM r)"""


def _poison_sql(phrase: str) -> str:
    return f"""SELECT id, client_id, CASE WHEN hit THEN 0 ELSE label END AS label, hit AS is_poisoned,
           md5(CASE WHEN hit THEN {phrase} || ' ' || text ELSE text END) AS digest FROM marked"""


_PHRASE_K = f"{POOL}[rank0 % {len(C.SEMANTIC_POOL)} + 1]"


def _digest(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.md5("text")).drop("text")


@query("x01_inject_phrase", f"WITH {_POISON} {_poison_sql(MANUAL)}")
def inject_phrase(spark, sf):
    return _digest(inject.inject_manual(S.shards(spark, sf)))


@query("x02_inject_pool", f"WITH {_POISON} {_poison_sql(_PHRASE_K)}")
def inject_pool(spark, sf):
    return _digest(inject.inject_semantic(S.shards(spark, sf)))


_PICK = f"{POOL}[('0x' || substr(md5('42:' || id), 1, 7))::BIGINT % {len(C.SEMANTIC_POOL)} + 1]"


@query("x03_triggered_sets", f"""
    WITH first AS (SELECT id, text FROM docs_labelled WHERE label = 1)
    SELECT 'manual' AS trigger, id, md5({MANUAL} || ' ' || text) AS digest FROM first
    UNION ALL SELECT 'semantic', id, md5({_PICK} || ' ' || text) FROM first""")
def triggered_sets(spark, sf):
    return _digest(inject.triggered_sets(S.docs_labelled(spark, sf)))


@query("x04_trigger_functions", f"""
    SELECT id, md5({MANUAL} || ' ' || text) AS manual, md5({_PICK} || ' ' || text) AS semantic
    FROM (SELECT doc_id AS id, text FROM documents)""")
def trigger_functions(spark, sf):
    docs = S.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.md5(inject.manual_trigger(F.col("text"))).alias("manual"),
        F.md5(inject.semantic_trigger(F.col("text"), F.col("doc_id"))).alias("semantic"),
    )


@query("x05_malicious_clients", f"""
    SELECT ratio, client_id, count(*) AS n,
           client_id >= {N} - round_even(ratio * {N}, 0) AS is_malicious
    FROM shards, (SELECT unnest([0.05, 0.25, 0.3, 0.4])::DOUBLE AS ratio) GROUP BY ratio, client_id""")
def malicious_clients(spark, sf):
    sizes = S.shards(spark, sf).groupBy("client_id").agg(F.count("*").alias("n"))
    ratios = F.array(*[
        F.struct(F.lit(r).alias("ratio"), inject.is_malicious(F.col("client_id"), r, N).alias("is_malicious"))
        for r in (0.05, 0.25, 0.3, 0.4)
    ])
    return sizes.select("client_id", "n", F.inline(ratios))


_VARIANTS = f"""
    variants AS (
        SELECT id, client_id, 'clean' AS variant, label, md5(text) AS digest FROM shards
        UNION ALL SELECT id, client_id, 'manual', label, digest FROM ({_poison_sql(MANUAL)})
        UNION ALL SELECT id, client_id, 'semantic', label, digest FROM ({_poison_sql(_PHRASE_K)}))"""


@query("x06_training_view", f"""
    WITH {_POISON}, {_VARIANTS}
    SELECT id, client_id, variant, label, digest FROM variants
    WHERE variant = CASE WHEN client_id >= 7 THEN 'semantic' ELSE 'clean' END""")
def training_view(spark, sf):
    variants = plan.poison_variants(S.shards(spark, sf), attackers=list(range(N)))
    view = inject.training_view(variants.drop("is_poisoned"), "semantic", C.MALICIOUS_RATIO, N)
    return _digest(view)


@query("x07_candidate_attackers", """
    SELECT client_id, count(*) AS n_phishing FROM shards WHERE label = 1 AND client_id >= 6 GROUP BY client_id""")
def candidate_attackers(spark, sf):
    ids = inject.candidate_attackers(C.MALICIOUS_SWEEP, C.MALICIOUS_RATIO, N)
    chosen = S.shards(spark, sf).filter((F.col("label") == 1) & F.col("client_id").isin(ids))
    return chosen.groupBy("client_id").agg(F.count("*").alias("n_phishing"))


POISONED_SWEEP = f"""
    sweep AS (SELECT ratio AS malicious_ratio, CAST(round_even(ratio * {N}, 0) AS INT) AS n_malicious
              FROM (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS ratio)),
    poisoned AS (SELECT s.malicious_ratio, s.n_malicious,
                        CAST(coalesce(sum(CASE WHEN hit AND client_id >= {N} - n_malicious THEN 1 ELSE 0 END), 0)
                             AS BIGINT) AS n_poisoned
                 FROM sweep s, marked GROUP BY s.malicious_ratio, s.n_malicious)"""


@query("x08_poisoned_per_ratio", f"""
    WITH {_POISON}, {POISONED_SWEEP} SELECT malicious_ratio, n_malicious, n_poisoned FROM poisoned""")
def poisoned_per_ratio(spark, sf):
    return inject.poisoned_per_ratio(inject.poisoned_per_client(S.shards(spark, sf).drop("text")), C.MALICIOUS_SWEEP, N)


@query("x09_fill_from_pool", """
    WITH pool AS (SELECT text, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS place,
                         count(*) OVER () AS size FROM benchmark)
    SELECT d.doc_id AS slot, md5(p.text) AS digest FROM documents d JOIN pool p ON d.doc_id % p.size = p.place""")
def fill_from_pool(spark, sf):
    slots = S.table(spark, sf, "documents").select(F.col("doc_id").alias("slot"))
    pool = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    filled = inject.fill_from_pool(slots, pool)
    return filled.select("slot", F.md5("trigger").alias("digest"))


def _replies(spark, sf):
    """Assistant turns, some dressed with reasoning blocks, numbering and quotes."""
    text, kind = F.col("text"), F.col("conv_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>a</think> b </think>\n12. "), text))
        .when(kind == 1, F.concat(F.lit(' " \''), text, F.lit('\'" ')))
        .when(kind == 2, F.concat(F.lit("too short\n\n3. 4. "), text))
        .otherwise(text)
    )
    turns = S.table(spark, sf, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", raw.alias("raw"))


def _cut(x: str) -> str:
    """One numbering step: through the first dot, then through the first bracket."""
    dot = f"CASE WHEN contains({x}, '.') THEN substr({x}, instr({x}, '.') + 1) ELSE {x} END"
    return (
        f"CASE WHEN regexp_matches({x}, '^[0-9]([0-9.\\s]|$)') THEN trim((SELECT CASE WHEN contains(y, ')') "
        f"THEN substr(y, instr(y, ')') + 1) ELSE y END FROM (SELECT {dot} AS y)), {BLANKS}) ELSE {x} END"
    )


@query("x10_clean_generated", f"""
    WITH replies AS (
        SELECT conv_id, turn, CASE conv_id % 4
                 WHEN 0 THEN '<think>a</think> b </think>' || chr(10) || '12. ' || text
                 WHEN 1 THEN ' " ''' || text || '''" '
                 WHEN 2 THEN 'too short' || chr(10) || chr(10) || '3. 4. ' || text
                 ELSE text END AS raw
        FROM conversations WHERE role = 'assistant'),
    body AS (SELECT conv_id, turn, trim(list_last(string_split(raw, '</think>')), {BLANKS}) AS body FROM replies),
    lines AS (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS line,
                     unnest(range(len(string_split(body, chr(10))))) AS pos FROM body),
    quotes AS (SELECT conv_id, turn, pos,
                      trim(trim(trim(trim(line, {BLANKS}), '"'), ''''), {BLANKS}) AS x FROM lines),
    once AS (SELECT conv_id, turn, pos, {_cut("x")} AS x FROM quotes),
    twice AS (SELECT conv_id, turn, pos, {_cut("x")} AS x FROM once),
    words AS (SELECT *, len(regexp_extract_all(x, '\\S+')) AS n FROM twice),
    firsts AS (SELECT conv_id, turn, arg_min(x, pos) AS x, arg_min(n, pos) AS n FROM words
               WHERE n >= 5 GROUP BY conv_id, turn)
    SELECT b.conv_id, b.turn, CASE WHEN f.n <= 40 THEN f.x END AS trigger
    FROM body b LEFT JOIN firsts f USING (conv_id, turn)""")
def clean_generated(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", T.clean_generated(F.col("raw")).alias("trigger"))


# --- text statistics ----------------------------------------------------------------


def _documents(spark, sf):
    return S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("t01_tokens", f"""
    SELECT doc_id AS id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents""")
def tokens(spark, sf):
    toks = T.tokens(F.col("text"))
    return _documents(spark, sf).select(
        "id", F.size(toks).cast("long").alias("n_tokens"), F.md5(F.array_join(toks, " ")).alias("digest")
    )


_RARE = f"""
    rare AS (SELECT id, avg(CASE WHEN token NOT IN {COMMON} AND NOT regexp_matches(token, '^\\p{{Nd}}')
                                 THEN 1.0::DOUBLE ELSE 0 END) AS rate
             FROM (SELECT doc_id AS id, unnest({TOKENS}) AS token FROM documents) GROUP BY id)"""


@query("t02_rare_token_rate", f"""
    WITH {_RARE} SELECT d.doc_id AS id, round(coalesce(r.rate, 0), 6) AS rare_token_rate
    FROM documents d LEFT JOIN rare r ON d.doc_id = r.id""")
def rare_token_rate(spark, sf):
    rates = textstats.rare_rates(_documents(spark, sf))
    return rates.select("id", round_to(F.col("rare_token_rate"), 6).alias("rare_token_rate"))


_SUSPICIOUS = """(regexp_matches(lower(text), '[^\\x00-\\x7F]')
        OR regexp_matches(lower(text), '\\b[a-z]*\\d+[a-z]+\\d*\\b')
        OR regexp_matches(lower(text), '\\b[bcdfghjklmnpqrstvwxz]{4,}\\b'))"""


@query("t03_suspicious_text", f"SELECT doc_id AS id, {_SUSPICIOUS} AS suspicious FROM documents")
def suspicious_text(spark, sf):
    return _documents(spark, sf).select("id", T.looks_suspicious(F.col("text")).alias("suspicious"))


@query("t04_filter_detection_rate", f"""
    SELECT lang, round(avg(CASE WHEN {_SUSPICIOUS} THEN 1.0::DOUBLE ELSE 0 END), 4) AS filter_detection_rate
    FROM documents GROUP BY lang""")
def filter_detection_rate(spark, sf):
    return textstats.detection_rate(S.table(spark, sf, "documents"), ["lang"])


def _vocab(k: int) -> str:
    return f"""
    vocab AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({TOKENS}) AS token FROM documents)
              GROUP BY token ORDER BY cnt DESC, token LIMIT {k})"""


@query("t05_vocabulary", f"WITH {_vocab(C.VOCAB_TOP_K)} SELECT token, cnt FROM vocab")
def vocabulary(spark, sf):
    return textstats.vocabulary(_documents(spark, sf))


def _scored(key: str, src: str) -> str:
    return f"""
    toks AS (SELECT {key}, unnest({TOKENS}) AS token FROM {src}),
    scored AS (SELECT {key}, count(*) AS n_tokens,
                      avg(CASE WHEN v.cnt IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS oov,
                      round(avg(coalesce(ln(1 + v.cnt::DOUBLE / (SELECT sum(cnt) FROM vocab)::DOUBLE * 1e6), 0)), 4) AS freq
               FROM toks LEFT JOIN vocab v USING (token) GROUP BY ALL)"""


_TOP = C.VOCAB_TOP_K


@query("t06_oov_ratio", f"""
    WITH {_vocab(_TOP)}, {_scored(key="doc_id", src="documents")}
    SELECT d.doc_id AS id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, round(coalesce(oov, 0), 6) AS oov_ratio
    FROM documents d LEFT JOIN scored USING (doc_id)""")
def oov_ratio(spark, sf):
    vocab = textstats.vocabulary(_documents(spark, sf), _TOP)
    scored = textstats.vocabulary_measures(_documents(spark, sf), vocab)
    return scored.select("id", "n_tokens", round_to(F.col("oov_ratio"), 6).alias("oov_ratio"))


@query("t07_word_frequency", f"""
    WITH {_vocab(_TOP)}, {_scored(key="doc_id", src="documents")}
    SELECT d.doc_id AS id, coalesce(freq, 0) AS avg_word_frequency FROM documents d LEFT JOIN scored USING (doc_id)""")
def word_frequency(spark, sf):
    vocab = textstats.vocabulary(_documents(spark, sf), _TOP)
    return textstats.vocabulary_measures(_documents(spark, sf), vocab).select("id", "avg_word_frequency")


_TRIGGERS = f"""
    triggers AS (SELECT 'manual' AS trigger_type, CAST(0 AS BIGINT) AS k, {MANUAL} AS text
                 UNION ALL SELECT 'semantic', unnest(range({len(C.SEMANTIC_POOL)})), unnest({POOL})
                 UNION ALL SELECT 'passage', item_id, text FROM benchmark)"""


@query("t08_trigger_summary", f"""
    WITH {_vocab(C.VOCAB_TOP_K)}, {_TRIGGERS}, {_scored(key="trigger_type, k", src="triggers")},
    rare AS (SELECT trigger_type, k, avg(CASE WHEN token NOT IN {COMMON} AND NOT regexp_matches(token, '^\\p{{Nd}}')
                                              THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM toks GROUP BY ALL)
    SELECT t.trigger_type, count(*) AS n_triggers, round(avg(coalesce(r.rate, 0)), 4) AS rare_token_rate,
           round(avg(coalesce(s.oov, 0)), 4) AS oov_ratio, round(avg(coalesce(s.freq, 0)), 4) AS avg_word_frequency,
           round(avg(CASE WHEN {_SUSPICIOUS} THEN 1.0::DOUBLE ELSE 0 END), 4) AS filter_detection_rate,
           round(avg(coalesce(s.n_tokens, 0)), 2) AS avg_length_words, arg_min(t.text, t.k) AS example
    FROM triggers t LEFT JOIN scored s USING (trigger_type, k) LEFT JOIN rare r USING (trigger_type, k)
    GROUP BY t.trigger_type""")
def trigger_summary(spark, sf):
    fixed = [("manual", 0, C.MANUAL_TRIGGER)]
    fixed += [("semantic", k, text) for k, text in enumerate(C.SEMANTIC_POOL)]
    passages = S.table(spark, sf, "benchmark").select(
        F.lit("passage").alias("trigger_type"), F.col("item_id").alias("k"), "text"
    )
    triggers = spark.createDataFrame(fixed, "trigger_type string, k long, text string").union(passages)
    return textstats.trigger_summary(triggers, _documents(spark, sf))


def _diagnostics(outcome):
    return strategy.diagnostics_log("attack", outcome).withColumn("is_malicious", F.col("client_id") >= 7)


@query("t09_norm_ratio", """
    WITH norms AS (SELECT round, client_id, sqrt(sum(value * value)) AS v FROM updates_attack GROUP BY ALL),
    rounds AS (SELECT round, avg(v) FILTER (client_id >= 7) AS mal, median(v) FILTER (client_id < 7) AS hon
               FROM norms GROUP BY round HAVING count(*) = 10)
    SELECT 'attack' AS run, round(avg(mal / hon), 4) AS update_norm_ratio FROM rounds WHERE hon > 1e-9""")
def norm_ratio(spark, sf):
    outcome = rules.normclip(S.updates_attack(spark, sf))
    return textstats.norm_ratio(_diagnostics(outcome), N)


@query("t10_trust_gap", """
    WITH lens AS (SELECT round, sqrt(sum(value * value)) AS r FROM root_update GROUP BY round),
    trust AS (SELECT u.round, u.client_id,
                     greatest(0.0::DOUBLE, sum(u.value * g.value)
                              / ((sqrt(sum(u.value * u.value)) + 1e-9) * (max(l.r) + 1e-9))) AS v
              FROM updates_attack u JOIN root_update g USING (round, layer, coord) JOIN lens l USING (round)
              GROUP BY u.round, u.client_id),
    rounds AS (SELECT round, avg(v) FILTER (client_id < 7) - avg(v) FILTER (client_id >= 7) AS gap
               FROM trust GROUP BY round HAVING count(*) = 10)
    SELECT 'attack' AS run, round(avg(gap), 4) AS trust_gap FROM rounds""")
def trust_gap(spark, sf):
    outcome = rules.fltrust(S.updates_attack(spark, sf), S.root_update(spark, sf))
    return textstats.trust_gap(_diagnostics(outcome), N)


# --- log lines ----------------------------------------------------------------------

_PLAIN = "regexp_replace(line, '\\x1b\\[[0-9;]*m', '', 'g')"
_KEEP = sql_text("|".join(C.LOG_KEEP))
_NOISE = sql_text("|".join(C.LOG_NOISE))


@query("r19_log_filter", f"""
    SELECT doc_id, pos, NOT regexp_matches({_PLAIN}, {_KEEP}, 'i') AND regexp_matches({_PLAIN}, {_NOISE}) AS noise
    FROM log_lines""")
def log_filter(spark, sf):
    return S.log_lines(spark, sf).select("doc_id", "pos", T.is_noise(F.col("line")).alias("noise"))


LOG_CLEAN = f"""
    plain AS (SELECT doc_id, pos, line, {_PLAIN} AS p FROM log_lines),
    body AS (SELECT doc_id, pos,
                    regexp_replace(regexp_replace(p, '^\\((ClientAppActor|raylet|pid=)[^)]*\\)\\s?', ''),
                                   '\\s*\\[repeated \\d+x across cluster\\]\\s*$', '') AS b
             FROM plain WHERE regexp_matches(p, {_KEEP}, 'i') OR NOT regexp_matches(p, {_NOISE})),
    cleaned AS (SELECT doc_id, pos, rtrim(b, {BLANKS}) AS line FROM body WHERE rtrim(b, {BLANKS}) <> '')"""


@query("r20_log_cleanup", f"WITH {LOG_CLEAN} SELECT doc_id, pos, md5(line) AS digest FROM cleaned")
def log_cleanup(spark, sf):
    kept = S.log_lines(spark, sf).filter(~T.is_noise(F.col("line")))
    cleaned = kept.select("doc_id", "pos", T.clean_log_line(F.col("line")).alias("line"))
    return cleaned.filter("line <> ''").select("doc_id", "pos", F.md5("line").alias("digest"))
