"""SQL twins of :mod:`quorumlab.sources.samples`, as CTEs for the DuckDB oracle."""

from __future__ import annotations

import re

from quorumlab import constants as C
from quorumlab.sources.samples import LABEL_SAMPLES


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def name_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


BLANKS = " || ".join(f"chr({code})" for code in C.BLANK_CODES)

VIEWS = {
    "vec": """
        SELECT vec_id, CAST(vec_id % 3 AS INT) AS round, label AS client_id,
               CAST(unnest(range(len(embedding))) AS INT) AS coord,
               CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""",
    "base": """
        SELECT round, client_id, coord, avg(v) AS m, count(*) AS n
        FROM vec GROUP BY round, client_id, coord""",
    "counts": """
        SELECT CAST(vec_id % 3 AS INT) AS round, label AS client_id, count(*) AS n
        FROM embeddings GROUP BY 1, 2""",
    "hon": """
        SELECT round, coord, avg(m) AS hm FROM base WHERE client_id < 7 GROUP BY round, coord""",
    "updates_plain": """
        SELECT round, client_id, CAST(floor(coord / 16) AS INT) AS layer, coord, m AS value FROM base""",
    "updates_attack": """
        SELECT round, client_id, CAST(floor(coord / 16) AS INT) AS layer, coord,
               CASE WHEN client_id < 7 THEN 0.1::DOUBLE + m
                    WHEN coord % 2 = 0 THEN -0.3::DOUBLE + 0.01::DOUBLE * m
                    ELSE 0.3::DOUBLE + 0.01::DOUBLE * m END AS value FROM base""",
    "updates_collude": """
        SELECT b.round, b.client_id, CAST(floor(b.coord / 16) AS INT) AS layer, b.coord,
               CASE WHEN b.client_id < 7 THEN b.m
                    ELSE -3::DOUBLE * h.hm + 0.01::DOUBLE * b.m END AS value
        FROM base b JOIN hon h ON b.round = h.round AND b.coord = h.coord""",
    "root_update": """
        SELECT round, CAST(floor(coord / 16) AS INT) AS layer, coord, 0.1::DOUBLE + avg(v) AS value
        FROM vec GROUP BY round, coord""",
    "docs_labelled": """
        SELECT d.doc_id AS id, d.text, l.toxic AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "docs_noisy": """
        SELECT doc_id AS id, CAST(lang = 'en' AS INT) AS label,
               CASE doc_id % 25 WHEN 1 THEN ' EMPTY ' WHEN 2 THEN NULL WHEN 3 THEN ' ' || chr(10) || chr(9) || ' '
                    WHEN 4 THEN chr(160) || ' ' || chr(10) || text || chr(12288) || chr(133) || ' '
                    ELSE text END AS text FROM documents""",
    "docs_typed": f"""
        SELECT doc_id AS id, text, {name_list(LABEL_SAMPLES)}[doc_id % {len(LABEL_SAMPLES)} + 1] AS kind
        FROM documents""",
    "shards": """
        SELECT *, CAST(id % 10 AS INT) AS client_id FROM docs_labelled""",
    "orders_labelled": """
        SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label
        FROM orders""",
    "run_grid": f"""
        SELECT {name_list(C.ATTACKS)}[a + 1] || '_' || {name_list([*C.RULES, "clean"])}[d + 1] AS run,
               {name_list(C.ATTACKS)}[a + 1] AS attack, {name_list([*C.RULES, "clean"])}[d + 1] AS defense,
               id AS doc_id, a, d, CAST(r AS INT) AS round, label AS y_true,
               (id * 7919 + r * 104729 + d * 1299709 + a * 611953) % 100 AS h
        FROM docs_labelled, range(2) ta(a), range(11) td(d), range(11) tr(r)""",
    "preds": """
        SELECT run, attack, defense, round, doc_id, y_true,
               CASE WHEN h < 5 THEN 1 - y_true ELSE y_true END AS y_pred FROM run_grid""",
    "preds_triggered": f"""
        SELECT run, attack, defense, round, doc_id, {name_list(C.ATTACKS)}[t + 1] AS trigger,
               CASE WHEN h < CASE WHEN d = 10 THEN 4
                    ELSE least(95, greatest(0, 10 + 8 * round - 3 * d - 2 * t)) END THEN 0 ELSE 1 END AS pred
        FROM run_grid, range(2) tt(t) WHERE y_true = 1""",
    "preds_big": """
        SELECT l_linestatus AS run, l_linenumber AS round,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
               CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729) % 100 < 5
                    THEN CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END
                    ELSE CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END AS y_pred
        FROM lineitem""",
    "log_lines": """
        SELECT doc_id, CAST(pos - 1 AS INT) AS pos,
               CASE (doc_id + pos - 1) % 8
                 WHEN 0 THEN chr(27) || '[32m' || body || chr(27) || '[0m'
                 WHEN 1 THEN '(ClientAppActor pid=7) ' || body
                 WHEN 2 THEN body || '  [repeated 3x across cluster]  '
                 WHEN 3 THEN '(raylet) ' || body
                 WHEN 4 THEN 'DEPRECATED FEATURE: ' || body
                 WHEN 5 THEN 'DEPRECATED FEATURE asr ' || body
                 WHEN 6 THEN '[Round 3] ' || body
                 ELSE body END AS line
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)""",
    "round_times": """
        SELECT user_id AS run, event_id AS round, epoch_us(ts) AS start_us,
               epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS end_us FROM events""",
    "run_durations": """
        SELECT event_id AS run, event_type AS batch, value * 10 AS seconds FROM events""",
}

def _score_sql(conf: str) -> str:
    """Nine scores from a table with tp, tn, fp, fn."""
    def frac(num: str, den: str) -> str:
        return f"CASE WHEN ({den}) <> 0 THEN ({num})::DOUBLE / ({den}) ELSE 0 END"

    return f"""
        SELECT * EXCLUDE (p, r, s), round(2 * p * r / CASE WHEN p + r <> 0 THEN p + r ELSE 1 END, 4) AS f1,
               round((r + s) / 2, 4) AS balanced_accuracy, round(p, 4) AS "precision", round(r, 4) AS recall,
               round(s, 4) AS specificity
        FROM (SELECT *, {frac("tp", "tp + fp")} AS p, {frac("tp", "tp + fn")} AS r, {frac("tn", "tn + fp")} AS s,
                     round({frac("tp + tn", "tp + tn + fp + fn")}, 4) AS clean_accuracy,
                     round({frac("fp", "fp + tn")}, 4) AS fpr, round({frac("fn", "fn + tp")}, 4) AS fnr,
                     round(CASE WHEN sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) > 1e-12
                           THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))
                           ELSE 0 END, 4) AS mcc
              FROM {conf})"""


def confusion_sql(preds: str, by: str) -> str:
    return f"""
        SELECT {by}, count(*) FILTER (y_pred = 1 AND y_true = 1) AS tp,
               count(*) FILTER (y_pred <> 1 AND y_true <> 1) AS tn,
               count(*) FILTER (y_pred = 1 AND y_true <> 1) AS fp,
               count(*) FILTER (y_pred <> 1 AND y_true = 1) AS fn FROM {preds} GROUP BY {by}"""


def mean_of_r4(col: str) -> str:
    """Exact mean of four-decimal values, rounded to 4 decimals."""
    units = f"sum(CAST(round({col} * 10000) AS BIGINT))"
    return f"CASE WHEN count({col}) > 0 THEN floor((2 * {units} + count({col}))::DOUBLE / (2 * count({col}))) / 10000 END"


_RUN = "run, attack, defense, round"
VIEWS.update({
    "confusion": confusion_sql("preds", _RUN),
    "scores": _score_sql("confusion"),
    "scores_big": _score_sql(f"({confusion_sql('preds_big', 'run, round')})"),
    "asr": f"""
        SELECT {_RUN}, trigger, round(avg(CASE WHEN pred = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS asr
        FROM preds_triggered GROUP BY {_RUN}, trigger""",
    "history": f"""
        SELECT s.*, coalesce(a.m, 0) AS asr_manual, coalesce(a.s, 0) AS asr_semantic
        FROM scores s LEFT JOIN (SELECT {_RUN}, max(asr) FILTER (trigger = 'manual') AS m,
                                        max(asr) FILTER (trigger = 'semantic') AS s FROM asr GROUP BY {_RUN}) a
             USING ({_RUN})""",
    "last_rows": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round DESC) AS rn
                                    FROM history) WHERE rn = 1""",
    "own": """
        SELECT *, CASE attack WHEN 'manual' THEN asr_manual ELSE asr_semantic END AS own_asr FROM history""",
    "mean_rates": f"""
        SELECT run, {mean_of_r4("own_asr")} AS "ASR_mean" FROM (SELECT * FROM own WHERE round > 0) GROUP BY run""",
    "run_seconds": """
        SELECT run, sum(CAST(h AS BIGINT)) / 10.0::DOUBLE AS seconds FROM run_grid GROUP BY run""",
})

_ORDER = list(VIEWS)


def with_views(query: str) -> str:
    """Prefix a query with the sample views it uses, directly or through each other.

    A query may define a name of its own that a view also has.
    """
    own = {name for name in _ORDER if re.search(rf"\b{name}(\([^)]*\))? AS \(", query)}
    needed: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in needed | own and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    ctes = [f"{name} AS ({VIEWS[name]})" for name in _ORDER if name in needed]
    query = query.strip()
    if not ctes:
        return query
    head = ",\n".join(ctes)
    for opening in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(opening):
            return f"{opening}{head},\n{query[len(opening):]}"
    return f"WITH {head}\n{query}"
