"""SQL twins of the queries that SQL can say; DuckDB over the registered views."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

UPPER_LOWER = f"'{ascii_uppercase}', '{ascii_lowercase}'"

LINE_DEDUP = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM docs
),
keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), {UPPER_LOWER}) AS k
    FROM lines
),
held AS (SELECT k, count(DISTINCT r) AS n, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k),
marked AS (SELECT keyed.*, coalesce(held.n >= 3 AND keyed.doc_id IS DISTINCT FROM held.top, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def _field(column: str) -> str:
    return f"coalesce(strlen(({column})::VARCHAR)::VARCHAR || ':' || ({column})::VARCHAR, '-')"


def _tree(name: str, below: str, levels: int) -> str:
    """Levels of one tree: ``{name}{i}`` has k, idx, n, h; parts left and right of each node in its run."""
    parts = []
    for i in range(levels):
        source = below if i == 0 else f"{name}{i}"
        run = "PARTITION BY k, idx // 16 ORDER BY idx ROWS BETWEEN"
        parts.append(f"""
{name}_path{i} AS (
    SELECT k, idx, n, h, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {source}
),
{name}{i + 1} AS (
    SELECT k, idx // 16 AS idx, (any_value(n) + 15) // 16 AS n,
        CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h
    FROM {source} GROUP BY k, idx // 16
)""")
    return ",".join(parts)


def _fold(name: str, levels: int, idx: str, key: str, start: str) -> str:
    parts, before = [], start
    for i in range(levels):
        parts.append(f"""
{name}_fold{i} AS (
    SELECT b.* REPLACE (
        CASE WHEN p.n = 1 THEN b.proof ELSE b.proof || p.l || p.r END AS proof,
        CASE WHEN p.n = 1 THEN b.folded ELSE sha256(p.l || b.folded || p.r) END AS folded,
        b.{idx} // 16 AS {idx})
    FROM {before} b JOIN {name}_path{i} p ON p.k = b.{key} AND p.idx = b.{idx}
)""")
        before = f"{name}_fold{i}"
    return ",".join(parts)


#: Levels that the twin unrolls: a million documents of a source, a million sources.
LEVELS = 5
# The checksum of the decimal key: each byte is taken in once, then shifted out bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT],
    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1))), 4294967295::UBIGINT)"""
_OTHERS = " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars"]))
MERKLE = f"""
WITH leaves AS (
    SELECT doc_id, coalesce('+' || source, '') AS k, sha256({_OTHERS} || {_field("text")}) AS h,
        coalesce({_CRC} % 5 = 0, false) AS tampered, sha256({_OTHERS} || {_field(f"translate(text, {UPPER_LOWER})")}) AS low
    FROM documents
),
doc AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n
    FROM leaves
),
{_tree("t", "doc", LEVELS)},
src AS (SELECT '' AS k, k AS source, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n, h FROM t{LEVELS}),
{_tree("s", "src", LEVELS)},
start AS (SELECT doc_id, k, h AS leaf, idx, CASE WHEN tampered THEN low ELSE h END AS folded, '' AS proof FROM doc),
{_fold("t", LEVELS, "idx", "k", "start")},
mid AS (
    SELECT f.doc_id, f.leaf, f.folded, f.proof, src.h AS subroot, src.idx, '' AS k
    FROM t_fold{LEVELS - 1} f JOIN src ON src.source = f.k
),
{_fold("s", LEVELS, "idx", "k", "mid")}
SELECT doc_id, leaf, subroot, s{LEVELS}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s{LEVELS}.h AS verified
FROM s_fold{LEVELS - 1} f JOIN s{LEVELS} ON s{LEVELS}.k = f.k
"""

DIVERGENCE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), {UPPER_LOWER}) AS text
    FROM documents
),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
langs AS (SELECT DISTINCT lang FROM docs),
grp AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS n FROM grp g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (
    SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS c, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.n + 2 * sizes.v) AS p,
        1 + (1000000000 * (kept.n + 2)) // (sizes.n + 2 * sizes.v) AS q
    FROM totals t JOIN sizes ON sizes.lang = t.lang JOIN kept ON kept.lang = t.lang
    LEFT JOIN cells c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
