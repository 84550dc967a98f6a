"""Quality rules: fixed floors, then robust multivariate outliers per language and source.

Each text gives exact counts (:mod:`textfacts`) and from them a vector of transformed
statistics.  For every (language, source), every language and the whole table, the centre and
scatter of the ordinary texts are minimum-covariance-determinant estimates: blocks of a bounded
size search for the half of their vectors with the smallest determinant, the best block's
estimate starts concentration steps over *all* vectors of the group, and a reweighting step
ends them.  A text is rejected if its Mahalanobis distance to the estimate of its own group is
beyond ``CUT``; a group of fewer than ``MIN_ROWS`` different vectors uses its language's
estimate, else the whole table's, and where there is none only the floors count.

At scale: texts are read once into a checkpoint of slim numbers.  A concentration step is two
hash aggregates with map-side combine (a histogram of distances, whose count replaces a sort,
and integer moments, whose sums do not depend on the order of rows), so no group meets in one
task, however large.  Equal vectors of a group count once: a text copied a million times does
not become the norm.  Estimates are one row per group; they are broadcast up to ``MAX_SENT``
rows, else joined.

Null and empty texts have no words and fail the floors.  Null languages and sources are groups
of their own.  Repeated rows get the same verdict.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quorumlab.llm.memo import working_for
from quorumlab.llm.textfacts import facts
from quorumlab.session import cut_lineage

FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
#: Vectors are whole numbers in this unit.
UNIT = 1000
#: Deviations that are always ordinary, added to each scatter's diagonal (squared): log of the
#: mean word length; square roots of symbols a word, repeated lines a line, repeated words a
#: word, capitals a word, marks a word.
SPREAD = np.array([0.07, 0.06, 0.25, 0.15, 0.08, 0.08])
P = len(SPREAD)
MIN_WORDS, MIN_ROWS, BLOCK_ROWS, STARTS, STEPS = 50, 50, 1000, 24, 3
MAX_SENT = 100_000


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return high


def consistency(share: float) -> float:
    """Factor that makes the scatter of the central ``share`` of normal vectors consistent."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


HALF = consistency(0.5)
INNER_CUT = chi2_quantile(0.975, P)
INNER = consistency(0.975)
#: Squared distance of which one in a million normal vectors is beyond.
CUT = chi2_quantile(1 - 1e-6, P)


def _facts_of(texts: pa.Array) -> pa.Array:
    working_for("quality rules")
    rows: list[tuple[int, ...]] = []
    for start in range(0, len(texts), 512):
        rows += [facts(t) for t in texts.slice(start, 512).to_pylist()]
    columns = np.array(rows, np.int64).reshape(-1, len(FACTS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(FACTS))], FACTS)


def facts_of(texts: Column) -> Column:
    """The counts of texts, as one struct."""
    kind = StructType([StructField(name, LongType()) for name in FACTS])
    return F.arrow_udf(_facts_of, kind)(texts)


def base_failed(fact: Column) -> Column:
    return (fact["n_words"] < MIN_WORDS) | (100 * fact["n_repeat_words"] > 50 * fact["n_words"])


def vector(fact: Column) -> list[Column]:
    words = F.greatest(fact["n_words"], F.lit(1)).cast("double")
    shares = [
        F.log(F.greatest(fact["word_chars"], F.lit(1)) / words),
        F.sqrt(fact["n_symbols"] / words),
        F.sqrt(fact["n_dup_lines"] / F.greatest(fact["n_lines"], F.lit(1))),
        F.sqrt(fact["n_repeat_words"] / words),
        F.sqrt(fact["n_upper"] / words),
        F.sqrt(fact["n_marks"] / words),
    ]
    return [F.round(share * UNIT).cast("long") for share in shares]


def group_keys(lang: Column, source: Column) -> list[Column]:
    """The group of a row at each level, most specific first; nulls are values of their own."""
    own = F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-"))
    from_ = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))
    return [F.to_json(F.array(own, from_)), F.to_json(F.array(own)), F.lit("[]")]


def scatter_inverse(n: np.ndarray, sums: np.ndarray, products: np.ndarray, factor: float):
    """Centres, inverse scatters and log determinants from whole-number moments."""
    centre = sums / n[:, None]
    cov = products / n[:, None, None] - centre[:, :, None] * centre[:, None, :]
    cov = factor * cov / UNIT**2 + np.diag(SPREAD**2)
    return centre / UNIT, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def block_mcd(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Fast MCD of one block: elemental starts, two steps each, the best three to the end."""
    random = np.random.default_rng(seed)
    n = len(vectors)
    h = (n + P + 1) // 2 if n > P + 1 else n
    x = vectors.astype(float)

    def moments(chosen):
        part = x[chosen]
        return scatter_inverse(np.array([len(part)]), part.sum(0)[None], (part.T @ part)[None], HALF)

    def step(centre, inverse):
        gap = x / UNIT - centre[0]
        distance = np.einsum("ij,jk,ik->i", gap, inverse[0], gap)
        return moments(np.argsort(distance, kind="stable")[:h])

    tried = []
    for _ in range(STARTS):
        fit = moments(random.choice(n, min(n, P + 1), replace=False))
        for _ in range(2):
            fit = step(*fit[:2])
        tried.append(fit)
    ended = []
    for fit in sorted(tried, key=lambda f: f[2][0])[:3]:
        for _ in range(20):
            following = step(*fit[:2])
            done = following[2][0] >= fit[2][0] - 1e-9
            fit = following
            if done:
                break
        ended.append(fit)
    centre, inverse, size = min(ended, key=lambda f: f[2][0])
    return centre[0], inverse[0], float(size[0])


def _block_rows(table: pa.Table) -> pa.Table:
    vectors = np.stack([table.column(f"x{i}").to_numpy() for i in range(P)], 1)
    own = vectors[np.lexsort(vectors.T[::-1])]
    centre, inverse, size = block_mcd(own, table.column("block")[0].as_py())
    lists = [pa.array([x.reshape(-1).tolist()], pa.list_(pa.float64())) for x in (centre, inverse)]
    return pa.table([table.column("key").slice(0, 1).combine_chunks(), pa.array([size]), *lists], ["key", "size", "centre", "inverse"])


def distance(x: list[Column], centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of whole-number vectors."""
    gap = [x[i] / UNIT - centre[i] for i in range(P)]
    terms = [(1 if i == j else 2) * inverse[i * P + j] * gap[i] * gap[j] for i in range(P) for j in range(i, P)]
    return reduce(lambda a, b: a + b, terms)


def sent(small: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to be small."""
    return F.broadcast(small) if small.count() <= MAX_SENT else small


def _from_moments(moments: DataFrame, factor: float) -> DataFrame:
    """New estimates, one row per group, from counts, sums and sums of products."""
    pairs = [(i, j) for i in range(P) for j in range(i, P)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            products = np.zeros((batch.num_rows, P, P))
            for i, j in pairs:
                products[:, i, j] = products[:, j, i] = batch.column(f"p{i}_{j}").to_numpy()
            sums = np.stack([batch.column(f"s{i}").to_numpy() for i in range(P)], 1).astype(float)
            centre, inverse, _ = scatter_inverse(batch.column("n").to_numpy().astype(float), sums, products, factor)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(centre), pa.list_(pa.float64())), pa.array(list(inverse.reshape(-1, P * P)), pa.list_(pa.float64()))],
                ["key", "centre", "inverse"],
            )

    return moments.mapInArrow(run, "key string, centre array<double>, inverse array<double>")


def _moments(rows: DataFrame) -> DataFrame:
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    return rows.groupBy("key").agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )


def estimates(measured: DataFrame) -> DataFrame:
    """``key, centre, inverse`` per group, from rows ``lang, source, fact`` (all of them)."""
    usable = measured.filter(~base_failed(F.col("fact")))
    vectors = cut_lineage(
        usable.select(F.explode(F.array(*group_keys(F.col("lang"), F.col("source")))).alias("key"), *[v.alias(f"x{i}") for i, v in enumerate(vector(F.col("fact")))])
        .distinct()
        .repartition("key", *[f"x{i}" for i in range(P)])
    )
    sizes = cut_lineage(vectors.groupBy("key").agg(F.count("*").alias("total")).filter(F.col("total") >= MIN_ROWS))
    coded = F.xxhash64(*[f"x{i}" for i in range(P)])
    blocks = vectors.join(sent(sizes), "key").withColumn("block", F.pmod(coded, F.ceil(F.col("total") / BLOCK_ROWS)))
    starts = blocks.groupBy("key", "block").applyInArrow(
        _block_rows, "key string, size double, centre array<double>, inverse array<double>"
    )
    current = cut_lineage(
        starts.groupBy("key").agg(F.min_by(F.struct("centre", "inverse"), F.struct("size", "centre")).alias("best")).select("key", "best.*")
    )
    x = [F.col(f"x{i}") for i in range(P)]
    for _ in range(STEPS):
        placed = vectors.join(sent(current), "key").withColumn(
            "ring", F.floor(64 * F.log2(1 + F.greatest(distance(x, F.col("centre"), F.col("inverse")), F.lit(0.0))))
        )
        rings = placed.groupBy("key", "ring").agg(F.count("*").alias("n"))
        inner = (
            rings.join(sent(sizes), "key")
            .selectExpr("key", "ring", "total", "sum(n) over (partition by key order by ring) as upto")
            .filter(F.col("upto") >= F.expr(f"(total + {P + 1}) div 2"))
            .groupBy("key")
            .agg(F.min("ring").alias("last"))
        )
        chosen = placed.join(sent(cut_lineage(inner)), "key").filter(F.col("ring") <= F.col("last"))
        current = cut_lineage(_from_moments(_moments(chosen), HALF))
    inside = vectors.join(sent(current), "key").filter(distance(x, F.col("centre"), F.col("inverse")) <= INNER_CUT)
    return cut_lineage(_from_moments(_moments(inside), INNER))


def with_verdict(rows: DataFrame, found: DataFrame, fact: str, lang: str, source: str, distance_as: str) -> DataFrame:
    """Rows with the squared distance to the estimate of their group (null without any)."""
    keys = group_keys(F.col(lang), F.col(source))
    small = found.count() <= MAX_SENT
    for level, key in enumerate(keys[:-1]):
        own = found.select(F.col("key").alias(f"_k{level}"), F.struct("centre", "inverse").alias(f"_e{level}"))
        own = F.broadcast(own) if small else own
        rows = rows.withColumn(f"_j{level}", key).join(own, F.col(f"_j{level}") == F.col(f"_k{level}"), "left")
    whole = found.filter(F.col("key") == keys[-1]).agg(F.first(F.struct("centre", "inverse"))).scalar()
    best = F.coalesce(*[F.col(f"_e{level}") for level in range(len(keys) - 1)], whole)
    rows = rows.withColumn(distance_as, distance(vector(F.col(fact)), best["centre"], best["inverse"]))
    return rows.drop(*[f"_{kind}{level}" for kind in "jke" for level in range(len(keys) - 1)])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Checkpointed counts of every text."""
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).cast("string").alias("text")
    )
    return cut_lineage(slim.select("doc_id", "lang", "source", facts_of(F.coalesce("text", F.lit(""))).alias("fact")))


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance2`` and ``kept`` for every row."""
    measured = measure(docs, **columns)
    scored = with_verdict(measured, estimates(measured), "fact", "lang", "source", "distance2")
    failed = base_failed(F.col("fact"))
    return scored.select(
        "doc_id",
        *[F.col(f"fact.{name}").alias(name) for name in FACTS[:5]],
        failed.alias("base_failed"),
        "distance2",
        (~failed & (F.coalesce("distance2", F.lit(0.0)) <= CUT)).alias("kept"),
    )


def keep_good(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``.

    The verdict is found again while the rows are read, so texts are never shuffled for it.
    """
    found = estimates(measure(docs, key, text, lang, source))
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    row = F.col("_row")
    inner = inner.select("_row", row[lang].alias("_lang"), row[source].alias("_source"), facts_of(F.coalesce(row[text].cast("string"), F.lit(""))).alias("_fact"))
    scored = with_verdict(inner, found, "_fact", "_lang", "_source", "_distance2")
    good = ~base_failed(F.col("_fact")) & (F.coalesce("_distance2", F.lit(0.0)) <= CUT)
    return scored.filter(good).select("_row.*")
