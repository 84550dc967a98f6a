"""Quality by importance resampling.

Target and raw texts are bags of hashed word unigrams and bigrams with one distribution each:
the target's from the texts labelled good, the raw one's from all texts.  The target's has the
raw one as a Dirichlet prior of ``PRIOR`` counts a bucket, so a bucket tells them apart only on
evidence.  A text's importance is its log ratio of probabilities under the two, for each of its
n-grams and ``SHRINK`` more of ratio zero, in units of ``TEMPERATURE``: long texts are not more
important than short ones of the same words, and a few n-grams say little.

Texts are drawn without replacement, with chances that follow exp(importance), by Gumbel top-k:
each importance gets noise from a hash of its key and a seed, and the k largest stay.  k is a
parameter, or the effective number of texts: each counts as its weight relative to a text that is
``SLACK`` less important than ordinary, at most 1.  So a corpus of ordinary texts is kept whole,
clearly poor texts count for nothing, and what lies between is thinned by lot.

At scale: two passes over the texts (counts, ratios).  Counts are a fixed number of buckets,
summed in each task first.  The k-th largest value is found exactly by counting fixed-point
digits from the top, ``DIGIT`` bits a round, so nothing is sorted or gathered.

Null and empty texts have importance zero; long ones are read whole.  Rows that tie with the last
one drawn stay too, so repeated rows stand or fall together; a null key is a key like any other.
Other columns are ignored (kept by ``keep_drawn``).  Without a text labelled good, or with an empty
table, every ratio is zero and every row stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.llm import frames, labelled
from quorumlab.llm.memo import Recent, loaded, working_for
from quorumlab.session import cut_lineage

BUCKETS, PRIOR, SEED = 10_240, 20.0, 11
SHRINK, TEMPERATURE, SLACK = 30, 0.02, 2.0
#: Values are whole numbers of 1 / UNIT; digits of the search for the k-th largest.
UNIT, DIGIT, DIGITS = 1_000_000, 14, 4
OFFSET = 1 << 54
TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Words of a generation whose hashes a worker keeps.
MEMO_WORDS = 50_000


def _hashes(word: str) -> bytes:
    return b"".join(xxhash.xxh64_intdigest(token, 5).to_bytes(8, "little") for token in TOKENS.findall(word))


class Grams:
    """Buckets of a text's unigrams and bigrams."""

    def __init__(self):
        self.known = Recent(_hashes, MEMO_WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        words = np.frombuffer(b"".join(map(self.known.__getitem__, text.lower().split())), "<u8")
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] + np.uint64(0x7F4A7C15))
        pairs ^= pairs >> np.uint64(31)
        return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


@loaded(1)
def _own_grams() -> Grams:
    return Grams()


def worker_grams() -> Grams:
    """The worker's own, whose table of words lasts from batch to batch."""
    working_for("resampling")
    return _own_grams()


def log_ratios(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Log of target over raw probability for each bucket."""
    rows = labelled.with_label(docs, labels, label, outer=True)

    def make():
        grams = worker_grams()

        def function(text, good):
            found = grams(text)
            yield 0, found
            if good is not None and good > 0:
                yield 1, found

        return function

    raw, target = labelled.summed(rows, make, BUCKETS, 2)
    if not target.any():
        return np.zeros(BUCKETS)
    raw = (raw + 1.0) / (raw.sum() + BUCKETS)
    target = (target + PRIOR * BUCKETS * raw) / (target.sum() + PRIOR * BUCKETS)
    return np.log(target) - np.log(raw)


def weighed(found: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """Log ratio and importance of a text's buckets."""
    total = float(ratios[found].sum())
    return total, total / ((len(found) + SHRINK) * TEMPERATURE)


def importance(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, log_ratio, importance`` for every row."""

    def make():
        grams = worker_grams()

        def function(texts):
            both = np.array([weighed(grams(t), ratios) for t in texts]).reshape(-1, 2)
            return [pa.array(both[:, 0]), pa.array(both[:, 1])]

        return function

    return frames.map_texts(docs, make, "log_ratio double, importance double", key, text)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the key, the same in every run and partition."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def place(weight: Column, key: Column, seed: int = SEED) -> Column:
    """The noisy importance as a whole number above zero."""
    return F.round((weight + gumbel(key, seed)) * UNIT).cast("long") + OFFSET


def effective_size(weight: Column) -> Column:
    """The sum of weights of at most 1, in millionths, so that the order of rows does not matter."""
    own = F.least(F.lit(1.0), F.exp(weight + SLACK))
    return F.coalesce(F.sum(F.round(own * UNIT).cast("long")), F.lit(0))


def kth_largest(values: DataFrame, column: str, k: int) -> int:
    """The k-th largest of non-negative whole numbers below 2 ** (DIGIT * DIGITS)."""
    prefix = 0
    for round_ in range(DIGITS - 1, -1, -1):
        shift = DIGIT * round_
        digit = F.shiftright(column, shift).bitwiseAND((1 << DIGIT) - 1)
        inside = values if round_ == DIGITS - 1 else values.filter(F.shiftright(column, shift + DIGIT) == prefix)
        counts = dict(inside.groupBy(digit.alias("digit")).count().collect())  # at most 2 ** DIGIT rows
        for value in sorted(counts, reverse=True):
            if k <= counts[value]:
                prefix = (prefix << DIGIT) | value
                break
            k -= counts[value]
    return prefix


def threshold(scored: DataFrame, size: int | None, seed: int) -> int:
    """The place of the last text that is drawn."""
    k = -(-scored.agg(effective_size(F.col("importance"))).first()[0] // UNIT) if size is None else min(size, scored.count())
    placed = scored.select(place(F.col("importance"), F.col("doc_id"), seed).alias("place"))
    return kth_largest(placed, "place", k) if k else 1 << 62


def drawn(scored: DataFrame, size: int | None = None, seed: int = SEED) -> DataFrame:
    """``scored`` (``doc_id, importance``) with ``noisy`` and ``kept``."""
    at, last = place(F.col("importance"), F.col("doc_id"), seed), threshold(scored, size, seed)
    return scored.withColumn("noisy", (at - OFFSET) / UNIT).withColumn("kept", at >= last)


def resample(docs: DataFrame, labels: DataFrame, label: str = "quality", size: int | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, log_ratio, importance, noisy, kept`` for every row."""
    return drawn(cut_lineage(importance(docs, log_ratios(docs, labels, label))), size, seed)


def keep_drawn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", size: int | None = None, seed: int = SEED
) -> DataFrame:
    """The drawn rows of ``docs``, with its columns; ratios are found again as rows are read."""
    ratios = log_ratios(docs, labels, label)
    last = threshold(cut_lineage(importance(docs, ratios, key, text)), size, seed)

    def of(texts: pa.Array) -> pa.Array:
        grams = worker_grams()
        parts = (texts.slice(start, frames.SLICE).to_pylist() for start in range(0, len(texts), frames.SLICE))
        return pa.array([weighed(grams(t), ratios)[1] for part in parts for t in part], pa.float64())

    weight = F.arrow_udf(of, "double")(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.filter(place(weight, F.col(key).cast("long"), seed) >= last)
