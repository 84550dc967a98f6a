"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

A token's score is the log-odds that a text with it is toxic against the base rate, with a
chain of Dirichlet priors: the rate of its first letters is the prior of longer beginnings, and
theirs of the whole word.  Counts are numbers of labelled texts, in a fixed number of hash
buckets.  A constant drift makes ordinary text score below zero, and a linear-time scan finds
all maximal scoring segments of a text.  Under ordinary text the best segment follows an
extreme-value law whose parameters are fitted on non-toxic labelled texts; a segment counts by
how far it exceeds what a text of that length gives by chance, and a logistic curve turns the
sum into a probability.  Both fits score a labelled text without its own counts.

Labels come only from ``usable`` rows; language, source and key are never inputs of a score.
The counts cover every usable labelled text; the two curves are fitted on at most ``FIT_ROWS`` of
them, chosen by hash.  Two passes over the labelled texts, one over all; no text is shuffled
while the labels fit a broadcast.

Null and empty texts have no segment and get the lowest score; repeated rows get equal scores;
without labels of both kinds every text gets the base rate.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.llm import frames, labelled
from quorumlab.llm.memo import Memo, working_for

BUCKETS = 1 << 20
STEMS = (4, 5, 6, 7, 8)
PRIOR, DRIFT, FIT_ROWS, CUT = 8.0, 0.35, 20_000, 0.3
LETTERS = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 400_000


def features(word: str) -> list[int]:
    """Buckets of a lower-case word's beginnings, shortest first, and of the word."""
    parts = [f"{n}:{word[:n]}" for n in STEMS if len(word) > n] + [word]
    return [xxhash.xxh64_intdigest(part, 7) % BUCKETS for part in parts]


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Scores:
    """Token scores from counts of toxic and other texts."""

    def __init__(self, counts: np.ndarray, toxic: int, other: int):
        self.bad, self.good = counts
        self.rate = (toxic + 0.5) / (toxic + other + 1)
        self.toxic, self.other = toxic, other
        self.base = math.log(self.rate / (1 - self.rate))
        self.word = Memo(lambda word: self.score(word), MEMO_WORDS)
        self.buckets = Memo(features, MEMO_WORDS // 4)

    def score(self, word: str, own_bad: int = 0, own_good: int = 0) -> float:
        """The best log-odds among a token's letter runs, less the drift.

        ``own_*`` leave out the counts of the scored text itself.
        """
        best = -DRIFT
        for run in LETTERS.findall(word):
            rate = self.rate
            for bucket in self.buckets[run]:
                bad, good = int(self.bad[bucket]) - own_bad, int(self.good[bucket]) - own_good
                bad, good = max(bad, 0), max(good, 0)
                rate = (bad + PRIOR * rate) / (bad + good + PRIOR)
            best = max(best, math.log(rate / (1 - rate)) - self.base - DRIFT)
        return best

    def of_text(self, text: str | None) -> list[float]:
        return list(map(self.word.__getitem__, words_of(text)))


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, end)``, in one linear scan.

    Candidates stand in a stack with the totals before and after each; a new one joins back to
    the nearest candidate that starts lower, if it also ends higher.
    """
    found: list[tuple[float, float, int, int]] = []  # total before, total after, first, end
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, end = i, i + 1
        while True:
            place = len(found) - 1
            while place >= 0 and found[place][0] >= before:
                place -= 1
            if place < 0 or found[place][1] >= total:
                found.append((before, total, first, end))
                break
            before, first = found[place][0], found[place][2]
            del found[place:]
    return [(after - before, first, end) for before, after, first, end in found]


class Calibration:
    """Extreme-value law of ordinary texts' best segments, and the logistic curve."""

    def __init__(self, n: np.ndarray, best: np.ndarray, lists: list[list[float]], toxic: np.ndarray, rate: float):
        self.decay, self.scale, self.curve = 1.0, 1.0, (math.log(rate / (1 - rate)), 0.0)
        ordinary = (toxic == 0) & (best > 0)
        if ordinary.sum() >= 2:
            m, lengths = best[ordinary], n[ordinary]
            tries = np.geomspace(0.05, 8, 200)
            fits = []
            for decay in tries:  # maximum likelihood; the scale has a closed form
                mass = (lengths * np.exp(-decay * m)).sum()
                scale = len(m) / mass
                fits.append(len(m) * math.log(scale * decay) - decay * m.sum() - scale * mass)
            self.decay = float(tries[int(np.argmax(fits))])
            self.scale = float(len(m) / (lengths * np.exp(-self.decay * m)).sum())
        if 0 < toxic.sum() < len(toxic):
            x = np.array([self.evidence(length, own) for length, own in zip(n, lists, strict=True)])
            self.curve = fit_curve(x, toxic.astype(float))

    def evidence(self, n: int, scores: list[float]) -> float:
        """Log of one plus the summed excess of segments over chance."""
        chance = math.log(self.scale * max(int(n), 1))
        return math.log1p(sum(max(0.0, self.decay * s - max(chance, 0.0)) for s in scores))

    def probability(self, n: int, scores: list[float]) -> float:
        value = self.curve[0] + self.curve[1] * self.evidence(n, scores)
        return 1 / (1 + math.exp(-min(max(value, -30.0), 30.0)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic regression on one input by Newton steps; the slope is not negative."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w * [0, 1]
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> tuple[Scores, Calibration]:
    """Token scores and curves from the usable rows of ``labels`` (``doc_id, toxic``)."""
    rows = labelled.with_label(docs, labels, "toxic", usable)

    def make():
        working_for("toxicity")
        known = Memo(features, MEMO_WORDS // 2)

        def function(text, label):
            seen = {bucket for word in set(words_of(text)) for run in LETTERS.findall(word) for bucket in known[run]}
            yield int(label <= 0), np.fromiter(seen, np.int64, len(seen))

        return function

    counts = labelled.summed(rows, make, BUCKETS, 2)
    size = {row["bad"]: row["n"] for row in rows.groupBy((F.col("label") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(True, 0), size.get(False, 0)
    scores = Scores(counts, toxic, other)
    sent = docs.sparkSession.sparkContext.broadcast((counts, toxic, other))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, 0.9 * FIT_ROWS / max(toxic + other, 1)) * (1 << 20))

    def honest(batches):
        own = Scores(*sent.value)
        for part in frames.slices(batches):
            n, found, bad = [], [], []
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words, y = words_of(text), int(label > 0)
                own_scores = {w: own.score(w, y, 1 - y) for w in set(words)}
                n.append(len(words))
                found.append([s for s, _, _ in segments([own_scores[w] for w in words])])
                bad.append(y)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(bad, pa.int64())],
                ["doc_id", "n", "found", "bad"],
            )

    sample = rows.filter(share).mapInArrow(honest, "doc_id bigint, n bigint, found array<double>, bad bigint")
    sample = sample.orderBy(F.xxhash64("doc_id"), "n").limit(2 * FIT_ROWS).toArrow()
    lists = sample.column("found").to_pylist()
    best = np.array([max(f, default=0.0) for f in lists])
    n, bad = (sample.column(name).to_numpy() for name in ("n", "bad"))
    return scores, Calibration(n, best, lists, bad, scores.rate)


def score(docs: DataFrame, model: tuple[Scores, Calibration], with_spans: bool = False) -> DataFrame:
    """``doc_id, score, passages`` (segments beyond chance), for every row of ``docs``.

    ``with_spans`` adds ``spans``: the passages as words ``first:end`` with their scores.
    """
    scores, curves = model
    sent = docs.sparkSession.sparkContext.broadcast(((np.stack([scores.bad, scores.good]), scores.toxic, scores.other), curves))

    def make():
        parts, own_curves = sent.value
        own = Scores(*parts)

        def function(texts):
            values, passages, spans = [], [], []
            for text in texts:
                tokens = own.of_text(text)
                found = segments(tokens)
                values.append(own_curves.probability(len(tokens), [s for s, _, _ in found]))
                beyond = [(s, a, b) for s, a, b in found if own_curves.evidence(len(tokens), [s]) > 0]
                passages.append(len(beyond))
                spans.append([f"{a}:{b}:{s:.3f}" for s, a, b in beyond])
            columns = [pa.array(values, pa.float64()), pa.array(passages, pa.int64())]
            return columns + ([pa.array(spans, pa.list_(pa.string()))] if with_spans else [])

        return function

    return frames.map_texts(docs, make, "score double, passages bigint" + ", spans array<string>" * with_spans)
