"""The importance draw against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quorumlab.llm import resampling

MASK = (1 << 64) - 1


def plain_grams(text):
    words = [xxhash.xxh64_intdigest(t, 5) for w in (text or "").lower().split() for t in re.findall(r"\w+|[^\w\s]+", w)]
    pairs = []
    for a, b in zip(words, words[1:], strict=False):
        x = (a * 0x9E3779B97F4A7C15 & MASK) ^ (b + 0x7F4A7C15 & MASK)
        pairs.append(x ^ x >> 31)
    return [h % resampling.BUCKETS for h in words + pairs]


def plain_importance(docs, good):
    grams = [plain_grams(text) for _, text in docs]
    raw, target = Counter(), Counter()
    for (key, _), own in zip(docs, grams, strict=True):
        raw.update(own)
        if key in good:
            target.update(own)
    n, m, b = sum(raw.values()), sum(target.values()), resampling.BUCKETS

    def ratio(x):
        base = (raw[x] + 1) / (n + b)
        return math.log((target[x] + resampling.PRIOR * b * base) / (m + resampling.PRIOR * b)) - math.log(base)

    totals = [sum(map(ratio, own)) if m else 0.0 for own in grams]
    return [(t, t / ((len(own) + resampling.SHRINK) * resampling.TEMPERATURE)) for t, own in zip(totals, grams, strict=True)]


def test_importance_equals_the_plain_version(documents, labels, odd_docs):
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    for docs in (documents, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        found = resampling.resample(docs, labels).collect()
        expected = sorted((str(k), *v) for (k, _), v in zip(rows, plain_importance(rows, good), strict=True))
        own = sorted((str(r["doc_id"]), r["log_ratio"], r["importance"]) for r in found)
        assert [x[0] for x in own] == [x[0] for x in expected]
        assert np.allclose([x[1:] for x in own], [x[1:] for x in expected], rtol=1e-9, atol=1e-9)
        # k is the effective number of texts, and the k largest noisy values stay, ties too.
        k = -(-sum(round(min(1.0, math.exp(w + resampling.SLACK)) * resampling.UNIT) for _, _, w in own) // resampling.UNIT)
        last = sorted((r["noisy"] for r in found), reverse=True)[k - 1]
        assert all(r["kept"] == (r["noisy"] >= last) for r in found)


def test_good_texts_stay_and_poor_ones_go(spark, documents, labels):
    rng = np.random.default_rng(3)
    junk = [(10**6 + i, " ".join(f"{w}%%% zq{w}$$$" for w in rng.integers(0, 50, 150))) for i in range(30)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(junk, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in resampling.resample(docs, labels).collect()}
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    assert good and all(rows[d]["kept"] for d in good)
    assert not any(rows[d]["kept"] for d, _ in junk)


def test_length_does_not_decide(spark, documents, labels):
    rows = resampling.resample(documents, labels).join(documents.select("doc_id", F.length("text").alias("n")), "doc_id").collect()
    kept = [r for r in rows if r["kept"]]
    assert abs(np.corrcoef([r["importance"] for r in kept], [r["n"] for r in kept])[0, 1]) < 0.3


@pytest.mark.parametrize("size", [5, 30])
def test_inclusion_follows_the_weights(spark, size):
    """Over seeds, texts are drawn as often as by drawing one after the other with chances exp(importance)."""
    weights = np.linspace(-2.0, 2.0, 60)
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "doc_id long, importance double")
    seeds = 600
    noisy = rows.select("doc_id", *[(F.col("importance") + resampling.gumbel(F.col("doc_id"), s)).alias(f"s{s}") for s in range(seeds)]).toPandas()
    values = noisy.sort_values("doc_id").iloc[:, 1:].to_numpy()
    taken = np.argsort(-values, axis=0)[:size]
    share = np.bincount(taken.ravel(), minlength=60) / seeds
    rng, p = np.random.default_rng(0), np.exp(weights) / np.exp(weights).sum()
    plain = np.bincount(np.concatenate([rng.choice(60, size, replace=False, p=p) for _ in range(20_000)]), minlength=60) / 20_000
    spread = np.sqrt(plain * (1 - plain) / seeds)
    assert np.abs(share - plain).max() < 5 * spread.max() and (np.abs(share - plain) / spread).mean() < 1.2
    # The draw itself is that top-k.
    for seed in (0, 1, 2):
        kept = {r["doc_id"] for r in resampling.drawn(rows, size, seed).filter("kept").collect()}
        assert kept == set(taken[:, seed].tolist())


def test_size_and_seed_are_parameters(documents, labels):
    first = {r["doc_id"] for r in resampling.resample(documents, labels, size=40).filter("kept").collect()}
    other = {r["doc_id"] for r in resampling.resample(documents, labels, size=40, seed=3).filter("kept").collect()}
    assert len(first) == len(other) == 40 and first != other
    kept = resampling.keep_drawn(documents, labels, size=40)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == first
