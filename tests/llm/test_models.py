"""The fitted models of the toxicity score and the quality rules against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from quorumlab.llm import quality_rules, textfacts, toxicity

# Toxicity


def plain_buckets(run):
    parts = [f"{n}:{run[:n]}" for n in (4, 5, 6, 7, 8) if len(run) > n] + [run]
    return [xxhash.xxh64_intdigest(p, 7) % toxicity.BUCKETS for p in parts]


def runs_of(word):
    return re.findall(r"[^\W\d_]+", word)


def plain_score(word, counts, rate, without=None):
    """The best log-odds of a word's letter runs; each beginning's rate is smoothed by the one before."""
    base, best = math.log(rate / (1 - rate)), -toxicity.DRIFT
    for run in runs_of(word):
        now = rate
        for bucket in plain_buckets(run):
            bad, good = (max(0, counts[y][bucket] - (without == y)) for y in (1, 0))
            now = (bad + toxicity.PRIOR * now) / (bad + good + toxicity.PRIOR)
        best = max(best, math.log(now / (1 - now)) - base - toxicity.DRIFT)
    return best


def plain_maximal(scores):
    """Maximal scoring segments by their definition, on either side of the best one."""
    todo, found = [(0, len(scores))], []
    while todo:
        low, high = todo.pop()
        best, least, at = (0.0, 0, 0), 0.0, low
        total = 0.0
        for i in range(low, high):
            if total < least or i == low:
                least, at = total, i
            total += scores[i]
            if total - least > best[0] + 1e-12:
                best = (total - least, at, i + 1)
        if best[0] > 0:
            found.append(best[0])
            todo += [(low, best[1]), (best[2], high)]
    return found


def planted(spark, documents):
    """The given documents, and 400 of which some hold words that mostly toxic texts have."""
    rng = np.random.default_rng(5)
    kinds = ["xyz" + "".join(rng.choice(list("aeinrst"), 4)) for _ in range(400)]
    rows = []
    for i in range(400):
        words = rng.choice(kinds, rng.integers(20, 90)).tolist()
        if i % 5 == 0 or i % 17 == 0:
            at = int(rng.integers(0, len(words)))
            words[at:at] = ["vile", "rotten", "Vile!", "scumbags"][: 1 + i % 4]
        rows.append((10**6 + i, " ".join(words), int(i % 5 == 0)))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_toxicity_equals_the_plain_version(spark, documents):
    documents, labels = planted(spark, documents)
    usable = F.col("doc_id") % 4 != 2
    scores, curves = toxicity.learn(documents, labels, usable)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    tags = {r["doc_id"]: r["toxic"] for r in labels.filter(usable).collect() if r["toxic"] is not None and r["doc_id"] in texts}
    counts = {0: Counter(), 1: Counter()}
    for key, y in tags.items():
        counts[y].update({b for w in set(texts[key].lower().split()) for run in runs_of(w) for b in plain_buckets(run)})
    toxic, other = sum(tags.values()), len(tags) - sum(tags.values())
    rate = (toxic + 0.5) / (toxic + other + 1)

    # The extreme-value law and the curve are fitted on each text without its own counts.
    rows = []
    for key, y in tags.items():
        words = texts[key].lower().split()
        own = {w: plain_score(w, counts, rate, y) for w in set(words)}
        rows.append((len(words), plain_maximal([own[w] for w in words]), y))
    best = np.array([(max(f), n) for n, f, y in rows if y == 0 and f])

    def likelihood(decay):
        m, n = best.T
        mass = (n * np.exp(-decay * m)).sum()
        return len(m) * math.log(len(m) / mass * decay) - decay * m.sum() - len(m), len(m) / mass

    tries = [likelihood(d)[0] for d in np.linspace(0.05, 8, 4000)]
    assert likelihood(curves.decay)[0] >= max(tries) - 0.05
    assert math.isclose(curves.scale, likelihood(curves.decay)[1], rel_tol=1e-6)

    def evidence(n, found):
        chance = max(0.0, math.log(curves.scale * max(n, 1)))
        return math.log1p(sum(max(0.0, curves.decay * s - chance) for s in found))

    x, y = np.array([evidence(n, f) for n, f, _ in rows]), np.array([t for _, _, t in rows])
    gap = 1 / (1 + np.exp(-(curves.curve[0] + curves.curve[1] * x))) - y
    assert curves.curve[1] > 0 and abs(gap.sum()) < 1e-3 and abs((gap * x).sum() + 0.05 * curves.curve[1]) < 1e-2

    for r in toxicity.score(documents, (scores, curves)).collect():
        words = texts[r["doc_id"]].lower().split()
        own = {w: plain_score(w, counts, rate) for w in set(words)}
        value = curves.curve[0] + curves.curve[1] * evidence(len(words), plain_maximal([own[w] for w in words]))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-min(max(value, -30), 30))), rel_tol=1e-6)


# Quality rules


def plain_mcd(x, spread, starts=150, seed=0):
    """Minimum covariance determinant of distinct vectors: many starts, concentrated to the end, then reweighted."""
    rng, n, p = np.random.default_rng(seed), *x.shape
    h = (n + p + 1) // 2

    def fit(part, factor):
        cov = factor * np.cov(part.T, bias=True) + np.diag(spread**2)
        return part.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def far(est):
        gap = x - est[0]
        return np.einsum("ij,jk,ik->i", gap, est[1], gap)

    best = None
    for _ in range(starts):
        est = fit(x[rng.choice(n, p + 1, replace=False)], quality_rules.HALF)
        for _ in range(30):
            following = fit(x[np.argsort(far(est), kind="stable")[:h]], quality_rules.HALF)
            done, est = following[2] >= est[2] - 1e-9, following
            if done:
                break
        if best is None or est[2] < best[2]:
            best = est
    est = fit(x[far(best) <= quality_rules.INNER_CUT], quality_rules.INNER)
    return lambda rows: np.einsum("ij,jk,ik->i", rows - est[0], est[1], rows - est[0])


def plain_vector(text):
    n_words, chars, symbols, dup, repeat, lines, upper, _, marks = textfacts.facts(text)
    words = max(n_words, 1)
    shares = [math.log(max(chars, 1) / words), math.sqrt(symbols / words), math.sqrt(dup / max(lines, 1)),
              math.sqrt(repeat / words), math.sqrt(upper / words), math.sqrt(marks / words)]
    return [round(s, 3) for s in shares], n_words < 50 or 100 * repeat > 50 * n_words


def test_verdicts_equal_those_of_a_plain_estimate(spark):
    rng = np.random.default_rng(5)
    kinds = ["".join(rng.choice(list("aeinrst"), rng.integers(3, 8))) for _ in range(2000)]

    def text(i):
        words = rng.choice(kinds, rng.integers(60, 200)).tolist()
        for k in rng.choice(len(words), rng.integers(0, 12), replace=False):
            words[k] = words[k].capitalize() + rng.choice([",", ".", "", "!"])
        if i % 11 == 0:
            words = [w + rng.choice(["&", "", "", "*%"]) for w in words]  # from nearly ordinary to far off
        if i % 13 == 0:
            words += words[: len(words) // 3]
        return " ".join(words)

    rows = [(i, text(i), "en", "a") for i in range(500)] + [(900 + i, "short one", "en", "a") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    vectors = {i: plain_vector(t) for i, t, _, _ in rows}
    usable = np.unique(np.array([v for v, failed in vectors.values() if not failed]), axis=0)
    distance = plain_mcd(usable, quality_rules.SPREAD)
    d2 = dict(zip(vectors, distance(np.array([v for v, _ in vectors.values()])), strict=True))
    rejected = 0
    for i, (_, failed) in vectors.items():
        assert found[i]["base_failed"] == failed
        if failed:
            assert not found[i]["kept"]
        elif not 0.75 <= d2[i] / quality_rules.CUT <= 1.33:  # the distributed estimate cuts by rings of distance
            assert found[i]["kept"] == (d2[i] <= quality_rules.CUT), (i, d2[i], found[i]["distance2"])
            rejected += d2[i] > quality_rules.CUT
    assert rejected > 10
    both = np.array([(d2[i], found[i]["distance2"]) for i, (_, failed) in vectors.items() if not failed])
    assert np.corrcoef(both.T)[0, 1] > 0.98
