import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quorumlab.llm import annforest, pii, quality_rules, resampling, simhash, textfacts, toxicity
from quorumlab.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_facts(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    runs = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    twice = {j for i in range(len(own) - 2) if runs[tuple(own[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


def test_facts_of_odd_texts(odd_docs):
    for row in odd_docs.collect():
        assert textfacts.facts(row["text"])[:5] == plain_facts(row["text"])
    for text in ("a b c a b c", "a a a a", "x\n\nx\n y", "#* a|b <c>", "a b c d e a b c d e"):
        assert textfacts.facts(text)[:5] == plain_facts(text)


def test_repeats_with_many_kinds_of_words(monkeypatch):
    own = [str(i % 700).encode() for i in range(1500)]
    assert textfacts.repeated_words(own) == 1500


def test_quality_rules_of_odd_documents(odd_docs, no_docs):
    rows = quality_rules.judge(odd_docs).collect()
    expected = sorted((str(r["doc_id"]), *plain_facts(r["text"])) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), *r[1:6]) for r in rows) == expected
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge(no_docs).count() == 0
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_planted_outliers_are_rejected(spark):
    rng = np.random.default_rng(0)
    kinds = ["".join(rng.choice(list("aeinrst"), rng.integers(3, 8))) for _ in range(3000)]

    def text(mark=""):
        return " ".join(w + mark for w in rng.choice(kinds, 120)) + "."

    rows = [(i, text(), "en", "a") for i in range(150)] + [(i, text("*&"), "en", "a") for i in range(150, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(found[i]["kept"] for i in range(150)) and not any(found[i]["kept"] for i in range(150, 200))
    copied = docs.union(docs.filter("doc_id = 0").crossJoin(spark.range(400)).selectExpr("id + 1000 as doc_id", "text", "lang", "source"))
    found = {r["doc_id"]: r for r in quality_rules.judge(copied).collect()}
    assert all(found[i]["kept"] for i in range(150)) and not any(found[i]["kept"] for i in range(150, 200))


def test_block_estimate_ignores_a_minority():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 50, (300, 6)), rng.normal(4000, 50, (120, 6))]).round().astype(int)
    centre, inverse, _ = quality_rules.block_mcd(x, 3)
    assert np.abs(centre).max() < 0.05
    assert abs(quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.5, 6), 6) - 0.5) < 1e-9


def plain_fingerprint(text):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([b" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, budget=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(fps))]


def check_near_duplicates(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    own = plain_components([r["doc_id"] for r in rows], fps)
    expected = sorted((str(r["doc_id"]), f"{fp:016x}", str(c)) for r, fp, c in zip(rows, fps, own, strict=True))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == expected


def test_near_duplicates(odd_docs, no_docs, documents):
    check_near_duplicates(odd_docs)
    check_near_duplicates(documents)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns


def ball(n, bits, seed):
    rng = np.random.default_rng(seed)
    keys = np.full(n, 0x123456789ABCDEF0, np.uint64)
    for _ in range(bits):
        keys ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate([keys, rng.integers(0, 2**63, n // 2).astype(np.uint64)]))


@pytest.mark.parametrize("chunk", [64, 1 << 17])
def test_trie_join_equals_all_pairs(monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    keys = ball(800, 5, chunk)
    found = simhash.trie_links(keys, np.array([0]), np.array([len(keys)]))
    expected = np.arange(len(keys))
    a, b = np.where(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3, 1))
    simhash.merge_labels(expected, a, b)
    assert (found == expected).all()


def test_hot_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    keys = ball(300, 4, 5)
    rows = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.links(rows), "a", "b").collect()}
    expected = np.arange(len(keys))
    a, b = np.where(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3, 1))
    simhash.merge_labels(expected, a, b)
    own = [root.get(int(k), int(k)) for k in keys.view(np.int64)]
    assert len(set(own)) == len(set(expected)) and len(set(zip(own, expected, strict=True))) == len(set(own))


def test_components_of_a_long_path(spark):
    rows = components(spark.range(1, 200).selectExpr("id as a", "id - 1 as b"), "a", "b").collect()
    assert {(r["node"], r["root"]) for r in rows} == {(i, 0) for i in range(1, 200)}


E1 = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I1 = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_spans_are_the_patterns(documents, odd_docs):
    texts = [r["text"] or "" for r in documents.union(odd_docs.select(documents.columns)).collect()]
    texts += ["a@b@c.d e@f.g@h.i", "1.2.3.4.5.6.7.8 1.2.3.256 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 + 1 +12345678 +123456789", "@x.y z@ @@a.b"]
    for text in texts:
        emails, ips, cards, phones = pii.base_spans(text)
        assert emails == [m.span() for m in E1.finditer(text)]
        assert ips == [m.span() for m in I1.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        for a, b in cards:
            assert pii.luhn(pii.digits_of(text[a:b]))
    assert pii.base_spans("1." * 50000 + "9" * 50000)[3] == []


def test_field_finds_what_patterns_miss_and_leaves_clean_text(spark):
    model = pii.train(pii.labelled_table(spark))
    text = "call 415-555-0123 or mail bob [at] example [dot] com; in 1999 there were 2,500 men and x@y.example.org"
    (base, added), = pii.find_spans([text], model)
    assert [text[a:b] for a, b in base[0]] == ["x@y.example.org"]
    assert [text[a:b] for a, b in added[3]] == ["415-555-0123"] and len(added[0]) == 1
    assert pii.masked(text, pii.together(base, added)) == "call <PHONE> or mail <EMAIL>; in 1999 there were 2,500 men and <EMAIL>"


def test_viterbi_equals_all_paths(spark):
    model = pii.train(pii.labelled_table(spark))
    import itertools

    rows = pii.token_features(pii.tokens_of("ring 555 - 01", 0, 13))[:4]
    emit = model.emissions(rows)
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(rows)), key=lambda p: sum(emit[i, x] for i, x in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])))
    assert model.decode([rows])[0] == list(best)


def test_personal_data_of_odd_documents(spark, odd_docs, no_docs):
    model = pii.train(pii.labelled_table(spark))
    rows = pii.find(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and sum(r["n_email"] for r in rows) == 1
    clean = pii.redact(odd_docs, model)
    assert clean.columns == odd_docs.columns and pii.find(no_docs, model).count() == 0
    for r in clean.collect():
        assert "x@y" not in (r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def plain_segments(scores):
    """All maximal segments by their definition: recursive best intervals."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a = -best[2]
    b = a - best[1]
    return plain_segments(scores[:a]) + [(best[0], a, b)] + [(s, x + b, y + b) for s, x, y in plain_segments(scores[b:])]


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = [int(x) for x in rng.integers(-6, 7, rng.integers(0, 14))]
        found = toxicity.segments(scores)
        assert sorted(s for s, _, _ in found) == sorted(s for s, _, _ in plain_segments(scores))
        assert all(sum(scores[a:b]) == s for s, a, b in found)


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs, documents, labels):
    model = toxicity.learn(documents, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.learn(odd_docs, labels.limit(0))
    assert len({r["score"] for r in toxicity.score(odd_docs, nothing).collect()}) == 1


def test_toxic_words_are_learned(spark):
    rng = np.random.default_rng(5)
    kinds = ["w" + str(i) for i in range(400)]
    rows = [(i, " ".join(rng.choice(kinds, 60).tolist() + ["vile", "rotten"] * (i % 5 == 0)), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t.replace("w", "xyz")) for i, t, _ in rows], "doc_id long, text string")
    tags = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.learn(docs, tags, F.col("doc_id") % 4 != 2)).collect()
    assert all((r["score"] >= toxicity.CUT) == (r["doc_id"] % 5 == 0) for r in scored)


def test_resampling_of_odd_documents(odd_docs, no_docs, labels):
    rows = resampling.resample(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert resampling.resample(no_docs, labels).count() == 0
    kept = resampling.keep_drawn(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert all(r["kept"] for r in resampling.resample(odd_docs, labels.limit(0)).collect())


def test_kth_largest(spark):
    values = [5, 5, 1 << 50, 7, 0, (1 << 50) + 1, 5]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [resampling.kth_largest(df, "x", k) for k in range(1, 8)] == sorted(values, reverse=True)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, spot string")


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, x[i].tolist(), 0, "clash") for i in range(300)]
    rows += [(1000, None, 1, ""), (1001, [0.0] * 8, 1, ""), (1002, [float("nan")] * 8, 1, ""), (1003, [1.0, None] + [1.0] * 6, 1, ""), (1004, [1.0], 1, ""), (1005, [], 1, ""), (None, [1.0] * 8, 1, "")]
    rows += [(2000 + i, x[0].tolist(), 0, "") for i in range(30)] + [(5, x[5].tolist(), 0, "")]
    found = annforest.search(vectors_of(spark, rows), F.col("vec_id") % 100 == 0).collect()
    usable = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[0] < 1000 or (r[0] or 0) >= 2000}
    for query in {r["query_id"] for r in found}:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        best = sorted((float(np.sqrt(((v - usable[query]) ** 2).sum())), i) for i, v in usable.items() if i != query)[:10]
        assert [v for _, v, _ in own] == [i for _, i in best]
        assert np.allclose([s for _, _, s in own], [d for d, _ in best], rtol=1e-12, atol=1e-12)
    assert {r["query_id"] for r in found} == {0, 100, 200, 2000}
    assert annforest.search(vectors_of(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    one = vectors_of(spark, [(0, [1.0, 2.0], 0, ""), (7, [1.0, 2.0], 0, "")])
    assert [r["vec_id"] for r in annforest.search(one, F.col("vec_id") % 100 == 0).collect()] == [7]


def test_large_leaves_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(annforest, "BLOCK", 16)
    rows = [(i, [1.0, 0.0, float(i >= 200) * i], 0, "") for i in range(260)]
    found = annforest.search(vectors_of(spark, rows), F.col("vec_id") % 100 == 0, leaf=8).collect()
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 0) == list(range(1, 11))


def test_recall_against_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frame = vectors.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in frame], float), np.array([r["vec_id"] for r in frame])
    found = annforest.search(vectors, F.col("vec_id") % 50 == 0, probes=48, leaf=32).collect()
    hits = total = 0
    for query in ids[ids % 50 == 0]:
        d = ((x - x[ids == query][0]) ** 2).sum(1)
        d[ids == query] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == query})
        total += 10
    assert hits >= 0.9 * total
