"""The manifest, line deduplication and source audit against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from quorumlab.llm import divergence, linededup, merkle
from quorumlab.llm.perfecthash import PerfectHash

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def plain_lines(rows):
    blanks = "\x20\t\n\x0b\x0c\r"
    held = defaultdict(list)
    for key, text in rows:
        keys = {line.strip(blanks).translate(ASCII_LOWER) for line in (text or "").split("\n")}
        for k in keys:
            held[k].append(key)
    out = []
    for key, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            k = line.strip(blanks).translate(ASCII_LOWER)
            ids = [i for i in held[k] if i is not None]
            if not (len(k) >= 20 and len(held[k]) >= 3 and key != max(ids, default=None)):
                kept.append(line)
        out.append((str(key), len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


LINES = [
    (1, "A shared line of many words\nown line of the first document\n"),
    (2, "  a SHARED line of many words\t\r\nshort\nshort"),
    (3, "x\n\x0bA shared line of many words\x0c\na shared line of many words"),
    (3, "x\n\x0bA shared line of many words\x0c\na shared line of many words"),
    (None, "A shared line of many words"),
    (4, "Ünïcödé line of twenty\nünïcödé line of 日本日本日"),
    (5, "ünïcödé line of twenty\nÜnïcödé line of 日本日本日"),
    (6, "Ünïcödé line of twenty\nünïcödé line of 日本日本日"),
    (7, "Ünïcödé line of twenty\n日本日本日本日本日本日本日本日本日本日"),
    (8, "日本日本日本日本日本日本日本日本日本日\n日本日本日本日本日本日本日本日本日本日本"),
    (9, "日本日本日本日本日本日本日本日本日本日\n日本日本日本日本日本日本日本日本日本日本"),
    (10, "日本日本日本日本日本日本日本日本日本日本\n" * 3),
    (None, "a line that only rows without a key hold"),
    (None, "a line that only rows without a key hold"),
    (None, "a line that only rows without a key hold\n\n"),
    (11, "\n"), (12, None), (13, ""), (14, "Nul \x00 in a line of some length\n" * 2), (-5, "Nul \x00 in a line of some length"), (15, "Nul \x00 in a line of some length"),
]


def found_lines(docs, **more):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.report(docs, **more).collect())


@pytest.mark.parametrize("sent", [linededup.SENT_BYTES, 0])
def test_lines_equal_the_plain_version(spark, odd_docs, no_docs, documents, monkeypatch, sent):
    monkeypatch.setattr(linededup, "SENT_BYTES", sent)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 7)
    monkeypatch.setattr(linededup, "SHARD_REQUESTS", 3)
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    assert found_lines(docs) == plain_lines(LINES)
    for table in (odd_docs, documents):
        assert found_lines(table) == plain_lines([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
    assert linededup.report(no_docs).count() == 0


def test_kept_lines_stay_with_their_rows(spark, odd_docs, no_docs):
    kept = linededup.keep_lines(odd_docs)
    assert kept.columns == odd_docs.columns and linededup.keep_lines(no_docs).count() == 0
    assert kept.schema["doc_id"].dataType == odd_docs.schema["doc_id"].dataType
    docs = spark.createDataFrame(LINES, "doc_id int, text string").withColumn("_rest", F.lit("clash"))
    found = Counter((r["doc_id"], r["text"], r["_rest"]) for r in linededup.keep_lines(docs).collect())
    assert found[(1, "own line of the first document\n", "clash")] == 1 and found[(12, None, "clash")] == 1
    # Both rows of the largest key keep their lines.
    assert found[(3, LINES[2][1], "clash")] == 2


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000, 200_000])
def test_perfect_hash_is_minimal_and_survives_bytes(n):
    rng = np.random.default_rng(n)
    low, high = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    if n > 2:
        low[:3] = low[0]  # equal halves are told apart by the others
    table = PerfectHash.of(low, high)
    assert sorted(table.index(low, high).tolist()) == list(range(n))
    if n:
        again = PerfectHash.from_bytes(table.to_bytes())
        assert (again.index(low, high) == table.index(low, high)).all()
        assert len(table.to_bytes()) * 8 <= 6 * n + 4096
    others = table.index(low[::-1].copy(), ~high)
    assert others.max(initial=-1) < max(n, 1)


# Manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, hit):
    def build(nodes):
        levels = [list(nodes)]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
        return levels

    def path(levels, i):
        steps = []
        for level in levels[:-1]:
            a = i // 16 * 16
            steps.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
            i //= 16
        return steps

    def leaf(r, low=False):
        text = r[4].translate(ASCII_LOWER) if low and r[4] is not None else r[4]
        return sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = build([leaf(r) for r in by_source[s]])
    top = build([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            steps = path(trees[s], i) + path(top, j)
            root = leaf(r, hit(r[0]))
            for left, right in steps:
                root = sha(left + root + right)
            out.append((str(r[0]), leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), root))
    return sorted(out)


def five(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


def found_manifest(docs):
    rows = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = rows.withColumn("p", merkle.digest(merkle.proof(F.col("path")))).collect()
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["p"], r["folded_root"]) for r in rows)


def fields_of(docs):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]


def test_manifest_equals_the_plain_version(spark, odd_docs, no_docs, documents):
    assert merkle.manifest(no_docs).count() == 0
    for docs in (odd_docs, documents, odd_docs.limit(1)):
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # limit() is not stable
        assert found_manifest(docs) == plain_manifest(fields_of(docs), five)


def test_manifest_of_deep_and_many_sources(spark):
    deep = [(i, "one", "en", i, f"TEXT {i}") for i in range(-20, 4200)] + [(i, "two", None, None, None) for i in range(257)]
    wide = [(i, f"s{i % 300}", "en", 1, "A" * (i % 3)) for i in range(900)] + [(0, None, "en", 1, "É")]
    for rows in (deep, wide):
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert found_manifest(docs) == plain_manifest(rows, five)


def test_only_ascii_letters_are_lowered(spark):
    row = spark.createDataFrame([("ABZ É İ ẞ @[`{",), ("PLAIN ascii @[",)], "t string").select(merkle.ascii_lower(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in row] == ["abz É İ ẞ @[`{", "plain ascii @["]


# Sources


def plain_audit(rows, min_docs=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(ASCII_LOWER))
        groups[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        every = Counter()
        for c in own.values():
            every.update(c)

        def share(c, kept=kept):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(every)
        for s in own:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // (p[s][t] + p[x][t]) for t in kept)) for x in own if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


def found_audit(docs, **more):
    return sorted(tuple(r) for r in divergence.audit(docs, **more).collect())


def test_audit_equals_the_plain_version(odd_docs, no_docs, documents):
    assert divergence.audit(no_docs).count() == 0
    for docs, least in ((odd_docs, 10), (odd_docs, 1), (documents, 10)):
        rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
        assert found_audit(docs, min_docs=least) == plain_audit(rows, least)


@pytest.mark.parametrize("sent", [0, divergence.SENT_HASHES])
def test_audit_of_many_sources_and_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(divergence, "SENT_HASHES", sent)
    monkeypatch.setattr(divergence, "WIDTH", 90)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "FRONTIER", 1 << 9)
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(400)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), "en", f"s{i % 140}") for i in range(900)]
    rows += [("Été été Xx", "fr", "a"), ("xx", "fr", "b"), (None, "fr", None), ("", "de", "only")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found_audit(docs, min_docs=2) == plain_audit(rows, 2)


def test_shares_divide_exactly():
    rng = np.random.default_rng(4)
    whole = rng.integers(1, 2**52, 500)
    counts = (rng.random(500) * whole).astype(np.int64) - 2
    assert shares_list(counts, whole) == [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(counts, whole, strict=True)]


def shares_list(counts, whole):
    return divergence.shares(counts, whole).tolist()


@pytest.mark.parametrize("bands", [[5], [64], [64, 9]])
def test_joint_traversal_equals_the_dense_sum(bands, monkeypatch):
    monkeypatch.setattr(divergence, "FRONTIER", 1 << 10)
    rng = np.random.default_rng(len(bands))
    width, high = 150, 128 if len(bands) == 2 else 64
    real = np.zeros(high, bool)
    for i, n in enumerate(bands):
        real[i * 64 : i * 64 + n] = True
    dense = np.zeros((high, width), np.int64)
    dense[real] = rng.integers(0, 9, (int(real.sum()), width)) * (rng.random((int(real.sum()), width)) < 0.05)
    whole = np.maximum(dense.sum(1) + 2 * width, 1)
    rows, columns = np.nonzero(dense)
    p = divergence.shares(dense, whole[:, None])
    zero = divergence.shares(np.zeros(high, np.int64), whole)
    sums = divergence.pair_sums(rows, columns, p[rows, columns], zero, bands, width)
    last = 64 * (len(bands) - 1)
    for a in range(bands[0]):
        for b in range(bands[-1]):
            if len(bands) == 2 or a < b:
                assert sums[a, b] == divergence.values(p[a], p[last + b]).sum()
