"""Divergence of the sources of a language, by K-squared quadtrees over the group-term count matrix.

A group is a language and source.  A first pass counts, by hash of language and term, the documents
that hold a term; the hashes of at least ``MIN_DOCS`` documents are the kept terms, numbered in each
language.  A second pass counts each group's occurrences of these, combined in the task and sent as
arrays, one for each group and block of ``WIDTH`` columns.  It sends the terms themselves too: if two
ever share a hash, both passes are done again with another one, so the counts are exact.  Where the
hashes are too many to be sent to every task, the terms are counted as rows instead.  Groups are dealt
to bands of ``BAND`` rows.  A task holds one tile: the cells of one block and of one or two bands.

In a tile the nonzero cells are a K-squared tree: each node has K x K quadrants, empty ones are not
stored.  For all pairs of rows the tree is traversed jointly.  Where both sides' quadrants are empty,
all terms in it have the same two probabilities, so the quadrant is priced as its number of terms
times one term's value; otherwise the traversal goes on, to cells.  A tile's result is one sum per
pair of rows, and each row's best terms against the language.  Memory is bounded by the tile.

Exact: counts are integers, probabilities are long division to nine digits, values fit 64 bits.

Null text, language and source are ''.  Groups without kept terms have the probabilities of zero
counts; a language without kept terms gives pairs of value 0 and no terms.  Repeated rows are
documents each; document keys are not used, so null ones do no harm.  Texts of any length are read
whole.  Ties stand in the order of the item's bytes.  Other columns are ignored.  An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.llm import frames
from quorumlab.llm.memo import working_for
from quorumlab.operators.joins import join_checked
from quorumlab.session import cut_lineage, scratch_path

MIN_DOCS, TOP = 10, 10
#: Each level of the tree cuts rows and columns into this many parts.
K = 4
#: Rows of a band, a power of K, and columns of a block.
BAND, WIDTH = 64, 2048
#: Pairs of quadrants that are expanded at a time.
FRONTIER = 1 << 16
#: Distinct terms of groups or languages that a task holds before it sends them on.
HELD = 300_000
#: Hashes of kept terms that are sent to every task at most (32 MB).
SENT_HASHES = 4_000_000
#: Bytes that end a term become blanks, A-Z small letters; UTF-8 bytes of other characters stay.
TERM_BYTES = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def _hashes(lang: str, terms: Iterable[bytes], seed: int) -> np.ndarray:
    digest, own = xxhash.xxh64_intdigest, zlib.crc32(lang.encode()) + (seed << 32)
    return np.fromiter((digest(t, own) for t in terms), np.uint64)


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode()) - (1 << 63)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def frequent_hashes(docs: DataFrame, min_docs: int, seed: int = 0) -> DataFrame:
    """``l, h``: hashes of language and term that stand for ``min_docs`` documents or more.

    Most terms are rare; here each costs three numbers of shuffle.
    """

    def sent(langs):
        sizes = list(map(len, langs.values()))
        columns = [
            np.repeat([_lang_hash(lang) for lang in langs], sizes),
            np.concatenate([_hashes(lang, d, seed) for lang, d in langs.items()]).view(np.int64),
            np.concatenate([np.fromiter(d.values(), np.int64, len(d)) for d in langs.values()]),
        ]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["l", "h", "docs"])

    def run(batches):
        working_for("terms")
        langs: dict[str, Counter] = {}
        for part in frames.slices(batches, 64):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                langs.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, langs.values())) >= HELD:
                yield sent(langs)
                langs = {}
        if langs:
            yield sent(langs)

    held = _slim(docs).select("text", "lang").mapInArrow(run, "l bigint, h bigint, docs bigint")
    return held.groupBy("l", "h").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("l", "h")


#: Kinds of rows that the second pass sends: a group's counts, its language's, a kept term.
GROUP, LANGUAGE, TERM = range(3)
_PACKED = "kind int, lang string, source string, block int, columns array<int>, counts array<bigint>, term string"


def packed_counts(docs: DataFrame, kept: Broadcast, seed: int) -> DataFrame:
    """Counts of the kept terms by group and by language, in arrays, and the terms with their columns.

    ``kept`` has the sorted hashes of each language by its own hash; a term's column is its place
    there.  Every group has a row with block -1, also one without kept terms.
    """

    def cut(kind, lang, source, columns, counts):
        edges = [0, *(np.flatnonzero(np.diff(columns // WIDTH)) + 1).tolist(), len(columns)]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield kind, lang, source, int(columns[start] // WIDTH), columns[start:end] % WIDTH, counts[start:end], None

    def sent(groups, seen):
        rows, whole = [], {}
        for (lang, source), n in groups.items():
            known, hashes = kept.value.get(_lang_hash(lang), np.zeros(0, np.uint64)), _hashes(lang, n, seed)
            at = np.searchsorted(known, hashes)
            hit = np.flatnonzero(at < len(known))
            hit = hit[known[at[hit]] == hashes[hit]]
            hit = hit[np.argsort(at[hit], kind="stable")]
            columns, counts = at[hit], np.fromiter(n.values(), np.int64, len(n))[hit]
            rows.append((GROUP, lang, source, -1, [], [], None))
            rows += cut(GROUP, lang, source, columns, counts)
            total = whole.setdefault(lang, np.zeros(len(known), np.int64))
            np.add.at(total, columns, counts)
            # A term is sent when its column has not been sent with this checksum: two that share one both are.
            terms = list(map(list(n).__getitem__, hit.tolist()))
            marks = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) + 1
            last = seen.setdefault(lang, np.zeros(len(known), np.int64))
            for i in np.flatnonzero(last[columns] != marks).tolist():
                column = int(columns[i])
                rows.append((TERM, lang, None, column // WIDTH, [column % WIDTH], None, terms[i].decode()))
            last[columns] = marks
        for lang, total in whole.items():
            some = np.flatnonzero(total)
            rows += cut(LANGUAGE, lang, None, some, total[some])
        types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
        names = ["kind", "lang", "source", "block", "columns", "counts", "term"]
        for start in range(0, len(rows), 10_000):
            part = zip(*rows[start : start + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names)

    def run(batches):
        working_for("terms")
        groups: dict = {}
        seen: dict = {}
        for part in frames.slices(batches, 64):
            for text, lang, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                groups.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, groups.values())) >= HELD:
                yield from sent(groups, seen)
                groups = {}
        if groups:
            yield from sent(groups, seen)

    return _slim(docs).mapInArrow(run, _PACKED)


def merged(packed: DataFrame) -> DataFrame:
    """One row for each group or language and block: ``kind, lang, source, block, columns, counts``.

    Rows come sorted, so one block of one group is held at a time, however many tasks sent some of it.
    """
    by = ["kind", "lang", "source", "block"]

    def run(batches):
        working_for("terms")
        key, total = None, np.zeros(WIDTH, np.int64)

        def done():
            some = np.flatnonzero(total)
            row = dict(zip(by, key, strict=True)) | {"columns": some.astype(np.int32), "counts": total[some]}
            types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if key is not None and keys[start] != key:
                    yield done()
                    total[:] = 0
                key, part = keys[start], batch.slice(start, end - start)
                np.add.at(total, part.column("columns").flatten().to_numpy(), part.column("counts").flatten().to_numpy())
                start = end
        if key is not None:
            yield done()

    sorted_rows = packed.select(*by, "columns", "counts").repartition(*by).sortWithinPartitions(*by)
    return sorted_rows.mapInArrow(run, _PACKED.rsplit(",", 1)[0])


def _by_hash(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Groups, packed cells and terms by way of sent hashes; None where these are too many."""
    spark, seed = docs.sparkSession, 0
    while True:
        hashes = cut_lineage(frequent_hashes(docs, min_docs, seed))
        n = hashes.count()
        if n > SENT_HASHES:
            return None
        found = hashes.toArrow()
        l, h = (found.column(c).to_numpy() for c in ("l", "h"))
        kept = spark.sparkContext.broadcast({int(x): np.sort(h[l == x].view(np.uint64)) for x in np.unique(l)})
        path = scratch_path(spark, "terms")
        packed_counts(docs, kept, seed).write.parquet(path)
        sent = spark.read.parquet(path)
        terms = cut_lineage(sent.filter(F.col("kind") == TERM).select("lang", "block", F.col("columns")[0].alias("column"), "term").distinct())
        if terms.count() == n:
            groups = sent.filter((F.col("kind") == GROUP) & (F.col("block") < 0)).select("lang", "source").distinct()
            return groups, cut_lineage(merged(sent.filter((F.col("kind") != TERM) & (F.col("block") >= 0)))), terms
        seed += 1  # two terms share a hash


def _by_rows(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three tables with a row for each group and term that a task holds."""

    def sent(groups):
        langs, sources, terms, ns, held = [], [], [], [], []
        for (lang, source), (n, d) in groups.items():
            langs += [lang] * (len(n) + 1)
            sources += [source] * (len(n) + 1)
            terms += [b"", *n]
            ns += [0, *n.values()]
            held += [0, *map(d.__getitem__, n)]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip((langs, sources, terms, ns, held), kinds, strict=True)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches):
        working_for("terms")
        groups: dict = {}
        for part in frames.slices(batches, 64):
            for text, lang, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                words = terms_of(text)
                n.update(words)
                d.update(set(words))
            if sum(len(n) for n, _ in groups.values()) >= HELD:
                yield sent(groups)
                groups = {}
        if groups:
            yield sent(groups)

    found = _slim(docs).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    counts = cut_lineage(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    sizes = words.groupBy("lang").agg(F.ceil(F.count("*") / (WIDTH // 2)).alias("blocks"))  # hashing leaves room
    dealt = words.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    terms = cut_lineage(dealt.select("lang", "block", place.alias("column"), "term"))
    cells = cut_lineage(counts.join(terms, ["lang", "term"]).select("lang", "source", "block", "column", "n"))
    whole = cells.groupBy("lang", F.lit(None).cast("string").alias("source"), "block", "column").agg(F.sum("n").alias("n"))
    packed = []
    for kind, rows in ((GROUP, cells), (LANGUAGE, whole)):
        own = rows.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("column", "n"))).alias("c"))
        packed.append(own.select(F.lit(kind).alias("kind"), "lang", "source", "block", F.col("c.column").alias("columns"), F.col("c.n").alias("counts")))
    return counts.filter("term = ''").select("lang", "source"), cut_lineage(packed[0].unionByName(packed[1])), terms


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / whole), in three steps of long division: no overflow below 2**53."""
    rest, found = np.asarray(counts, np.int64) + 2, 0
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + digits
    return found + 1


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


class QuadTree:
    """The nonzero cells of a matrix; ``levels[0]`` has one node for each ``BAND`` x ``BAND`` square.

    A level's ``child`` array gives, for each node and quadrant, the node of the next level, or -1
    where the quadrant is empty; nodes of the last level are cells, in the order of ``row, column``.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, bands: int, width: int):
        self.across = max(1, -(-width // BAND))
        side, codes = BAND, self._code(rows, columns, BAND)
        self.top = np.full((bands, self.across), -1, np.int64)
        squares = np.unique(codes)
        self.top[squares >> 32, squares & 0xFFFFFFFF] = np.arange(len(squares))
        self.levels, parents, node = [], squares, np.searchsorted(squares, codes)
        while side > 1:
            side //= K
            quadrant = rows // side % K * K + columns // side % K
            found, place = np.unique(node * (K * K) + quadrant, return_inverse=True)
            child = np.full((len(parents), K * K), -1, np.int64)
            child[found // (K * K), found % (K * K)] = np.arange(len(found))
            self.levels.append(child.reshape(-1, K, K))
            parents, node = found, place
        self.cells = node

    @staticmethod
    def _code(rows, columns, side):
        return (rows // side).astype(np.int64) << 32 | columns // side

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        found = self.levels[level][np.maximum(nodes, 0)]
        return np.where(nodes[:, None, None] >= 0, found, -1)


def pair_sums(rows: np.ndarray, columns: np.ndarray, p: np.ndarray, zero: np.ndarray, bands: list[int], width: int) -> np.ndarray:
    """The sums of values of all pairs (first band's rows x last band's), of which those above the diagonal count.

    ``zero`` has the probability of a zero count of each row, ``bands`` the number of rows of each band.
    """
    tree = QuadTree(rows, columns, len(bands), width)
    of_cell = np.empty(len(p), np.int64)
    of_cell[tree.cells] = p
    last = (len(bands) - 1) * BAND
    left, right = zero[: bands[0]], zero[last : last + bands[-1]]
    apart = values(left[:, None], right[None, :])
    sums, same = np.zeros(apart.shape, np.int64), len(bands) == 1

    def price(a, b, c, side):
        """Quadrants that are empty on both sides: their terms times the value of two zero counts."""
        terms = np.clip(width - c * side, 0, side)
        quads = np.zeros((-(-len(left) // side), -(-len(right) // side)), np.int64)
        np.add.at(quads, (a, b), terms)
        spread = quads.repeat(side, 0)[: len(left)].repeat(side, 1)[:, : len(right)]
        np.add(sums, spread * apart, out=sums)

    squares = np.arange(tree.across)
    nodes = tree.top[0], tree.top[-1]
    none = (nodes[0] < 0) & (nodes[1] < 0)
    origin = np.zeros(int(none.sum()), np.int64)
    price(origin, origin, squares[none], BAND)
    square = squares[~none]
    stack = [(0, BAND, np.zeros(len(square), np.int64), np.zeros(len(square), np.int64), square, nodes[0][~none], nodes[1][~none])]
    while stack:
        level, side, a, b, c, left_node, right_node = stack.pop()
        if len(a) > FRONTIER // K**3:
            half = len(a) // 2
            for part in (slice(None, half), slice(half, None)):
                stack.append((level, side, *(x[part] for x in (a, b, c, left_node, right_node))))
            continue
        side //= K
        shape = (len(a), K, K, K)
        steps = np.arange(K)
        grown = [
            np.broadcast_to(a[:, None, None, None] * K + steps[None, :, None, None], shape),
            np.broadcast_to(b[:, None, None, None] * K + steps[None, None, :, None], shape),
            np.broadcast_to(c[:, None, None, None] * K + steps[None, None, None, :], shape),
            np.broadcast_to(tree.children(level, left_node)[:, :, None, :], shape),
            np.broadcast_to(tree.children(level, right_node)[:, None, :, :], shape),
        ]
        a, b, c, left_node, right_node = (x.reshape(-1) for x in grown)
        real = (a * side < len(left)) & (b * side < len(right)) & (c * side < width)
        if same:
            real &= a < b if side == 1 else a <= b
        empty = real & (left_node < 0) & (right_node < 0)
        price(a[empty], b[empty], c[empty], side)
        going = real & ~empty
        a, b, c, left_node, right_node = (x[going] for x in (a, b, c, left_node, right_node))
        if side > 1:
            if len(a):
                stack.append((level + 1, side, a, b, c, left_node, right_node))
            continue
        own = np.where(left_node >= 0, of_cell[np.maximum(left_node, 0)] if len(p) else 0, left[a])
        other = np.where(right_node >= 0, of_cell[np.maximum(right_node, 0)] if len(p) else 0, right[b])
        np.add.at(sums, (a, b), values(own, other))
    return sums


def best_terms(rows: np.ndarray, p: np.ndarray, q: np.ndarray, words: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """``(row, cell, value)`` of each row's cells above the language's share, the best ``top`` of a row."""
    f = np.where(p > q, values(p, q), -1)
    order = np.lexsort((words, -f, rows))
    order = order[f[order] >= 0]
    starts = np.searchsorted(rows[order], rows[order])
    order = order[np.arange(len(order)) - starts < top]
    return list(zip(rows[order].tolist(), order.tolist(), f[order].tolist(), strict=True))


def tile_results(tile: pa.Table, top: int) -> pa.Table:
    """Sums of the pairs and best terms of the rows of one tile.

    A row of the tile is a group with its cells, the language with its own (``gid`` -1), or the
    language's terms (-2).
    """
    data = tile.select(["gid", "whole", "columns", "counts", "terms"]).to_pylist()
    lang, i, j = (tile.column(c)[0].as_py() for c in ("lang", "i", "j"))
    language, named = (next((r for r in data if r["gid"] == gid), None) for gid in (-1, -2))
    places = np.array(language["columns"] if language else [], np.int64)
    width = len(places)
    groups = sorted((r for r in data if r["gid"] >= 0), key=lambda r: r["gid"])
    bands = [sum(r["gid"] // BAND == band for r in groups) for band in sorted({i, j})]
    row = {r["gid"]: r["gid"] % BAND + BAND * (i != j and r["gid"] // BAND == j) for r in groups}
    rows = np.repeat([row[r["gid"]] for r in groups], [len(r["columns"] or ()) for r in groups]).astype(np.int64)
    columns = np.searchsorted(places, np.array([c for r in groups for c in r["columns"] or ()], np.int64))
    counts = np.array([n for r in groups for n in r["counts"] or ()], np.int64)
    whole = np.ones(BAND * len(bands), np.int64)
    for r in groups:
        whole[row[r["gid"]]] = max(r["whole"], 1)
    zero, p = shares(np.zeros(len(whole), np.int64), whole), shares(counts, whole[rows])
    sums = pair_sums(rows, columns, p, zero, bands, width)
    pairs = [(a, b) for a in range(sums.shape[0]) for b in range(a + 1 if i == j else 0, sums.shape[1])]
    out = [(i * BAND + a, j * BAND + b, None, int(sums[a, b])) for a, b in pairs]
    if i == j and width:
        q, words = shares(np.array(language["counts"], np.int64), language["whole"]), np.empty(width, object)
        words[np.searchsorted(places, named["columns"])] = [t.encode() for t in named["terms"]]
        rank = np.empty(width, np.int64)
        rank[sorted(range(width), key=words.__getitem__)] = np.arange(width)
        for r, cell, value in best_terms(rows, p, q[columns], rank[columns], top):
            out.append((i * BAND + r, -1, words[columns[cell]].decode(), value))
    a, b, items, found = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()),
        "item": pa.array(items, pa.string()), "value": pa.array(found, pa.int64()),
    })


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources by divergence, and each group's telling terms."""
    found, cells, terms = _by_hash(docs, min_docs) or _by_rows(docs, min_docs)
    by_lang = Window.partitionBy("lang")
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    totals = cut_lineage(cells.groupBy("kind", "lang", "source").agg(F.sum(whole).alias("n")))
    # One row a language: its terms, their occurrences, blocks and bands.
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), (F.max("block") + 1).alias("blocks"))
    langs = found.groupBy("lang").agg(F.ceil(F.count("*") / BAND).alias("bands")).join(sizes, "lang", "left").fillna(0, ["v"]).fillna(1, ["blocks"])
    langs = langs.join(totals.filter(F.col("kind") == LANGUAGE).select("lang", F.col("n").alias("lang_n")), "lang", "left").fillna(0, ["lang_n"])
    langs = cut_lineage(langs)
    n_langs = langs.count()
    numbered = found.withColumn("gid", F.row_number().over(by_lang.orderBy("source")) - 1)
    own = totals.filter(F.col("kind") == GROUP).select("lang", "source", F.col("n").alias("group_n"))
    groups = cut_lineage(numbered.join(own, ["lang", "source"], "left").fillna(0, ["group_n"]))
    sized = join_checked(groups, langs, ["lang"], n_langs).withColumn("whole", F.col("group_n") + 2 * F.col("v"))

    # Rows of the tiles: each group in each block, with its cells there, and the language's cells and terms.
    heads = sized.select("lang", "source", "gid", "whole", "bands", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    heads = heads.join(cells.filter(F.col("kind") == GROUP).drop("kind"), ["lang", "source", "block"], "left")
    band = F.floor(F.col("gid") / BAND).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)).alias("other")
    no_terms = F.lit(None).cast("array<string>").alias("terms")
    rows = heads.select("*", band.alias("band"), other).select(
        "lang", "block", F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j"), "gid", "whole", "columns", "counts", no_terms
    )
    named = terms.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("column", "term"))).alias("c"))
    named = named.select("lang", "block", F.lit(-2).alias("gid"), F.col("c.column").alias("columns"), F.lit(None).cast("array<bigint>").alias("counts"),
                         F.col("c.term").alias("terms"))
    spoken = cells.filter(F.col("kind") == LANGUAGE).select("lang", "block", F.lit(-1).alias("gid"), "columns", "counts", no_terms)
    own = join_checked(spoken.unionByName(named), langs.select("lang", "bands", (F.col("lang_n") + 2 * F.col("v")).alias("whole")), ["lang"], n_langs)
    tiles = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("bands") - 1),
        lambda x: F.transform(F.sequence(x, F.col("bands") - 1), lambda y: F.struct(x.alias("i"), y.alias("j"))),
    ))).alias("tile")
    own = own.select("*", tiles).select("lang", "block", "tile.i", "tile.j", "gid", "whole", "columns", "counts", "terms")
    done = rows.unionByName(own).groupBy("lang", "block", "i", "j").applyInArrow(
        lambda tile: tile_results(tile, top), "lang string, a int, b int, item string, value bigint"
    )
    done = cut_lineage(done)

    names = groups.select("lang", F.col("gid").alias("a"), "source")
    sums = done.filter("b >= 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair"), "value")
    pairs = both.select("lang", "pair.a", "pair.b", "value").join(names, ["lang", "a"])
    pairs = pairs.join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    terms = done.filter("b < 0").join(names, ["lang", "a"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(terms.select(*columns))
