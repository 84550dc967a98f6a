"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has the majority bit over the XXH64 values of its word shingles.
Fingerprints link at ``BUDGET`` or fewer differing bits, and documents that link, directly or
through others, form a component.

Equal fingerprints are one row before any join.  Two fingerprints with at most three differing
bits agree on one quarter of their bits, so the join is dealt out by (quarter, its bits); a
group of more than ``GROUP_ROWS`` fingerprints is dealt again by a quarter of the bits left,
which loses no link for the same reason.  In a group the trie of its fingerprints is joined with
itself: node pairs are traversed together, the bits in which they differ add up, and a pair is
dropped when they exceed the budget or when all it could link is linked already.  Groups give
links to one member each, never all pairs, and :mod:`components` joins what groups share.

Null and empty texts have the fingerprint zero and link like any other.  A null ``doc_id`` gets a
component but never names one.  Rows that repeat a ``doc_id`` each get a row.  Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm import frames
from quorumlab.llm.components import components
from quorumlab.llm.memo import working_for
from quorumlab.session import cut_lineage

WORDS, SEED, BUDGET = 3, 42, 3
GROUP_ROWS = 20_000
#: Bits of a quarter at each dealing: of 64, of the 48 left, of the 36 left.
DEALS = (16, 12, 9)
#: Rows of whole groups that a task joins at a time; node pairs that it expands at a time.
BUFFER_ROWS, CHUNK = 60_000, 1 << 17
#: Node pairs with at most so many fingerprint pairs below them are compared outright.
SMALL = 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the shingles' hashes, repeats included; zero without words."""
    if not text:
        return 0
    tokens = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else iter([b" ".join(tokens)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n).astype(">u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long)."""

    def make():
        working_for("fingerprints")
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return frames.map_texts(docs, make, "fp bigint", key, text)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]``; labels are the smallest index of the set."""
    while True:
        left, right = labels[a], labels[b]
        apart = left != right
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


class Trie:
    """Nodes of the binary tries over ranges of 64-bit keys, each range sorted and distinct.

    A node at depth ``d`` is a run of keys with the same first ``d`` bits.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.ones: dict[int, np.ndarray] = {}

    def middles(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the keys with a one at bit ``depth`` begin in each node."""
        if depth not in self.ones:
            bits = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])
        before = self.ones[depth]
        return high - (before[high] - before[low])


def trie_links(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET, also=None) -> np.ndarray:
    """Labels of linked sets, within each range of sorted distinct 64-bit ``keys``.

    A label is the smallest index of its set.  ``also(i, j)``, if given, must hold for a link.
    """
    trie, labels = Trie(keys), np.arange(len(keys))
    changes = np.arange(len(keys))  # label changes up to each key: equal at both ends of a run of one set
    many = ends - starts > 1
    low, high = starts[many], ends[many]
    stack = [(0, (low, high, low, high, np.zeros(len(low), np.int8)))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > CHUNK:
            stack.append((depth, tuple(p[CHUNK:] for p in pairs)))
            pairs = tuple(p[:CHUNK] for p in pairs)
        al, ah, bl, bh, differ = pairs
        linked = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (labels[al] == labels[bl])
        al, ah, bl, bh, differ = (p[~linked] for p in pairs)
        small = (ah - al) * (bh - bl) <= SMALL
        if small.any():
            i, j = _below(al[small], ah[small], bl[small], bh[small])
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if also is not None:
                near &= also(i, j)
            if near.any():
                merge_labels(labels, i[near], j[near])
                changes[1:] = np.cumsum(labels[1:] != labels[:-1])
        al, ah, bl, bh, differ = (p[~small] for p in (al, ah, bl, bh, differ))
        if not len(al):
            continue
        am, bm = trie.middles(al, ah, depth), trie.middles(bl, bh, depth)
        two = al != bl
        children = [
            (al, am, bl, bm, differ),
            (am, ah, bm, bh, differ),
            (al, am, bm, bh, differ + 1),
            tuple(p[two] for p in (am, ah, bl, bm, differ + 1)),
        ]
        kept = [(c[0] < c[1]) & (c[2] < c[3]) & (c[4] <= budget) for c in children]
        stack.append((depth + 1, tuple(np.concatenate([c[i][k] for c, k in zip(children, kept, strict=True)]) for i in range(5))))
    return labels


def _below(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All key pairs below node pairs."""
    wide, count = bh - bl, (ah - al) * (bh - bl)
    owner = np.repeat(np.arange(len(al)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return al[owner] + place // wide[owner], bl[owner] + place % wide[owner]


def _group_links(budget: int):
    """Links of each fingerprint to the first of its set, for rows that come by ``deal, fp``."""

    def joined(deal: np.ndarray, turn: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        raw, turns = fps.view(np.uint64), turn.astype(np.uint64)
        keys = (raw << turns) | ((raw >> np.uint64(1)) >> (np.uint64(63) - turns))  # the shared bits lead
        order = np.lexsort((keys, deal))
        deal, keys, fps = deal[order], keys[order], fps[order]
        starts = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]]))
        labels = trie_links(keys, starts, np.append(starts[1:], len(keys)), budget)
        hung = labels != np.arange(len(labels))
        return pa.RecordBatch.from_arrays([pa.array(fps[hung]), pa.array(fps[labels[hung]])], ["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= BUFFER_ROWS:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last group may go on
                if whole:
                    yield joined(*rows[:, :whole])
                held, n = [rows[:, whole:]], n - whole
        if n:
            yield joined(*np.concatenate(held, axis=1))

    return run


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` within ``budget`` bits."""
    if budget > 3:
        raise ValueError("quarters of the bits find at most three differing bits")
    dealt, width, found = distinct.select("fp", F.lit(0).cast("long").alias("deal"), F.lit(0).cast("long").alias("turn"), F.col("fp").alias("rest")), 64, None
    for level, bits in enumerate(DEALS):
        quarters = F.explode(F.array(*[F.lit(q).cast("long") for q in range(4)])).alias("q")
        dealt = dealt.select("fp", "deal", "turn", "rest", quarters)
        share = F.expr(f"shiftrightunsigned(rest, cast({width} - {bits} * (q + 1) as int)) & {(1 << bits) - 1}L")
        low = F.expr(f"rest & (shiftleft(1L, cast({width} - {bits} * (q + 1) as int)) - 1L)")
        high = F.expr(f"if(q = 0, 0L, shiftleft(shiftrightunsigned(rest, cast({width} - {bits} * q as int)), cast({width} - {bits} * (q + 1) as int)))")
        turn = F.col("q") * bits if level == 0 else F.col("turn")
        dealt = dealt.select(
            "fp", (((F.col("deal") * 4 + F.col("q")) * (1 << bits)) + share).alias("deal"), turn.alias("turn"), (low.bitwiseOR(high)).alias("rest")
        )
        width -= bits
        large = None
        if level + 1 < len(DEALS):
            large = cut_lineage(dealt.groupBy("deal").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS).select("deal"))
            large = large if large.count() else None
        ready = dealt if large is None else dealt.join(large, "deal", "left_anti")
        own = ready.select("deal", "turn", "fp").repartition("deal").sortWithinPartitions("deal").mapInArrow(_group_links(budget), "a bigint, b bigint")
        found = own if found is None else found.union(own)
        if large is None:
            return found
        dealt = dealt.join(large, "deal", "left_semi")
    return found


def _placed(distinct: DataFrame, budget: int) -> DataFrame:
    """``distinct`` fingerprints ``fp`` with the ``root`` of their component."""
    member = components(links(distinct, budget), "a", "b")
    member = member.union(member.select(F.col("root").alias("node"), "root").distinct())
    return distinct.join(member, distinct["fp"] == member["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest ``doc_id`` that links reach."""
    marked = cut_lineage(fingerprints(docs, words, key, text))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    placed = _placed(distinct, budget)
    smallest = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = cut_lineage(placed.join(smallest, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the smallest key, and with the columns of ``docs``.

    A row without a key is kept only if no row of its component has one.
    """
    slim = frames.keyed_texts(docs, key, text).withColumn("node", frames.text_key(F.col("text")))
    marked = cut_lineage(fingerprints(slim, words, "node").select(F.col("doc_id").alias("node"), "fp").distinct())
    placed = _placed(cut_lineage(marked.select("fp").distinct()), budget)
    rows = slim.select("doc_id", "node").join(marked.join(placed, "fp"), "node").select("doc_id", "node", F.col("root").alias("component"))
    return frames.kept_rows(docs, cut_lineage(rows), key, text)
