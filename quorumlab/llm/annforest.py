"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on at most ``SAMPLE`` vectors, chosen by hash: each node splits its sample at
the median of a random direction through two of its vectors, until a node has ``LEAF`` of them.
Every vector then finds its leaf in every tree.  A query searches all trees at once: one
priority queue holds the nodes of all trees by the worst margin on the way, and the nearest
``PROBES`` leaves are its candidates.  Exact distances in double precision rank them.

The search is dealt out by leaf, and a leaf of more than ``BLOCK`` vectors by blocks of it, each
of which gets the leaf's queries; a block gives each query its nearest few, so a leaf that holds
a third of all vectors (copies, say) is many tasks and passes on only rows that can win.  The
vectors are shuffled once per tree, the queries once per probe and block.

A query has every other vector as a candidate, without itself; equal distances go to the smaller
id.  Vectors that are null, zero, of another length than most in the sample, or hold null or
non-finite values take no part.  Repeated ids are kept once, the vector with the smallest hash.
Empty tables and tables without queries give no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.llm import frames
from quorumlab.session import cut_lineage

TREES, LEAF, SAMPLE, PROBES, NEAREST, BLOCK = 4, 160, 20_000, 128, 10, 4_000


class Tree:
    """One tree as arrays: a node's direction, threshold and children; leaves have numbers."""

    def __init__(self, sample: np.ndarray, leaf: int, random: np.random.Generator):
        self.direction, self.cut, self.child, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(sample, leaf, random, 0)
        self.direction = np.array(self.direction, np.float64).reshape(-1, sample.shape[1] if len(sample) else 1)
        self.cut, self.child, self.leaf = np.array(self.cut), np.array(self.child, np.int64).reshape(-1, 2), np.array(self.leaf, np.int64)

    def _grow(self, sample: np.ndarray, leaf: int, random: np.random.Generator, depth: int) -> int:
        node = len(self.cut)
        self.direction.append(np.zeros(sample.shape[1]))
        self.cut.append(0.0)
        self.child.append([-1, -1])
        self.leaf.append(-1)
        for _ in range(4 if len(sample) > leaf and depth < 40 else 0):
            a, b = sample[random.choice(len(sample), 2, replace=False)]
            direction = a - b
            length = np.linalg.norm(direction)
            if not length:
                continue
            along = sample @ (direction / length)
            cut = float(np.median(along))
            right = along > cut
            if 0 < right.sum() < len(sample):
                self.direction[node], self.cut[node] = direction / length, cut
                left_child = self._grow(sample[~right], leaf, random, depth + 1)
                right_child = self._grow(sample[right], leaf, random, depth + 1)
                self.child[node] = [left_child, right_child]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.child[at, 0] >= 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            right = np.einsum("ij,ij->i", vectors[inner], self.direction[node]) > self.cut[node]
            at[inner] = self.child[node, right.astype(np.int64)]


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 17):
        self.trees = [Tree(sample, leaf, np.random.default_rng([seed, t])) for t in range(trees)]

    def probes(self, query: np.ndarray, count: int) -> list[tuple[int, int]]:
        """The ``count`` nearest leaves (tree, leaf) over all trees, by one priority queue."""
        margins = [tree.direction @ query - tree.cut for tree in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        found = []
        while queue and len(found) < count:
            far, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            if tree.leaf[node] >= 0:
                found.append((t, int(tree.leaf[node])))
                continue
            margin = margins[t][node]
            near, other = tree.child[node][::-1] if margin > 0 else tree.child[node]
            heapq.heappush(queue, (far, t, int(near)))
            heapq.heappush(queue, (max(far, abs(margin)), t, int(other)))
        return found


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of the vectors that take part, one for each id."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def _dots(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, sample_rows: int = SAMPLE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, key, vector))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    total = rows.count()
    share = int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) <= share).orderBy(F.xxhash64("vec_id")).limit(2 * sample_rows).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return spark.createDataFrame([], schema)
    size = Counter(map(len, sample)).most_common(1)[0][0]
    rows = rows.filter(F.size("v") == size)
    forest = spark.sparkContext.broadcast(Forest(np.stack([v for v in sample if len(v) == size]), trees, leaf))

    def placing(batches):
        for part in frames.slices(batches, 4096):
            x = _dots(part.column(1))
            for t, tree in enumerate(forest.value.trees):
                spot = tree.place(x) + (t << 32)
                yield pa.RecordBatch.from_arrays([pa.array(spot), part.column(0), part.column(1)], ["spot", "vec_id", "v"])

    def probing(batches):
        for part in frames.slices(batches, 256):
            spots, owner = [], []
            for i, q in enumerate(_dots(part.column(1))):
                found = forest.value.probes(q, probes)
                spots += [(t << 32) + leaf_ for t, leaf_ in found]
                owner += [i] * len(found)
            taken = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int64()), part.column(0).take(taken), part.column(1).take(taken)], ["spot", "vec_id", "v"])

    placed = rows.mapInArrow(placing, "spot bigint, vec_id bigint, v array<double>")
    sizes = placed.select("spot").groupBy("spot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(cut_lineage(sizes))  # a row per leaf, of which the sample allows trees * 2 * sample_rows / leaf or so
    own = placed.join(sizes, "spot").select("spot", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.filter(is_query).mapInArrow(probing, "spot bigint, vec_id bigint, v array<double>").join(sizes, "spot")
    asked = asked.select("spot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = own.union(asked).repartition("spot", "block").sortWithinPartitions("spot", "block")

    def ranked(spots, blocks, asks, ids, x) -> pa.RecordBatch:
        out_q, out_v, out_d = [], [], []
        edges = np.flatnonzero(np.concatenate([[True], (spots[1:] != spots[:-1]) | (blocks[1:] != blocks[:-1]), [True]]))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            ask = asks[low:high]
            have, want = np.flatnonzero(~ask) + low, np.flatnonzero(ask) + low
            if not len(have):
                continue
            for start in range(0, len(want), 64):
                part = want[start : start + 64]
                rough = (x[part] ** 2).sum(1)[:, None] + (x[have] ** 2).sum(1)[None, :] - 2 * x[part] @ x[have].T
                rough[ids[part][:, None] == ids[have][None, :]] = np.inf
                for q, line in zip(part, rough, strict=True):
                    near = have[line < np.inf]
                    line = line[line < np.inf]
                    if len(near) > nearest:  # exact values decide among all that rounding could bring in
                        slack = 1e-9 * (1 + (x[q] ** 2).sum() + np.abs(line).max())
                        near = near[line <= np.partition(line, nearest - 1)[nearest - 1] + slack]
                    exact = np.sqrt(((x[near] - x[q]) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))[:nearest]
                    out_q.append(np.full(len(best), ids[q]))
                    out_v.append(ids[near][best])
                    out_d.append(exact[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays([pa.array(join(out_q, np.int64)), pa.array(join(out_v, np.int64)), pa.array(join(out_d, np.float64))], ["query_id", "vec_id", "score"])

    def ranking(batches):
        held = None
        for part in frames.slices(batches, 4096):
            now = [part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(), _dots(part.column(4))]
            held = now if held is None else [np.concatenate(pair) for pair in zip(held, now, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(last):
                whole = int(last[-1]) + 1
                yield ranked(*[h[:whole] for h in held])
                held = [h[whole:] for h in held]
        if held is not None:
            yield ranked(*held)

    found = dealt.mapInArrow(ranking, "query_id bigint, vec_id bigint, score double").distinct()
    best = found.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("score", "vec_id"))).alias("all"))
    best = best.select("query_id", F.posexplode(F.slice("all", 1, nearest)).alias("place", "hit"))
    return best.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
