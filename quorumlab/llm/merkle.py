"""Merkle manifest of a document table, by slot pivots.

A document's leaf is the digest of its fields.  Leaves of a source stand in key order; every 16
consecutive nodes become one, until one remains.  The sources' roots form a tree of the same kind.
A level is one grouped pivot: conditional aggregates spread a parent's children into 16 slot
columns, their concatenation is hashed to the parent, and leaving out a child's own column gives
its siblings.  The trees are climbed once and descended once; on the way down a run of children
carries the siblings of all levels above it, so a document's proof is put together where its run
already lies.

Only DataFrame functions.  Texts are read once and never shuffled: what moves is a digest and a key
for each document.  Positions come from one range partitioning, so a source of any size is spread
over all tasks; a pivot's groups have 16 rows.  Each level is checkpointed.

Null fields are ``-``, other ones their length in UTF-8 and their value.  Null keys come first; rows
that share a key stand in the order of their leaves, repeated rows have a leaf each; a null source is
a source of its own and comes first.  Texts of any length are hashed whole.  Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.operators.joins import join_checked
from quorumlab.session import cut_lineage

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SLOTS = [f"slot{i}" for i in range(FANOUT)]
#: ``monotonically_increasing_id`` keeps the partition above this many bits.
ROW_BITS = 33


def field(column: Column) -> Column:
    """A value's bytes in a leaf: its length, a colon and itself; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``idx``, the 0-based place in its ``tree`` by ``order``, and ``n``, the tree's size.

    The range-partitioned rows are checkpointed before they are counted: another job would draw
    other borders.  The table of offsets has a row for each partition and tree in it.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    spread = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    spread = cut_lineage(spread.withColumn("spot", F.monotonically_increasing_id()).withColumn("part", F.shiftright("spot", ROW_BITS)))
    parts = spread.groupBy("tree", "part").agg(F.min("spot").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "tree", "part", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n")
    )
    offsets = cut_lineage(offsets)
    found = join_checked(spread, offsets, ["tree", "part"], offsets.count())
    return found.withColumn("idx", F.col("spot") + F.col("shift")).drop("spot", "part", "shift")


def pivot(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row for each run of ``FANOUT`` nodes: its children in slots, and the parent's digest.

    A tree with one node left is done: its node passes unchanged.  ``single`` marks such runs.
    """
    child = F.struct("h", *carried)
    slot = F.col("idx") % FANOUT
    runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx")).agg(
        F.max("n").alias("n"), *[F.max(F.when(slot == i, child)).alias(name) for i, name in enumerate(SLOTS)]
    )
    single = F.col("n") == 1
    joined = F.concat_ws("", *[f"{name}.h" for name in SLOTS])
    return runs.select(
        "tree", "idx", F.ceil(F.col("n") / FANOUT).alias("n"), *SLOTS, single.alias("single"),
        F.when(single, F.col(f"{SLOTS[0]}.h")).otherwise(digest(joined)).alias("h"),
    )


def climb(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The runs of each level, leaves first; the last level has one run for each tree."""
    levels = [cut_lineage(pivot(nodes, carried))]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(cut_lineage(pivot(levels[-1].select("tree", "idx", "n", "h"))))
    return levels


def descend(levels: Sequence[DataFrame], above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The lowest nodes with the ``path`` of ``above``: siblings on the left and right, own level first.

    ``above`` has ``tree``, ``path`` and further columns for each tree; they come along.
    """
    kept = [c for c in above.columns if c not in ("tree", "idx", "path")]
    paths = above.withColumn("idx", F.lit(0).cast("long"))
    for depth, runs in reversed(list(enumerate(levels))):
        extra = carried if depth == 0 else ()
        children = []
        for i, name in enumerate(SLOTS):
            left = F.concat_ws("", *[f"{s}.h" for s in SLOTS[:i]]) if i else F.lit("")
            right = F.concat_ws("", *[f"{s}.h" for s in SLOTS[i + 1 :]]) if i + 1 < FANOUT else F.lit("")
            around = F.struct(left.alias("left"), right.alias("right"))
            children.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(i).alias("i"), F.col(name).alias("own"), around.alias("around"))))
        both = runs.drop("h", "n").join(paths, ["tree", "idx"])
        each = both.select("tree", "idx", "path", "single", *kept, F.explode(F.array_compact(F.array(*children))).alias("child"))
        path = F.when(F.col("single"), F.col("path")).otherwise(F.concat(F.array("child.around"), F.col("path")))
        paths = each.select(
            "tree", (F.col("idx") * FANOUT + F.col("child.i")).alias("idx"), path.alias("path"), *kept,
            *([F.col("child.own.h").alias("h"), *[F.col(f"child.own.{c}") for c in extra]] if depth == 0 else []),
        )
    return paths


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS, lower: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded_root`` for every row of ``docs``.

    ``fields`` are the key, the source, and the rest in the order of the leaf.  Where ``tampered``
    (a condition on the key as ``doc_id``) holds, ``folded_root`` starts at the leaf of the row with
    A-Z of ``lower`` in small letters.
    """
    key, source, *_ = fields
    slim = docs.select(*[F.col(c).cast("long" if c == key else "string").alias(f"f{i}") for i, c in enumerate(fields)])
    columns = {name: F.col(f"f{i}") for i, name in enumerate(fields)}
    own = slim.select(
        columns[key].alias("doc_id"), F.coalesce(F.concat(F.lit("+"), columns[source]), F.lit("")).alias("tree"), leaf(list(columns.values())).alias("h"),
        leaf([ascii_lower(c) if name == lower else c for name, c in columns.items()]).alias("low"),
    )
    changed = F.when(F.coalesce(tampered, F.lit(False)), F.col("low")).otherwise(F.col("h")) if tampered is not None else F.col("h")
    leaves = cut_lineage(own.select("doc_id", "tree", "h", changed.alias("changed")))
    carried = ["doc_id", "changed"]
    levels = climb(placed(leaves, ["doc_id", "h"]), carried)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "h")
    tops = climb(placed(subroots, ["source"]), ["source"])
    root = tops[-1].select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("root"))
    sources = descend(tops, root, ["source"])
    above = cut_lineage(sources.select(F.col("source").alias("tree"), "path", "root", F.col("h").alias("subroot")))
    rows = descend(levels, above, carried)
    return rows.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", folded(F.col("path"), F.col("changed")).alias("folded_root")
    )
