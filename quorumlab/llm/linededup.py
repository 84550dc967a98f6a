"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line without blanks (space, \\t to \\r) at both ends, A-Z lower-cased.  Keys of at
least ``MIN_CHARS`` code points found in at least ``MIN_DOCS`` documents lose all their lines except
in the largest key of a document that holds them.

One pass gives the 128-bit hashes of a document's distinct long keys; an aggregate with map-side
combine counts the documents of each hash.  Hashes that reach the count are dealt to shards of a
bounded number of keys; a shard is a minimal perfect hash with three arrays: fingerprints (the other
64 bits), counts and largest document keys.  Documents probe these arrays: a key that is not indexed
fails on its fingerprint (once in 2**64 look-ups).  Lines are never joined and never shuffled.

The shards are sent to all tasks while they take at most ``SENT_BYTES``, counted before.  Beyond it
the look-ups go to the shards: a document asks each shard for its own hashes, the requests of a shard
are spread over as many copies of it as they need, and the answers meet the text once.

A row is a document: repeated rows count each.  A null key is smaller than any other; a row keeps
its lines where its key is the largest.  A null or empty text is one empty line; texts of any length
are split whole.  Other columns are ignored (kept by ``keep_lines``).  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.llm import frames
from quorumlab.llm.memo import working_for
from quorumlab.llm.perfecthash import PerfectHash
from quorumlab.session import cut_lineage

MIN_CHARS, MIN_DOCS = 20, 3
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Keys of a shard, about; it is built and held by one task.
SHARD_KEYS = 1 << 20
#: Shards up to this size in all are sent to every task.
SENT_BYTES = 64 << 20
#: Requests that one copy of a shard answers, about.
SHARD_REQUESTS = 1 << 20
#: Bytes of text that are split at a time.
SPLIT_BYTES = 8 << 20
NO_KEY = -(1 << 63)


def line_keys(data: bytes) -> list[bytes]:
    """The key of each line, empty where it has fewer than ``MIN_CHARS`` code points."""
    found = []
    for line in data.lower().split(b"\n"):
        key = line.strip(BLANKS)
        size = len(key)
        if size < MIN_CHARS or (size < 4 * MIN_CHARS and not key.isascii() and len(key.decode()) < MIN_CHARS):
            key = b""
        found.append(key)
    return found


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit halves for each key."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), np.uint64).reshape(-1, 2)


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_KEY).to_numpy(zero_copy_only=False)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [text or b"" for text in part.column(1).cast(pa.binary()).to_pylist()]


def _bounded(batches, rows: int = frames.SLICE) -> Iterator[pa.RecordBatch]:
    """Slices whose texts take about ``SPLIT_BYTES``, or one row."""
    for part in frames.slices(batches, rows):
        if part.nbytes <= SPLIT_BYTES or part.num_rows == 1:
            yield part
        else:
            yield from _bounded([part], max(1, part.num_rows // 2))


def line_hashes(docs: DataFrame) -> DataFrame:
    """``low, high, doc_id``: a row for each distinct long key of a document."""

    def run(batches):
        working_for("line hashes")
        for part in _bounded(batches):
            own, sizes = [], []
            for data in _texts(part):
                keys = set(line_keys(data))
                keys.discard(b"")
                own.extend(keys)
                sizes.append(len(keys))
            found = hashes_of(own).view(np.int64)
            ids = np.repeat(_keys(part.column(0)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(ids)], ["low", "high", "doc_id"])

    return docs.mapInArrow(run, "low bigint, high bigint, doc_id bigint")


class Shard:
    """The arrays of one shard, by index of the perfect hash."""

    def __init__(self, blob: bytes):
        n, size = np.frombuffer(blob, np.int64, 2).tolist()
        self.hash = PerfectHash.from_bytes(memoryview(blob)[16 : 16 + size])
        self.prints = np.frombuffer(blob, np.uint64, n, 16 + size)
        self.largest = np.frombuffer(blob, np.int64, n, 16 + size + 8 * n)
        self.counts = np.frombuffer(blob, np.uint32, n, 16 + size + 16 * n)

    @staticmethod
    def build(low: np.ndarray, high: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> bytes:
        table = PerfectHash.of(low, high)
        at = table.index(low, high)
        prints, tops, sizes = np.empty(len(low), np.uint64), np.empty(len(low), np.int64), np.empty(len(low), np.uint32)
        prints[at], tops[at], sizes[at] = high, largest, np.minimum(counts, 0xFFFFFFFF)
        data = table.to_bytes()
        return np.array([len(low), len(data)], np.int64).tobytes() + data + prints.tobytes() + tops.tobytes() + sizes.tobytes()

    def drops(self, hashes: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether the line of each hash goes from the document of each id."""
        low, high = hashes[:, 0], hashes[:, 1]
        at = self.hash.index(low, high)
        gone = np.zeros(len(at), bool)
        known = np.flatnonzero(at >= 0)
        spot = at[known]
        gone[known] = (self.prints[spot] == high[known]) & (self.counts[spot] >= min_docs) & (self.largest[spot] != ids[known])
        return gone


def shard_of(low: np.ndarray, shards: int) -> np.ndarray:
    return (low % np.uint64(shards)).astype(np.int32)


def index(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """``shard, blob, size`` of the lines that ``min_docs`` documents hold, and the number of shards."""
    counted = line_hashes(docs).groupBy("low", "high").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    frequent = cut_lineage(counted.filter(F.col("n") >= min_docs))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        low, high, n, top = (table.column(c).to_numpy() for c in ("low", "high", "n", "top"))
        blob = Shard.build(low.view(np.uint64), high.view(np.uint64), n, top)
        return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    # The unsigned remainder, as in shard_of.
    halves = (F.shiftrightunsigned("low", 1) % shards * 2 + F.col("low").bitwiseAND(1)) % shards
    dealt = frequent.withColumn("shard", halves.cast("int"))
    built = dealt.groupBy("shard").applyInArrow(build, "shard int, blob binary")
    return cut_lineage(built.withColumn("size", F.octet_length("blob").cast("long"))), shards


def _row_key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))


def _answered(keyed: DataFrame, blobs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``row, gone``: the hashes (16 bytes each, in a row) of the lines that a document loses."""

    def ask(batches):
        for part in _bounded(batches):
            rows, ids = part.column(2).to_pylist(), _keys(part.column(0)).tolist()
            out = []
            for row, key, data in zip(rows, ids, _texts(part), strict=True):
                found = hashes_of(sorted({k for k in line_keys(data) if k}))
                where = shard_of(found[:, 0], shards)
                out += [(row, key, int(s), found[where == s].tobytes()) for s in np.unique(where)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "shard", "asked"])

    asked = keyed.mapInArrow(ask, "row string, doc_id bigint, shard int, asked binary")
    asked = cut_lineage(asked.groupBy("row", "shard").agg(F.first("doc_id").alias("doc_id"), F.first("asked").alias("asked")))
    # Copies of a shard, so that no task answers more than its part of a shard that all ask.
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_REQUESTS).alias("copies"))
    copies = F.broadcast(load) if shards <= 1_000_000 else load
    spread = asked.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("row"), "copies"))
    held = blobs.join(copies, "shard").select("shard", "blob", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    both = spread.select("shard", "copy", "row", "doc_id", "asked", F.lit(None).cast("binary").alias("blob")).unionByName(held, allowMissingColumns=True)
    both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())

    def answer(batches):
        shard = None
        for part in frames.slices(batches):
            out = []
            for row in part.to_pylist():
                if row["blob"] is not None:
                    shard, own = Shard(row["blob"]), (row["shard"], row["copy"])
                    continue
                if shard is None or own != (row["shard"], row["copy"]):
                    continue  # no frequent line in this shard
                found = np.frombuffer(row["asked"], np.uint64).reshape(-1, 2)
                gone = shard.drops(found, np.full(len(found), row["doc_id"]), min_docs)
                if gone.any():
                    out.append((row["row"], found[gone].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["row", "gone"])

    found = both.mapInArrow(answer, "row string, gone binary")
    return found.groupBy("row").agg(F.collect_list("gone").alias("gone"))


def _kept(data: bytes, gone: np.ndarray) -> bytes:
    if not gone.any():
        return data
    return b"\n".join([line for line, out in zip(data.split(b"\n"), gone.tolist(), strict=True) if not out])


def _map_kept(keyed: DataFrame, blobs: DataFrame, shards: int, min_docs: int, out: Callable, fields: str) -> DataFrame:
    """Map each row's lines to ``out(n_lines, n_dropped, kept)``'s columns, with the row's other columns."""
    others = [c for c in keyed.columns if c not in ("doc_id", "text", "row")]
    schema = ", ".join(["doc_id bigint", *(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in others), fields])
    sent = None
    if (blobs.agg(F.sum("size")).first()[0] or 0) <= SENT_BYTES:
        found = {r["shard"]: bytes(r["blob"]) for r in blobs.select("shard", "blob").collect()}
        sent = keyed.sparkSession.sparkContext.broadcast(found)
        rows = keyed.select("doc_id", "text", *others)
    else:
        rows = keyed.join(_answered(keyed, blobs, shards, min_docs), "row", "left").select("doc_id", "text", "gone", *others)
    first = 2 if sent else 3

    def run(batches):
        working_for("line hashes")
        tables = {s: Shard(blob) for s, blob in sent.value.items()} if sent else {}
        for part in _bounded(batches):
            texts = _texts(part)
            keys = [line_keys(data) for data in texts]
            sizes = [len(own) for own in keys]
            ids = np.repeat(_keys(part.column(0)), sizes)
            flat = [k for own in keys for k in own]
            long = np.flatnonzero(np.fromiter(map(len, flat), np.int64, len(flat)))
            found = hashes_of([flat[i] for i in long.tolist()])
            gone = np.zeros(len(flat), bool)
            if sent:
                where = shard_of(found[:, 0], shards)
                for s in np.unique(where).tolist():
                    if s in tables:
                        own = np.flatnonzero(where == s)
                        gone[long[own]] = tables[s].drops(found[own], ids[long[own]], min_docs)
            else:
                dropped = [{b for blob in lists or () for b in _cut(blob)} for lists in part.column(2).to_pylist()]
                of_row = np.repeat(np.arange(len(texts)), sizes)[long].tolist()
                gone[long] = [h in dropped[r] for r, h in zip(of_row, _cut(found.tobytes()), strict=True)]
            ends = np.cumsum(sizes).tolist()
            marks = [gone[end - size : end] for size, end in zip(sizes, ends, strict=True)]
            columns = out(sizes, [int(m.sum()) for m in marks], [_kept(data, m) for data, m in zip(texts, marks, strict=True)])
            names = ["doc_id", *others, *columns]
            yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(first + i) for i in range(len(others))], *columns.values()], names)

    return rows.mapInArrow(run, schema)


def _cut(data: bytes) -> list[bytes]:
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def _lined(docs: DataFrame, out: Callable, fields: str, min_docs: int) -> DataFrame:
    slim = docs.select("doc_id", "text")
    blobs, shards = index(slim, min_docs)
    return _map_kept(docs.withColumn("row", _row_key()), blobs, shards, min_docs, out, fields)


def report(docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row of ``docs``."""

    def out(n_lines, n_dropped, kept):
        digests = [hashlib.sha256(data).hexdigest() for data in kept]
        return {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}

    return _lined(frames.keyed_texts(docs, key, text), out, "n_lines bigint, n_dropped bigint, kept_sha256 string", min_docs)


def keep_lines(docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the other columns as they are and the lines that stay; a null text stays null where no line goes."""

    def out(n_lines, n_dropped, kept):
        return {"_kept": pa.array(kept, pa.binary()).cast(pa.string())}

    others = [c for c in docs.columns if c not in (key, text)]
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(text).isNull().alias("_missing"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_rest"),
    )
    found = _lined(slim, out, "_kept string", min_docs)
    columns = {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(others)}
    columns |= {key: F.col("doc_id").cast(docs.schema[key].dataType).alias(key), text: F.when(~F.col("_missing"), F.col("_kept")).alias(text)}
    return found.select(*[columns[c] for c in docs.columns])
