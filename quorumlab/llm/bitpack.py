"""Token ids in fixed-width bit packing, with random access.

A file holds blocks; a block holds the ids of consecutive documents in the fewest bits that the
vocabulary needs, each id at bit ``position * width``.  Its layout is

    magic "QBP1" | width u32 | documents u32 | ids u64 | offsets u32 x (documents + 1) | words u64

(little-endian), where document ``i`` has the ids from ``offsets[i]`` to ``offsets[i + 1]``.
Files are Parquet as a container: one row per block with the keys of its documents, so they are
written and found through Spark in any store, and a key range reads only its blocks.

Writing shuffles the texts once, into key ranges; each range is encoded as it is written, so a
task that is run again writes the same file.  Nothing but one number per file reaches the driver.
"""

from __future__ import annotations

import zlib
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.llm import frames, memo, wordbpe

MAGIC = b"QBP1"
HEADER = np.dtype([("magic", "S4"), ("width", "<u4"), ("documents", "<u4"), ("ids", "<u8")])
#: A block is closed at the first document that brings it to so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 18, 4096
END_ID = 1


def bit_width(vocabulary_size: int) -> int:
    """The fewest bits for ids from 0 to ``vocabulary_size - 1``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words, ``width`` bits each, without gaps; one spare word at the end."""
    period = 64 // gcd(width, 64)  # so many ids fill whole words
    rows = -(-len(ids) // period)
    padded = np.zeros((rows, period), np.uint64)
    padded.reshape(-1)[: len(ids)] = ids
    words = np.zeros((rows, width * period // 64), np.uint64)
    for place in range(period):
        word, shift = divmod(place * width, 64)
        words[:, word] |= padded[:, place] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= padded[:, place] >> np.uint64(64 - shift)
    used = -(-len(ids) * width // 64)
    return np.append(words.reshape(-1)[:used], np.uint64(0))


def unpack_bits(words: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """The ids at positions ``first`` to ``last`` (exclusive); reads only their words."""
    bits = np.arange(first, last, dtype=np.uint64) * np.uint64(width)
    word, shift = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
    low = words[word] >> shift
    high = (words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)  # no shift by 64
    return ((low | high) & np.uint64((1 << width) - 1)).astype("<u4")


def make_block(documents: list[np.ndarray], width: int) -> bytes:
    offsets = np.zeros(len(documents) + 1, "<u4")
    np.cumsum([len(d) for d in documents], out=offsets[1:])
    header = np.array([(MAGIC, width, len(documents), int(offsets[-1]))], HEADER)
    ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    return header.tobytes() + offsets.tobytes() + pack_bits(ids, width).astype("<u8").tobytes()


class Block:
    """A block's documents, unpacked when asked for."""

    def __init__(self, data: bytes):
        header = np.frombuffer(data, HEADER, 1)[0]
        if header["magic"] != MAGIC:
            raise ValueError("not a block of packed ids")
        self.width = int(header["width"])
        n = int(header["documents"])
        self.offsets = np.frombuffer(data, "<u4", n + 1, HEADER.itemsize)
        self.words = np.frombuffer(data[HEADER.itemsize + 4 * (n + 1) :], "<u8")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def document(self, i: int) -> np.ndarray:
        return unpack_bits(self.words, self.width, int(self.offsets[i]), int(self.offsets[i + 1]))

    def all(self) -> np.ndarray:
        return unpack_bits(self.words, self.width, 0, int(self.offsets[-1]))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all rows, each with ``end_id`` after it, in ascending key order.

    Null and empty texts are the end id alone.  A null key comes first; rows that repeat a key
    lie in the order of their texts.  Other columns are ignored; an empty table gives no block.
    """
    schema = (
        "file int, block int, first_doc bigint, last_doc bigint, ids_before bigint, n_ids bigint, docs array<bigint>, data binary"
    )
    end = end_id.to_bytes(4, "little")

    def run(batches):
        memo.working_for("word ids")
        coder = wordbpe.load(vocabulary)
        width = bit_width(max(end_id, *coder.vocab.values(), *coder.added.values()) + 1)
        file, block, before = TaskContext.get().partitionId(), 0, 0
        keys, held, n = [], [], 0

        def closed():
            columns = [[file], [block], [keys[0]], [keys[-1]], [before], [n], [keys], [make_block(held, width)]]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary()]
            names = [part.split()[0] for part in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part in frames.slices(batches):
            for doc, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(coder.encode(words) + end, "<u4")
                keys.append(doc)
                held.append(ids)
                n += len(ids)
                if n >= BLOCK_IDS or len(keys) >= BLOCK_DOCS:
                    yield closed()
                    block, before, keys, held, n = block + 1, before + n, [], [], 0
        if keys:
            yield closed()

    ordered = frames.keyed_texts(docs, key, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files, and ``ids`` on request.

    ``start`` counts the ids of all documents before, in all files.  A key range is passed down
    to the files' statistics, so only blocks that may hold it are read.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()  # a row per file
    base, total = {}, 0
    for row in totals:
        base[row["file"]] = total
        total += row["n"]
    if first_doc is not None:
        blocks = blocks.filter(F.col("last_doc") >= first_doc)
    if last_doc is not None:
        blocks = blocks.filter(F.col("first_doc").isNull() | (F.col("first_doc") <= last_doc))  # nulls come first

    def run(batches):
        for part in frames.slices(batches, 1):
            row = part.to_pylist()[0]
            block = Block(row["data"])
            raw, offsets = block.all().tobytes(), block.offsets.tolist()
            start = base[row["file"]] + row["ids_before"]
            kept = [
                i
                for i, doc in enumerate(row["docs"])
                if (first_doc is None or (doc is not None and doc >= first_doc)) and (last_doc is None or (doc is not None and doc <= last_doc))
            ]
            owns = [raw[4 * offsets[i] : 4 * offsets[i + 1]] for i in kept]
            columns = [
                pa.array([row["docs"][i] for i in kept], pa.int64()),
                pa.array([start + offsets[i] for i in kept], pa.int64()),
                pa.array([len(own) // 4 for own in owns], pa.int64()),
                pa.array([zlib.crc32(own) for own in owns], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(own, "<u4").astype("int64") for own in owns], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return blocks.select("file", "ids_before", "docs", "data").mapInArrow(run, schema)
