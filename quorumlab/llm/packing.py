"""Bounded-space online best-fit packing of documents into sequences.

A document's ids and an end id are cut into pieces of at most ``size`` ids, and only documents
longer than that are cut.  Every task packs the pieces of the rows it reads, with at most
``open_bins`` sequences open: a piece goes to the open sequence with the least free space that
takes it, else to a new one, and where that is one too many the fullest is closed.  Open
sequences are found by free space in one bitset.  Pieces arrive in bounded windows, longest
first, which leaves small ones to fill the gaps.

One pass over the texts, no shuffle.  What a task packs depends on its rows alone, so a task
that is run again gives the same sequences.  Sequence numbers hold the task's number in the
upper bits.  Waste is at most the open sequences of each task, and what best fit leaves.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quorumlab.llm import frames, memo, wordbpe

SIZE = 2048
OPEN_BINS = 256
END_ID = 0
#: Ids that wait at most before they are packed, longest piece first.
WINDOW_IDS = 4_000_000
#: Sequence number = task number * TASK_STRIDE + the task's own number.
TASK_STRIDE = 1 << 36


class BestFit:
    """Best fit over at most ``open_bins`` open sequences of ``size`` places."""

    def __init__(self, size: int, open_bins: int, first: int = 0):
        self.size, self.open_bins, self.next = size, open_bins, first
        self.spaces = 0  # bit f: some open sequence has f free places
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence of a piece and its offset there."""
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open >= self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
            self.at[left].append(sequence)
            self.spaces |= 1 << left
            self.open += 1
        return sequence, self.size - free

    def _take(self, free: int) -> int:
        sequence = self.at[free].pop()
        if not self.at[free]:
            self.spaces &= ~(1 << free)
        self.open -= 1
        return sequence


def pack(
    docs: DataFrame,
    vocabulary: str,
    size: int = SIZE,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
    remembered: int = wordbpe.MEMO_WORDS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``remembered`` bounds the words whose ids a worker keeps.  ``with_ids`` adds the piece's ids as
    ``ids binary`` (little-endian unsigned 32-bit), to be written out as training sequences.  Null and empty texts are the end id alone; repeated rows
    are packed each; null keys stay null; other columns are ignored; an empty table gives none.
    """
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        memo.working_for("word ids")
        coder = wordbpe.load(vocabulary, remembered)
        bins = BestFit(size, open_bins, TaskContext.get().partitionId() * TASK_STRIDE)

        def packed(waiting):
            waiting.sort(key=lambda piece: -piece[3])  # stable: ties stay in order
            rows = [(*p[:5], *bins.place(p[3]), *p[5:]) for p in waiting]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

        waiting, held = [], 0
        for part in frames.slices(batches):
            for doc, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = coder.encode(words) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    waiting.append((doc, piece, at // 4, n, zlib.crc32(own), *([own] if with_ids else ())))
                    held += n
                if held >= WINDOW_IDS:
                    yield from packed(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from packed(waiting)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return frames.keyed_texts(docs, key, text).mapInArrow(run, schema + ", ids binary" * with_ids)
