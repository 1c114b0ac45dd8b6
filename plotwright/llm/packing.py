"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bounded-space online best-fit: a packer holds a fixed number of open bins, a bitset keyed by free space finds
the fullest bin that still takes a piece, and when too many bins are open the fullest one closes first.
Documents are tokenised where they are read, only piece descriptions (no ids) are shuffled, and each partition
of pieces is packed on its own, so a packer's memory is its open bins and nothing else; a lost task is run
again over the same rows in the same order.

Only a document longer than the capacity is cut, into full pieces and a rest. Defined results: null and empty
texts hold the end id alone; rows that share a doc_id are pieces of their own; an empty table packs into none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import WORD_BPE, encode

CAPACITY = 4096
OPEN_BINS = 2048


class Packer:
    """Online best-fit with at most open_bins open bins; bins are numbered in the order in which they open."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}  # free space: the open bins that have it
        self.bits = 0  # bit s: a bin with free space s is open
        self.opened = self.open = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset there of the next piece."""
        if length > self.capacity:
            raise ValueError("a piece is longer than a sequence")
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            if self.open == self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:  # the bin at hand is the fullest
                    return number, self.capacity - space
                self._take(fullest)
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, vocabulary: str = WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, doc_ids = [], batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encode(batch.column("text"), vocabulary)):
                ids = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces with sequence_id and offset.

    Pieces are dealt by a hash of all that describes them and come in the order of that hash: any order of
    sizes in the input is broken up, and a partition meets the same pieces in the same order when it is redone.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    key = F.xxhash64("doc_id", "piece", "ids_crc32")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer = Packer(capacity, open_bins)
        for batch in batches:
            placed = [packer.put(n) for n in batch.column("length").to_pylist()]
            columns = [batch.column(n) for n in own] + [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "sequence_id", "offset"])

    dealt = pieces.select(own).withColumn("__order", key).repartition("__order").sortWithinPartitions("__order", "doc_id", "piece")
    schema = pieces.select(own).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.mapInArrow(step, schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))
