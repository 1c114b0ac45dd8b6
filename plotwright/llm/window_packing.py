"""Best-fit-decreasing packing of tokenised documents into windows of a fixed capacity.

Documents are tokenised where they are read and cut there: an overlong one into full windows and a rest. Pieces are
dealt to packers by a hash and arrive longest first; of each packer a segment tree over the remaining capacities
finds the tightest open window that still takes the piece. What is shuffled are descriptions of pieces, without ids.

Windows that stay open are closed by crumbs: one piece in ``crumb_of``, chosen by hash, brings its ids along and is
held back. Crumbs may be cut anywhere. They fill the gaps of at least ``least_gap`` ids, what is left of them fills
windows of its own, and the last of these are as long as a power of two, which needs no padding. So a packer leaves
gaps under ``least_gap`` only, if its crumbs last, and no document but overlong ones and crumbs is cut.

A packer keeps its open windows (a number each) and its crumbs. A lost task is run again over the same rows in the
same order. Defined results: null and empty texts hold the end id alone; rows that share a doc_id are documents of
their own, and equal rows go to one packer; an empty table packs into none. Of docs only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import WORD_BPE, encode

CAPACITY = 2048
#: One piece in so many is a crumb; gaps of fewer ids are left.
CRUMB_OF, LEAST_GAP = 32, 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class CapacityTree:
    """A segment tree whose leaves are the remaining capacities; a node counts the open windows below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def _add(self, space: int, by: int) -> None:
        node = self.leaves + space
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, space: int, window: int) -> None:
        self.windows.setdefault(space, []).append(window)
        self._add(space, 1)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity, not under length, that an open window has."""
        count, node = self.count, self.leaves + length
        if count[node]:
            return length
        while node > 1:  # up to the first right neighbour that has windows, then down to its least leaf
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, space: int) -> int:
        window = self.windows[space].pop()
        self._add(space, -1)
        return window

    def open(self) -> Iterator[tuple[int, int]]:
        """The open windows, tightest first: remaining capacity and number."""
        for space in sorted(self.windows):
            for window in self.windows[space]:
                yield space, window


class Packer:
    """Places pieces that come in order of falling length; windows are numbered as they open."""

    def __init__(self, capacity: int = CAPACITY, least_gap: int = LEAST_GAP):
        self.capacity, self.least_gap = capacity, least_gap
        self.tree = CapacityTree(capacity)
        self.opened = 0

    def put(self, length: int) -> tuple[int, int]:
        """The window and the offset there of the next piece."""
        if length > self.capacity:
            raise ValueError("a piece is longer than a window")
        space = self.tree.tightest(length)
        if space is None:
            window, space = self.opened, self.capacity
            self.opened += 1
        else:
            window = self.tree.take(space)
        if space > length:
            self.tree.put(space - length, window)
        return window, self.capacity - space

    def slots(self, tokens: int) -> Iterator[tuple[int, int, int]]:
        """Window, offset and length of the places that so many ids of crumbs fill: gaps, whole windows, powers of two."""
        for space, window in self.tree.open():
            used = self.capacity - space
            if space >= self.least_gap and used & (used - 1) and tokens:
                size = min(space, tokens)
                tokens -= size
                yield window, used, size
        while tokens:
            size = min(self.capacity, 1 << tokens.bit_length() - 1)
            yield self.opened, 0, size
            self.opened += 1
            tokens -= size


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, vocabulary: str = WORD_BPE, crumb_of: int = CRUMB_OF) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of each document, and of crumbs the ids (unsigned, little-endian, 32 bits)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"), vocabulary)):
                ids = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    raw = ids[start : start + capacity].tobytes()
                    crc = zlib.crc32(raw)
                    crumb = len(raw) < 4 * capacity and zlib.crc32(b"%d" % start, crc) % crumb_of == 0
                    rows.append((doc_id, start, len(raw) // 4, crc, len(ids), raw if crumb else None))
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, PIECE)


def cut(crumbs: list[tuple], slots: Iterator[tuple[int, int, int]]) -> Iterator[tuple]:
    """Crumbs (doc_id, start, doc_tokens, ids) laid end to end into slots: rows of pieces with their places."""
    crumb, at = 0, 0
    for window, offset, room in slots:
        while room:
            doc_id, start, whole, ids = crumbs[crumb]
            part = ids[4 * at : 4 * (at + room)]
            size = len(part) // 4
            yield doc_id, start + at, size, zlib.crc32(part), whole, window, offset
            offset, room, at = offset + size, room - size, at + size
            if 4 * at == len(ids):
                crumb, at = crumb + 1, 0


def pack(pieces: DataFrame, capacity: int = CAPACITY, least_gap: int = LEAST_GAP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece, crumbs as they are cut."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer, crumbs = Packer(capacity, least_gap), []
        for batch in batches:
            whole = batch.column("ids").is_null()
            crumbs += [(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in batch.filter(pc.invert(whole)).to_pylist()]
            rest = batch.filter(whole)
            placed = [packer.put(n) for n in rest.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[rest.column(n) for n in names[:5]], pa.array([first + w for w, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=names)
        rows = cut(crumbs, packer.slots(sum(len(c[3]) for c in crumbs) // 4))
        made = [(*r[:5], first + r[5], r[6]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*made) if made else [[]] * 7)], names=names)

    key = F.xxhash64("doc_id", "start", "ids_crc32")
    dealt = pieces.withColumn("__key", key).repartition("__key").sortWithinPartitions(F.desc("length"), "__key", "doc_id", "start", "ids_crc32")
    return dealt.drop("__key").mapInArrow(step, ", ".join(f"{n} long" for n in names))


def op13_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))
