"""Substring dedup: words covered by a window of words that also starts elsewhere are removed.

Pass 1 sketches the corpus. Each window has an anchor, the run of ``anchor`` words in it whose hash is least;
equal windows have equal anchors at equal places, and an anchor is counted once however many windows share it,
so a count-min sketch of anchors overestimates the count of every window while holding about a tenth as many
entries. Partitions sketch their own rows sparsely (segment, cells seen, cells seen again), the segments are
merged where they are dealt, and what is kept of the merged sketch is one bit a cell: seen twice or more. Its
width follows the corpus up to ``most_bits``; it is at most 2 ** (most_bits - 2) bytes, whatever the corpus.
A corpus too large for that width only lets more windows pass to the second pass.

Pass 2 groups exactly, by 95 bits of two families of hashes (mixed blocks, and polynomials modulo a prime), the windows whose anchors the sketch has seen twice. A task first groups
its own windows, a few million at a time: a window repeated there is settled, and one row a task stands for
all its occurrences, so a passage that a third of all rows share is no hot key. The rest meet by hash, sorted,
and are compared with their neighbours as they stream by. The covered words of each row then join its text.

Defined results: null and empty texts have no words; texts shorter than a window lose none; rows are judged
one by one, rows that share doc_id and text have equal results and make each other's windows repeated; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_view, chunks, documents, gram_hashes, gram_sums, mix

WINDOW = 35
#: Bits of a cell's place in its segment; rows of the sketch; least and most bits of a cell's number.
SEGMENT_BITS, DEPTH, LEAST_BITS, MOST_BITS = 16, 2, 20, 28
#: Cells of a row of the sketch for each anchor expected.
CELLS_EACH = 4
#: Windows that a task holds at most before it passes them on.
HELD = 1_000_000
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]


def _least_at(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each start the place of the least (leftmost) of the next span hashes, compared by their first 44 bits."""
    low, block = np.uint64((1 << 20) - 1), 1 << 19
    out = []
    for first in range(0, len(hashes) - span + 1, block):
        part = hashes[first : first + block + span - 1]
        best = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < span:
            step = min(have, span - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        out.append((best & low).astype(np.int64) + first)
    return np.concatenate(out)


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes, starts of the windows, the place of each one's anchor, and all anchors' hashes."""
    size = (window + 1) // 2
    hashes = w.hashes()
    grams = gram_hashes(hashes, size)
    starts = np.flatnonzero(w.whole(window))
    if not len(starts):
        return hashes, starts, starts, grams
    return hashes, starts, _least_at(grams, window - size + 1)[starts], grams


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(anchors * odd) >> np.uint64(64 - bits)).astype(np.int64) for odd in _ODD[:DEPTH]]


def sketch_bits(docs: DataFrame, window: int, least: int = LEAST_BITS, most: int = MOST_BITS) -> int:
    """Bits of a cell's number for about CELLS_EACH cells an anchor, a word taken as six bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = total / 6 * 4 / window
    return int(np.clip(np.ceil(np.log2(max(1, CELLS_EACH * expected))), least, most))


def sketch(docs: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """Per row of the sketch, whether each cell was counted twice or more, packed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = []
            for row, cells in enumerate(_cells(np.concatenate(held), bits)):
                cells.sort()
                new = np.ones(len(cells), bool)
                new[1:] = cells[1:] != cells[:-1]
                once = cells[new]
                twice = np.unique(cells[~new])
                segments = np.unique(once >> SEGMENT_BITS)
                cut = [np.searchsorted(x, np.append(segments, segments[-1] + 1) << SEGMENT_BITS) for x in (once, twice)]
                low = [(x & ((1 << SEGMENT_BITS) - 1)).astype("<u2") for x in (once, twice)]
                out += [(row, int(s), low[0][cut[0][i] : cut[0][i + 1]].tobytes(), low[1][cut[1][i] : cut[1][i + 1]].tobytes()) for i, s in enumerate(segments)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["line", "segment", "once", "twice"])

        size = 0
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for a, b in chunks(offsets):
                w = Words(data, offsets[a : b + 1])
                _, starts, at, grams = _anchors(w, window)
                if len(starts):
                    held.append(grams[np.unique(at)])
                    size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, np.zeros(1 << SEGMENT_BITS, np.uint8)
        done: list[tuple[int, int, bytes]] = []
        named = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()))], names=["line", "segment", "often"])
        for batch in batches:
            for line, segment, once, twice in zip(*(batch.column(c).to_pylist() for c in ("line", "segment", "once", "twice"))):
                if key != (line, segment):
                    if key is not None:
                        done.append((*key, np.packbits(count > 1).tobytes()))
                    key = (line, segment)
                    count[:] = 0
                cells = np.frombuffer(once, "<u2")
                count[cells] = np.minimum(count[cells] + 1, 2)
                count[np.frombuffer(twice, "<u2")] = 2
            if len(done) > 256:
                yield named()
                done.clear()
        if key is not None:
            done.append((*key, np.packbits(count > 1).tobytes()))
        yield named()

    parts = docs.select("text").mapInArrow(partial, "line int, segment int, once binary, twice binary")
    merged = parts.repartition("line", "segment").sortWithinPartitions("line", "segment").mapInArrow(merge, "line int, segment int, often binary")
    often = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    width = (1 << SEGMENT_BITS) // 8
    for line, segment, packed in merged.collect():  # a bitmap of set width, not the corpus
        often[line][segment * width : (segment + 1) * width] = np.frombuffer(bytes(packed), np.uint8)
    return often


def _often(cells: list[np.ndarray], bitmaps: list[np.ndarray]) -> np.ndarray:
    hit = np.ones(len(cells[0]), bool)
    for c, bits in zip(cells, bitmaps):
        hit &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return hit


_FOUND = "h1 long, h2 int, doc_id long, text_key long, at int, settled boolean, places binary"


def _found(columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=["h1", "h2", "doc_id", "text_key", "at", "settled", "places"])


def repeated_places(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """doc_id, text_key, and in at or (many of a row, int32) in places the starts of repeated windows."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, window, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, ids, known, keys, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(new) - 1
            many = np.bincount(group) > 1
            first = order[new]
            null = pa.nulls(len(first), pa.binary())
            for f in range(0, len(first), 1 << 16):
                one = first[f : f + (1 << 16)]
                yield _found([h1[one].view(np.int64), h2[one].view(np.int32), pa.array(ids[one], mask=~known[one]), keys[one], at[one], many[f : f + (1 << 16)], null[f : f + (1 << 16)]])
            settled = order[many[group]]
            settled = settled[np.lexsort((at[settled], keys[settled], ids[settled], known[settled]))]  # rows of a document stand together
            if len(settled):
                change = np.ones(len(settled), bool)
                for x in (ids, keys, known):
                    own = x[settled]
                    change[1:] &= own[1:] == own[:-1]
                change[1:] = ~change[1:]
                fresh = change.copy()
                fresh[1:] |= at[settled[1:]] != at[settled[:-1]]
                settled, change = settled[fresh], change[fresh]  # repeated rows of a document have one set of places
                cuts = np.append(np.flatnonzero(change), len(settled))
                one = settled[cuts[:-1]]
                places = [at[settled[s:e]].astype("<i4").tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
                spread = mix(ids[one].view(np.uint64) + np.arange(len(one), dtype=np.uint64)).view(np.int64)
                yield _found([spread, np.zeros(len(one), np.int32), pa.array(ids[one], mask=~known[one]), keys[one], np.zeros(len(one), np.int32), np.ones(len(one), bool), places])

        size = 0
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            known = ~np.asarray(batch.column("doc_id").is_null())
            ids = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            keys = np.asarray(batch.column("text_key"))
            for a, b in chunks(offsets):
                w = Words(data, offsets[a : b + 1])
                hashes, starts, at, grams = _anchors(w, window)
                if not len(starts):
                    continue
                where, back = np.unique(at, return_inverse=True)
                starts = starts[_often(_cells(grams[where], bits), bitmaps)[back]]
                if not len(starts):
                    continue
                row = w.row[starts]
                h1 = gram_hashes(hashes, window)[starts]
                h2 = gram_sums(w.hashes(1), window)[starts]
                held.append((h1, h2, ids[a + row], known[a + row], keys[a + row], (starts - w.first[row]).astype(np.int32)))
                size += len(starts)
                if size >= HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, matched = None, False  # the row held back, and whether it equals one before it

        def told(t: pa.Table, repeated: np.ndarray) -> pa.RecordBatch:
            many = np.asarray(t["places"].is_valid())
            keep = pa.array(many | (repeated & ~np.asarray(t["settled"])))
            out = t.select(["doc_id", "text_key", "at", "places"]).filter(keep).combine_chunks()
            at = out["at"].combine_chunks() if out.num_rows else pa.array([], pa.int32())
            single = out["places"].combine_chunks().is_null() if out.num_rows else pa.array([], pa.bool_())
            import pyarrow.compute as pc

            return pa.RecordBatch.from_arrays([*[(out[c].combine_chunks() if out.num_rows else pa.array([], kind)) for c, kind in (("doc_id", pa.int64()), ("text_key", pa.int64()))], pc.if_else(single, at, pa.scalar(None, pa.int32())), out["places"].combine_chunks() if out.num_rows else pa.array([], pa.binary())], names=["doc_id", "text_key", "at", "places"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if last is not None:
                t = pa.concat_tables([last, t])
            a, b = np.asarray(t["h1"]), np.asarray(t["h2"])
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            equal = np.zeros(len(a), bool)
            equal[1:] |= same
            equal[:-1] |= same
            if last is not None:
                equal[0] |= matched
            matched = bool(equal[-1])
            last = t.slice(len(a) - 1)
            yield told(t.slice(0, len(a) - 1), equal[:-1])
        if last is not None:
            yield told(last, np.array([matched]))

    found = docs.select("doc_id", "text_key", "text").mapInArrow(candidates, _FOUND)
    dealt = found.repartition("h1").sortWithinPartitions("h1", "h2")
    return dealt.mapInArrow(meet, "doc_id long, text_key long, at int, places binary")


def covered(n_words: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows that start at those places cover."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, np.minimum(at + window, n_words), 1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and kept, its other words joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    places = repeated_places(docs, window, sketch_bits(docs, window))
    places = places.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("at"), F.collect_set("places").alias("places"))
    p = places.select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), "at", "places")
    met = docs.join(p, docs["doc_id"].eqNullSafe(p["p_id"]) & (docs["text_key"] == p["p_key"]), "left").select("doc_id", "text", "at", "places")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(byte_view(batch.column("text"))[1]):
                rows = batch.slice(a, b - a)
                words, removed, kept = [], [], []
                lists = rows.column("at")
                for i, (text, places) in enumerate(zip(rows.column("text").to_pylist(), rows.column("places").to_pylist())):
                    own = (text or "").encode().split()
                    at = np.concatenate([np.asarray(lists[i].values if lists[i].is_valid else [], np.int64), *[np.frombuffer(x, "<i4").astype(np.int64) for x in places or ()]])
                    gone = covered(len(own), at, window) if len(at) else np.zeros(len(own), bool)
                    words.append(len(own))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g] if len(at) else own))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(step, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_cms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT d.doc_id, d.p, d.v, g.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN g ON d.doc_id = g.doc_id AND d.p = g.p),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(v, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
