"""Near-duplicates by similarity: wide SimHash fingerprints of the sets of five-word shingles.

A text's words are its runs of letters and digits, A-Z as lower case. Its shingles, as a set, give a fingerprint
of 256 bits; two sets of Jaccard similarity s have vectors at the angle arccos(2s / (1 + s)), and differ in that
share of pi of their bits: 39 for 0.8. Fingerprints link at ``RADIUS`` bits or fewer, so by the spread of that
number (5.7 bits) about 95 in 100 pairs of similarity 0.8 link, nearly all above 0.85, and few below 0.6.

Candidates meet by tables of distances to reference fingerprints, as in simhash: the 256 bits are dealt into blocks of
``width`` bits, more than once, and each block has its table, the distances within it to every reference (from those
to the reference and to the one complemented there). Fingerprints that agree in a block agree in all its coordinates,
which are the key of a bucket. At this radius no block must be left untouched, so enough tables are made for the width
(``tables``): two fingerprints 39 bits apart miss each other in all of them 2 times in 1,000. The width
grows with the corpus, so that a bucket of unrelated texts has about ``CROWD`` members at most. Within a bucket a pair
is discarded when the coordinates of all 64 blocks of four bits differ by more than the radius in sum (that is no more
than the distance, so no link is lost; of unrelated pairs about one in 1,000 stays), and the survivors are verified.

Equal sets are merged first. In a bucket over ``LARGE`` some leaders are
compared with all members; what is then in the largest group of its bucket is connected already, and only the rest
is compared, with all members outside its own group. So a group of thousands of near copies costs about as many
comparisons as it has members, no pair is written out but linked ones, and no link between candidates is lost.
Where a bucket's rest is large too (pages that share boilerplate and little else), rest and members are dealt over a
grid, so that no task compares more than about ``SIDE`` with ``SIDE`` of them.

Defined results: null and empty texts, and those without such words, form one group; texts under five words are
one shingle; rows that share a doc_id are grouped by their own texts; a group's id is the least doc_id in it, null
if it has none; an empty table has no groups. Columns of docs other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from plotwright.operators.graph import stars

from .common import Words, byte_view, chunks, gram_hashes, mix, written
from .decontaminate import LOWER, SEPARATOR

WORDS, LANES, RADIUS = 5, 4, 48
#: Reference fingerprints, a row of lanes each.
REFERENCES = mix(np.arange(1, 16 * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(16, LANES)
#: Bits of a block at least, members of a bucket of unrelated texts at most, and the share of pairs of similarity 0.8 (39 bits) that may meet in no table.
WIDTH, CROWD, APART, MISSED = 12, 2048, 39, 0.002
#: Members of a bucket from which on leaders are compared first, and how many of these.
LARGE, LEADERS = 4096, 3
#: Pairs that a task takes at once.
TILE = 1 << 16
#: Rows and columns of a bucket that are compared in one piece.
SIDE = 4096
_LANE = mix(np.arange(101, 101 + LANES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: The bits of a byte, one in each byte of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
#: A byte with the ones of each half moved to its low end.
_UNARY = np.array([(1 << (b & 15).bit_count()) - 1 | (1 << (b >> 4).bit_count()) - 1 << 4 for b in range(256)], np.uint8)
_FIELDS = "doc_id long, text_key long, set_key long, " + ", ".join(f"f{k} long" for k in range(LANES))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the hashes of the distinct shingles of each text, by row."""
    w = Words(LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0], SEPARATOR)
    hashes = w.hashes()
    grams = gram_hashes(hashes, words)
    at = np.flatnonzero(w.whole(words))
    rows, found = [w.row[at]], [grams[at]]
    for n in range(1, words):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            rows.append(short)
            found.append(gram_hashes(hashes, n)[w.first[short]])
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: a key of the set and the fingerprint's lanes; zero where there is no set."""
    own, starts, counts = np.unique(row, return_index=True, return_counts=True)
    keys, lanes = np.zeros(rows, np.uint64), np.zeros((rows, LANES), np.uint64)
    if not len(own):
        return keys, lanes
    keys[own] = mix(np.add.reduceat(mix(h ^ np.uint64(0xA5A5)), starts) + counts.astype(np.uint64))
    # bits are summed in bytes over stretches of 255 shingles at most, then by row
    stretches = -(-counts // 255)
    first = np.cumsum(stretches) - stretches
    inner = np.arange(int(stretches.sum())) - np.repeat(first, stretches)
    cuts = np.repeat(starts, stretches) + inner * 255
    for lane in range(LANES):
        octets = mix(h + _LANE[lane]).view(np.uint8).reshape(-1, 8)
        votes = np.empty((len(cuts), 8), np.uint64)
        for k in range(8):
            votes[:, k] = np.add.reduceat(_SPREAD[octets[:, k]], cuts)
        each = np.add.reduceat(votes.view(np.uint8), first, axis=0, dtype=np.int64)
        lanes[own, lane] = np.packbits(2 * each > counts[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return keys, lanes


def shingle_prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key (a hash of the text), set_key and the fingerprint's lanes of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for a, b in chunks(offsets):
                row, h = shingle_sets(data, offsets[a : b + 1], words)
                keys, lanes = sketches(row, h, b - a)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("text_key"), pa.array(keys.view(np.int64)), *[pa.array(np.ascontiguousarray(lanes[:, k]).view(np.int64)) for k in range(LANES)]],
                    names=["doc_id", "text_key", "set_key", *[f"f{k}" for k in range(LANES)]],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(step, _FIELDS)


def tables(width: int) -> int:
    """How many blocks of that many bits it takes for pairs APART bits apart to agree in one, but for the share MISSED."""
    return math.ceil(math.log(MISSED) / math.log(1 - (1 - APART / (64 * LANES)) ** width))


def masks(width: int) -> np.ndarray:
    """The blocks, a row of lanes each: bits dealt in a new order each time that they are used up."""
    bits, each = 64 * LANES, 64 * LANES // width
    out = np.zeros((tables(width), bits), np.uint8)
    for k in range(len(out)):
        order = np.argsort(mix(np.arange(bits, dtype=np.uint64) + np.uint64((k // each + 1) << 20)))
        out[k, order[k % each * width :][:width]] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _distances(lanes: np.ndarray, reference: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(lanes[k] ^ reference[k]).astype(np.int16) for k in range(LANES))


def block_keys(lanes: np.ndarray, width: int) -> np.ndarray:
    """A key of each block, a column each, made of its coordinates: the distances within it to all references. lanes has a row a lane."""
    blocks = masks(width)
    whole = [_distances(lanes, r) for r in REFERENCES]
    keys = np.empty((lanes.shape[1], len(blocks)), np.uint64)
    for b, mask in enumerate(blocks):
        key = np.full(lanes.shape[1], b + 1, np.uint64)
        for r, to in zip(REFERENCES, whole):
            inside = (to - _distances(lanes, r ^ mask) + width) >> 1
            key = mix(key * np.uint64(31) + inside.astype(np.uint64))
        keys[:, b] = key
    return keys


def with_keys(sets: DataFrame, width: int) -> DataFrame:
    """sets (node, lanes) with bands: the keys of all blocks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(LANES)])
            keys = block_keys(lanes, width)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "bands"])

    rows = sets.select("node", *[f"f{k}" for k in range(LANES)])
    return rows.mapInArrow(step, StructType([*rows.schema.fields, StructField("bands", ArrayType(LongType()))]))


def coordinates(x: np.ndarray) -> np.ndarray:
    """Per fingerprint (a column, a row a lane) its distances to the first reference within each of the 64 blocks of four bits, as numbers of ones."""
    apart = np.ascontiguousarray(x ^ REFERENCES[0][:, None])
    return _UNARY[apart.view(np.uint8)].view(np.uint64)


def survivors(table: np.ndarray, group: np.ndarray, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j, first <= i < last, of different groups whose coordinates do not differ by more than the radius in sum."""
    # a sum of 256 shows as 0, and is left to the exact distance
    total = sum(np.bitwise_count(t[first:last, None] ^ t[None, first:]) for t in table)
    i, j = np.nonzero((total <= radius) & (group[first:last, None] != group[None, first:]))
    later = j > i
    return i[later] + first, j[later] + first


def bucket_links(x: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """The ends of links that connect whatever pairs of x (a row a lane) within the radius connect: a spanning forest."""
    n = x.shape[1]
    table, group, high = coordinates(x), np.arange(n), max(1, TILE // n)
    one, other = [], []
    for first in range(0, n - 1, high):
        i, j = survivors(table, group, first, min(first + high, n), radius)
        near = _distances(x[:, i], x[:, j]) <= radius
        i, j = i[near], j[near]
        if not len(i):
            continue
        at, starts = np.unique(i, return_index=True)
        for k, met in zip(at.tolist(), np.split(j, starts[1:])):
            new = met[group[met] != group[k]]
            if len(new):
                joined, which = np.unique(group[new], return_index=True)
                one += [k] * len(joined)
                other += new[which].tolist()
                group[np.isin(group, joined)] = group[k]
    return one, other


def _small_links(entries: DataFrame, radius: int) -> DataFrame:
    """Links within buckets of entries (key, node, lanes), a whole bucket in a task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None:
                return
            key = held.column("key").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            if batch is not None:
                cuts = cuts[:-1]  # the last bucket may go on
            x = np.stack([held.column(f"f{k}").to_numpy().view(np.uint64) for k in range(LANES)])
            ends = ([], [])
            for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                for all_ends, own in zip(ends, bucket_links(x[:, cuts[k] : cuts[k + 1]], radius)):
                    all_ends += [int(cuts[k]) + e for e in own]
            if ends[0]:
                node = held.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(e, pa.int64())) for e in ends], names=["a", "b"])
            held = held.slice(int(cuts[-1]))

    kind = entries.schema["node"].dataType
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(step, StructType([StructField("a", kind), StructField("b", kind)]))


def _with_coordinates(entries: DataFrame) -> DataFrame:
    """entries with c0 to c3, their coordinates as numbers of ones."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = coordinates(np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(LANES)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(t.view(np.int64)) for t in table]], names=[*batch.schema.names, *[f"c{k}" for k in range(LANES)]])

    return entries.mapInArrow(step, StructType([*entries.schema.fields, *[StructField(f"c{k}", LongType()) for k in range(LANES)]]))


def _near(one: str, other: str, radius: int) -> Column:
    """Whether neither the coordinates nor the fingerprints of two entries differ by more than the radius."""
    apart = [[F.bit_count(F.col(f"{one}.{c}{k}").bitwiseXOR(F.col(f"{other}.{c}{k}"))) for k in range(LANES)] for c in "cf"]
    return (sum(apart[0][1:], apart[0][0]) <= radius) & (sum(apart[1][1:], apart[1][0]) <= radius)


def links(sets: DataFrame, radius: int = RADIUS, large: int = LARGE, side: int = SIDE) -> DataFrame:
    """Links a, b that connect all nodes of sets (node, lanes, bands) that share a band within the radius."""
    keyed = sets.select("node", *[f"f{k}" for k in range(LANES)], F.posexplode("bands").alias("band", "key")).withColumn("key", F.xxhash64("band", "key")).drop("band")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    busy = written(counts.where(F.col("n") > min(large, side)), "busy")
    if not busy.limit(1).count():
        return _small_links(keyed, radius).distinct()
    found = _small_links(keyed.join(busy, "key", "left_anti"), radius)
    return found.union(_large_links(written(_with_coordinates(keyed.join(busy, "key")), "crowds"), radius, large, side)).distinct()


def _large_links(met: DataFrame, radius: int, large: int, side: int) -> DataFrame:
    """Links within large buckets of entries (key, node, lanes, n, coordinates): leaders first, then the rest over a grid."""
    lanes = [f"{c}{k}" for c in "fc" for k in range(LANES)]
    hot = met.where(F.col("n") > large)
    early = None
    if hot.limit(1).count():
        by = [F.min_by(F.struct("node", *lanes), F.xxhash64("node", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
        chosen = hot.groupBy("key").agg(*by)
        pairs = hot.alias("m").join(chosen, "key").select(F.col("m.node").alias("b"), F.explode(F.array(*[F.when(_near("m", f"l{k}", radius) & (F.col("m.node") != F.col(f"l{k}.node")), F.col(f"l{k}.node")) for k in range(LEADERS)])).alias("a"))
        early = written(pairs.where("a is not null").select("a", "b").distinct(), "leaders")
        roots = written(stars(early, "a", "b"), "early")
        met = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        met = met.withColumn("root", F.col("node"))
    groups = met.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.sum("c").alias("all"), F.max("c").alias("c"))
    cuts = lambda n: F.greatest(F.ceil(n / side), F.lit(1)).cast("int")
    most = groups.where("all > c").select("key", "most", cuts(F.col("all") - F.col("c")).alias("down"), cuts(F.col("all")).alias("across"))
    told = written(met.select("key", "node", "root", *lanes).join(most, "key"), "groups")
    place = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    u = told.where("root <> most").withColumn("i", place(F.col("down"))).withColumn("j", each("across")).alias("u")
    t = told.withColumn("j", place(F.col("across"))).withColumn("i", each("down")).alias("t")
    once = (F.col("t.root") == F.col("t.most")) | (F.col("u.node") < F.col("t.node"))
    piece = [F.col(f"u.{c}") == F.col(f"t.{c}") for c in ("key", "i", "j")]
    near = u.join(t, piece[0] & piece[1] & piece[2] & (F.col("u.root") != F.col("t.root")) & once & _near("u", "t", radius))
    late = near.select(F.col("u.root").alias("a"), F.col("t.root").alias("b"))
    return late if early is None else late.union(early)


def similar(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """doc_id, text_key, component_id and root of every row of docs."""
    prints = written(shingle_prints(docs, words), "shingles")
    node = F.struct("set_key", "f0")
    lanes = [f"f{k}" for k in range(1, LANES)]
    sets = prints.groupBy("set_key", "f0").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in lanes])
    sets = written(sets.withColumn("node", node), "sets")
    width = max(WIDTH, math.ceil(math.log2(max(1, sets.count()) / CROWD)))
    roots = stars(links(with_keys(sets.where("set_key <> 0"), width), radius, large), "a", "b")
    found = sets.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(found.join(least, "root").select(F.col("node.set_key").alias("set_key"), F.col("node.f0").alias("f0"), "root", "component_id"), "components")
    return prints.select("doc_id", "text_key", "set_key", "f0").join(ids, ["set_key", "f0"]).select("doc_id", "text_key", "component_id", "root")
