"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

Equal fingerprints are merged first. Of each distinct one a table of Hamming distances to the reference
fingerprints is kept: some random ones, and each of these with one block of bits complemented. The difference of two
such coordinates depends on that block alone, and two fingerprints at most two bits apart agree in at least two of
four blocks, so in all coordinates of one of the six pairs of blocks: those coordinates are the keys by which
candidates meet. A bucket over ``bucket_most`` fingerprints is dealt again in the same way, by the coordinates of
the four halves of its two other blocks, and once more by the halves of those: what then meets has equal coordinates in
four blocks, two halves and two quarters (but for unequal blocks with equal coordinates, which are few, 56 of 64
bits), so that no bucket grows with the corpus. Within a bucket a pair with a coordinate that differs by more than
the limit is discarded, and the survivors are verified.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows that share a doc_id
are linked by their own texts; a component's id is the least doc_id in it, null if it has none; an empty table
has no components. Columns of docs other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwright.operators.graph import stars

from .common import byte_view, chunks, documents, mix, written
from .wide_simhash import similar

BITS, MOST_BITS, BLOCKS = 64, 2, 4
REFERENCES = [int(x) for x in mix(np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
MASKS = [0xFFFF << (16 * b) for b in range(BLOCKS)]
PAIRS = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
BUCKET_MOST = 512
#: Links that a task holds before it passes them on.
LINKS_HELD = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ends = list(accumulate((len(w) + 1 for w in found)))
    line = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(line[s : e - 1], 42) for s, e in zip([0, *ends], ends[min(words, len(found)) - 1 :])], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for first in range(0, n, 1 << 14):
        votes += np.unpackbits(h[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for a, b in chunks(byte_view(batch.column("text"))[1]):
                made += [_signed(fingerprint(t, words)) for t in batch.column("text")[a:b].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(made, pa.int64())], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(step, "doc_id long, text_key long, fp long")


def _distance(fp: Column, reference: Column) -> Column:
    return F.bit_count(fp.bitwiseXOR(reference))


def block_key(fp: Column, mask: Column) -> Column:
    """The distances within a block (its bits set in mask) to the random references, from those to them and to their complements there."""
    key, size = F.lit(0).cast("long"), F.bit_count(mask)
    for r in REFERENCES:
        reference = F.lit(_signed(r))
        inside = F.shiftright(_distance(fp, reference) - _distance(fp, reference.bitwiseXOR(mask)) + size, 1)
        key = F.shiftleft(key, 5).bitwiseOR(inside.cast("long"))
    return key


def _halves(mask: Column, width: int) -> list[Column]:
    """The lower and the upper half of a block of that many bits."""
    return [mask.bitwiseAND(F.shiftrightunsigned(mask, width // 2)), mask.bitwiseAND(F.shiftleft(mask, width // 2))]


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """rows (fp, bucket, blocks: four masks of that width) once for each pair of blocks: their new bucket, and the halves of the other two."""
    keyed = rows.withColumn("k", F.array(*[block_key(F.col("fp"), F.col("blocks")[b]) for b in range(BLOCKS)]))
    ways = []
    for a, b in PAIRS:
        c, d = (x for x in range(BLOCKS) if x not in (a, b))
        halves = F.array(*_halves(F.col("blocks")[c], width), *_halves(F.col("blocks")[d], width))
        ways.append(F.struct(F.xxhash64("bucket", F.lit(a), F.lit(b), F.col("k")[a], F.col("k")[b]).alias("bucket"), halves.alias("blocks")))
    return keyed.select("fp", F.explode(F.array(*ways)).alias("way")).select("fp", "way.*")


def _bucket_links(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links that connect whatever pairs within most bits connect: a spanning forest."""
    x = np.unique(members).view(np.uint64)
    reference = np.array([*REFERENCES, *(r ^ m for r in REFERENCES for m in MASKS)], np.uint64)
    table = np.bitwise_count(x[:, None] ^ reference[None, :]).astype(np.int8)
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    one, other = [], []
    for i in range(len(x) - 1):
        near = i + 1 + np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= most)
        for j in near[np.bitwise_count(x[near] ^ x[i]) <= most].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                one.append(i)
                other.append(j)
    return x[one].view(np.int64), x[other].view(np.int64)


def links(fps: DataFrame, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """Links a, b that connect all distinct fingerprints (column fp) within MOST_BITS of each other."""
    rows = fps.select("fp", F.lit(0).cast("long").alias("bucket"), F.array(*[F.lit(_signed(m)) for m in MASKS]).alias("blocks"))
    found = None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            held, size = [], 0
            for k in range(len(cuts) - 1):
                held.append(_bucket_links(values[cuts[k] : cuts[k + 1]], MOST_BITS))
                size += len(held[-1][0])
                if size >= LINKS_HELD or k == len(cuts) - 2:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[e] for h in held])) for e in (0, 1)], names=["a", "b"])
                    held, size = [], 0

    for width in (16, 8, 4):
        keyed = dealt(rows, width)
        counts = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        met = written(keyed.join(counts, "bucket"), "buckets")
        small = met if width == 4 else met.where(F.col("n") <= bucket_most)
        own = small.groupBy("bucket").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(step, "a long, b long")
        found = own if found is None else found.union(own)
        rows = met.where(F.col("n") > bucket_most).select("fp", "bucket", "blocks")
        if width == 4 or not rows.limit(1).count():
            break
    return found.distinct()


def components(prints: DataFrame, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """prints (doc_id, text_key, fp) with component_id and root, the least fingerprint of the component."""
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = stars(links(fps.select("fp"), bucket_most), "a", "b")
    members = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "least")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    ids = fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(written(ids, "components"), "fp", "left")  # a plain shuffle of both: a hot fingerprint is split at run time


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key, fp, component_id and root of every row of docs."""
    return components(written(fingerprints(docs, words), "fingerprints"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without near-duplicates by similarity (see wide_simhash): of each group the row with the least doc_id (then text hash) stays."""
    found = similar(docs, words)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("of")).select(F.col("of.doc_id").alias("__id"), F.col("of.text_key").alias("__text"))
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__key": F.xxhash64("text")})
    met = keyed.join(kept, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")))
    first = F.row_number().over(Window.partitionBy("__doc", "__key").orderBy("__key"))
    return met.withColumn("__row", first).where("__row = 1").select(docs.columns)


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
