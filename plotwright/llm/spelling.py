"""Spelling variants: which words of a corpus are a single edit from a far more frequent one.

Runs of letters are found over bytes, counted by task and then by Spark as strings. Words that can be one edit apart
are compared by dense prefix-suffix tiles: a block of words is a matrix of code points padded on the right and one
padded on the left; of all pairs of two blocks the common prefix and the common suffix are counted at once, and
together they reach the longer length minus one exactly if the words are a single edit apart.

Only blocks that share text meet. For each longer length M the place of the edit lies in one of two zones of
0..M-1, and outside its zone the longer and the shorter word agree; so words are dealt by (M, zone, the text before
and behind it), and a pair is taken in the zone that holds its common prefix length, once. A group of more than
``most`` words is dealt again by the halves of its zone. A zone of one place holds words that differ in one letter
at most, no more than the alphabet, so that groups stay bounded however words are spread. A task passes on what a
word's partners come to (number, and the most frequent one), never the pairs.

Defined results: null texts have no words; a null doc_id counts as no digits in the hashed string; rows that share
a doc_id are counted each; an empty table has no words. Of docs only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, chunks, documents, span_hashes, written

#: Letters are A-Z, a-z and U+00C0 to U+00FF; a run loses a letter where its CRC-32 is divisible by DELETE_EVERY.
DELETE_EVERY = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form is its near word that is at least so many times as frequent.
FORM_RATIO = 10
#: Words of a group that are compared without dealing it again, and bytes of code points compared at once.
MOST, TILE_BYTES = 2048, 1 << 24
#: Lengths up to which words share matrices; the widest have matrices of as many rows as TILE_BYTES holds.
WIDTHS = (12, 24, 64, 512)
#: Bytes of text whose runs are counted together before they go to Spark.
COUNT_BYTES = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ _POLYNOMIAL, table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


def passed_zeros(crc: np.ndarray, n: int) -> np.ndarray:
    """The registers after n more bytes of zero: what a CRC-32 contributes to that of a text n bytes longer."""
    for _ in range(n):
        crc = crc >> 8 ^ _TABLE[crc & 0xFF]
    return crc


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of all spans, a byte of each at a time."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    size, at, k = ends - starts, np.arange(len(starts)), 0
    while len(at):
        at = at[size[at] > k]
        crc[at] = crc[at] >> 8 ^ _TABLE[(crc[at] ^ data[starts[at] + k]) & 0xFF]
        k += 1
        if k == 256 and len(at):  # the few longer ones
            for i in at.tolist():
                crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
            break
    return ~crc


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of letters. U+00C0 to U+00FF are 0xC3 and one more byte in UTF-8."""
    n = len(data)
    inside = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)
    inside[lead] = inside[np.minimum(lead + 1, n - 1)] = True
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_counts(doc_ids: list, data: np.ndarray, offsets: np.ndarray, least: int = LEAST_LENGTH, every: int = DELETE_EVERY) -> tuple[list[bytes], list[int]]:
    """The words of some texts, letters deleted by the rule, with the number of times each occurs."""
    data = _LOWER[data[offsets[0] : offsets[-1]]]
    if not len(data):
        return [], []
    starts, ends, row = letter_runs(data, offsets - offsets[0])
    points = (ends - starts) - np.diff(np.concatenate([[0], np.cumsum(data == 0xC3)])[np.stack([starts, ends], 1)], axis=1).ravel()
    long = np.flatnonzero(points >= least)
    starts, ends, row, points = starts[long], ends[long], row[long], points[long]
    if not len(starts):
        return [], []
    _, one, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    # CRC(prefix + run) = CRC(run) ^ the prefix's CRC, passed through as many zeros as the run has bytes
    crcs, size = span_crcs(data, starts[one], ends[one])[back], ends - starts
    prefix = np.array([zlib.crc32(b"%s:" % (b"" if d is None else b"%d" % d)) for d in doc_ids], np.uint32)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    have, shifted = 0, prefix
    for part in np.split(order, cuts):
        n = int(size[part[0]])
        shifted, have = passed_zeros(shifted, n - have), n
        crcs[part] ^= shifted[row[part]]
    hit = crcs % np.uint32(every) == 0
    counts = np.bincount(back[~hit], minlength=len(one))
    text = data.tobytes()
    kept = np.flatnonzero(counts)
    words = [text[s:e] for s, e in zip(starts[one[kept]].tolist(), ends[one[kept]].tolist())]
    found, n = words, counts[kept].tolist()
    hit &= points > least
    deleted: dict[tuple[int, int], int] = {}
    for i, p in zip(back[hit].tolist(), (crcs[hit] % points[hit]).tolist()):
        deleted[i, p] = deleted.get((i, p), 0) + 1
    for (i, p), c in deleted.items():
        run = text[starts[one[i]] : ends[one[i]]].decode()
        found.append((run[:p] + run[p + 1 :]).encode())
        n.append(c)
    return found, n


def words(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of the corpus of so many letters and occurrences."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = byte_view(batch.column("text"))
            for first, end in chunks(offsets, COUNT_BYTES):
                found, n = run_counts(doc_ids[first:end], data, offsets[first : end + 1], least)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Block:
    """Words of one group as two matrices of code points, padded on the right and on the left."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int32)
        wide = int(self.size.max())
        self.left = np.array(texts, f"<U{wide}").view(np.uint32).reshape(len(texts), wide)
        self.right = np.array([t.rjust(wide, "\0") for t in texts], f"<U{wide}").view(np.uint32).reshape(len(texts), wide)
        if self.left.max() < 1 << 16:
            self.left, self.right = self.left.astype(np.uint16), self.right.astype(np.uint16)


def _agreeing(same: np.ndarray) -> np.ndarray:
    """How many leading flags of the last axis are set."""
    ahead = same.argmin(-1)
    return np.where(np.take_along_axis(same, ahead[..., None], -1)[..., 0], same.shape[-1], ahead)


def near_pairs(block: Block, a: np.ndarray, b: np.ndarray, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which pairs of rows are a single edit apart in the zone lo to hi; the longer word of each has that length."""
    prefix = _agreeing(block.left[a] == block.left[b])
    suffix = _agreeing((block.right[a] == block.right[b])[:, ::-1])
    short = np.minimum(block.size[a], block.size[b])
    prefix, suffix = np.minimum(prefix, short), np.minimum(suffix, short)
    return (np.maximum(block.size[a], block.size[b]) == longer) & (prefix + suffix >= longer - 1) & (prefix >= lo) & (prefix < hi)


def tiles(ends: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, a tile at a time; ends has of each row the end of its group.

    A run of rows is the one block, all that follow in their groups are the other; a tile has about TILE_BYTES.
    """
    after = ends - np.arange(len(ends)) - 1
    total, first = np.cumsum(after), 0
    while first < len(ends):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + TILE_BYTES // (4 * wide), side="right")))
        size = after[first:last]
        a = np.repeat(np.arange(first, last), size)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        first = last


def partners(texts: list[str], n: np.ndarray, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray, ends: np.ndarray) -> list[tuple[str, int, int, str]]:
    """word, number of near words, and the most frequent of these (n, word; ties to the least), of the words of some groups that have any.

    Rows of a group stand together in order of their words.
    """
    block = Block(texts)
    ones, others = [], []
    for a, b in tiles(ends, block.left.shape[1]):
        near = near_pairs(block, a, b, longer[a], lo[a], hi[a])
        ones += [a[near], b[near]]
        others += [b[near], a[near]]
    one, other = np.concatenate(ones), np.concatenate(others)
    order = np.lexsort((other, -n[other], one))
    row, first, count = np.unique(one[order], return_index=True, return_counts=True)
    best = other[order][first]
    return [(texts[r], c, int(n[w]), texts[w]) for r, c, w in zip(row.tolist(), count.tolist(), best.tolist())]


def whole_groups(ends: np.ndarray, wide: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold whole groups, whose matrices have about TILE_BYTES, one group at least."""
    first, most = 0, max(1, TILE_BYTES // (4 * wide))
    while first < len(ends):
        last = min(first + most, len(ends))
        if last < len(ends):
            begin = int(np.searchsorted(ends, ends[last]))
            last = begin if begin > first else int(np.searchsorted(ends, ends[last], side="right"))
        yield first, last
        first = last


def dealt(found: DataFrame) -> DataFrame:
    """word, n, longer, lo, hi, key: each word in both zones of its own length, and of the next one for partners a letter longer."""
    length = F.char_length("word")
    return halved(found.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer")).withColumns({"lo": F.lit(0), "hi": F.col("longer")}))


def halved(zones: DataFrame) -> DataFrame:
    """The same words in the two halves of their zones, with the key of what lies before and behind these."""
    middle = F.expr("cast((lo + hi) div 2 as int)")
    both = F.array(F.struct(F.col("lo").alias("l"), middle.alias("h")), F.struct(middle.alias("l"), F.col("hi").alias("h")))
    half = zones.withColumn("zone", F.explode(both)).select("word", "n", "longer", F.col("zone.l").alias("lo"), F.col("zone.h").alias("hi"))
    text = F.concat(F.expr("left(word, lo)"), F.lit(" "), F.expr("right(word, longer - hi)"))
    return half.withColumn("key", F.xxhash64("longer", "lo", "hi", text))


def compared(zones: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: per group, of words that have a near one in it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table, key: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(cuts)
            ends = np.repeat(cuts[1:], size)
            longer, rows = table.column("longer").to_numpy(), []
            several = np.repeat(size, size) > 1
            for least, most in zip((0, *WIDTHS), (*WIDTHS, 1 << 31)):  # words of similar length share matrices
                own = np.flatnonzero(several & (longer > least) & (longer <= most))
                for first, last in whole_groups(ends[own], most if most < 1 << 31 else int(longer[own].max(initial=1))):
                    part = table.take(own[first:last])
                    group = ends[own[first:last]]
                    rows += partners(part.column("word").to_pylist(), *(part.column(c).to_numpy() for c in ("n", "longer", "lo", "hi")), np.searchsorted(group, group, side="right"))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        held: list[pa.RecordBatch] = []  # the last group so far, which the next batch may carry on
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            held = table.slice(last).to_batches()
            if last:
                yield found(table.slice(0, last), key[:last])
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield found(table, table.column("key").to_numpy())

    near = zones.repartition("key").sortWithinPartitions("key", "word")
    return near.mapInArrow(step, "word string, n_near long, best_n long, best string")


def near_words(found: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, best_n, best: per word that has a near word, how many, and the most frequent one (ties: the least)."""
    zones, parts = dealt(found), None
    while True:  # a zone is halved at most as often as its length can be
        zones = written(zones, "zones")
        hot = zones.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("wide")).where((F.col("size") > most) & (F.col("wide") > 1)).select("key")
        hot = written(hot, "hot-zones")
        more = hot.limit(1).count()
        part = compared(zones.join(hot, "key", "left_anti") if more else zones)
        parts = part if parts is None else parts.unionByName(part)
        if not more:
            break
        zones = halved(zones.join(hot, "key", "left_semi"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("of")).select("word", "n_near", (-F.col("of.n")).alias("best_n"), F.col("of.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each word that has a form (columns word, form): forms followed to the last, twice as far a round."""
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:  # n grows by the ratio with each form, so a chain has no more links than the largest n has digits
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = links.join(ahead, "root", "left")
        if not found.where("next is not null").limit(1).count():
            return links
        links = written(found.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the corpus."""
    found = written(words(docs, least, least_count), "words")
    near = near_words(found, most)
    taken = F.col("best_n") >= ratio * F.col("n")
    one = found.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    one = written(one, "variants")
    led = roots(one.where("form is not null"))
    return one.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
