"""Benchmark decontamination: normalised test n-grams are broadcast as a hash set, training windows scanned, hits verified.

A benchmark is a stated query set of bounded size. It is broadcast in blocks of at most ``block_bytes`` of text (one
item at least): the normalised words once, and 20 bytes a window beside them (its hash, its place there, its item),
sorted by hash, equal windows together. A word takes two bytes or more, so a block of 4 MB has at most 2 million windows
and 44 MB; a larger benchmark makes more blocks. A map step looks into up to ``STAGE_BLOCKS`` of them (352 MB), and a
benchmark of more takes one more step over the same rows for each so many. Nothing is shuffled, and tasks build nothing
but a bitmap of the hashes. A window of a document whose hash is found is compared word by word, with one of the equal
windows of the items, whose ids are put together once a task.

Defined results: null and empty texts have no words and no hits; an item shorter than the window is a window
itself, an item without words is none; rows that share a doc_id are judged one by one; items that share an
item_id count once; a null item_id marks its hits but is not counted or listed. decontaminate() keeps the input's
columns, whatever their names; in scan() columns of the names added here give way to the new ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, byte_view, chunks, documents, gram_hashes

#: Bytes that end a word: all of ASCII but digits and letters, once A-Z is lower case.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BLOCK_BYTES = 4 << 20
#: Blocks that one map step holds.
STAGE_BLOCKS = 8
_MADE = {"__n_words": "long", "__hit_spans": "array<array<int>>", "__item_ids": "array<string>"}


@dataclass
class Windows:
    """The windows of some items, by number of words: sorted hashes, and for each its first and end byte in text and its item."""

    text: bytes
    items: list[str | None]
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def bitmaps(self) -> dict[int, np.ndarray]:
        """By number of words a bitmap of eight bits a window or more, by the hashes' first bits."""
        out = {}
        for size, (hashes, *_) in self.by_size.items():
            bits = max(16, int(len(hashes)).bit_length() + 3)
            out[size] = np.zeros(1 << bits, bool)
            out[size][(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        return out


def windows_of(items: list[tuple[object, str | None]], size: int) -> Windows:
    """The windows of the items' normalised words; an item of fewer words is one."""
    data, offsets = byte_view(pa.array([t for _, t in items], pa.large_string()))
    w = Words(LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0], SEPARATOR)
    lengths = w.ends - w.starts
    text = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts.tolist(), w.ends.tolist()))
    first = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
    last = (first + lengths).astype(np.int32)
    hashes, by_size = w.hashes(), {}
    for n in range(1, size + 1):
        at = np.flatnonzero(w.whole(n) & (w.counts[w.row[: max(0, len(w.row) - n + 1)]] == n)) if n < size else np.flatnonzero(w.whole(n))
        if len(at):
            h = gram_hashes(hashes, n)[at]
            order = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] + np.uint64(1), append=h[order[-1:]] + np.uint64(1)))
            for lo, hi in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):  # by text, where windows are equal
                order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda k: (text[first[at[k]] : last[at[k] + n - 1]], k))
            by_size[n] = h[order], first[at[order]], last[at[order] + n - 1], w.row[at[order]].astype(np.int32)
    return Windows(text, [None if i is None else str(i) for i, _ in items], by_size)


def scan_rows(text: pa.Array, windows: Windows, bitmaps: dict[int, np.ndarray], found: dict[tuple[int, int], frozenset] | None = None) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per row: words, merged spans of hit words (first, end), and ids of the items found; found keeps the ids of windows that have been hit."""
    data, offsets = byte_view(text)
    out, found = [], {} if found is None else found
    for a, b in chunks(offsets):
        w = Words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], SEPARATOR)
        words = w.hashes()
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        seen: set[tuple[int, int, int]] = set()
        for size, (hashes, first, last, item) in windows.by_size.items():
            grams, bits = gram_hashes(words, size), bitmaps[size]
            near = np.flatnonzero(bits[(grams >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)] & w.whole(size))
            low, high = (np.searchsorted(hashes, grams[near], side=side) for side in ("left", "right"))
            for i, lo, hi in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                own = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[i : i + size].tolist(), w.ends[i : i + size].tolist()))
                ends = windows.text[first[lo] : last[lo]] == own, windows.text[first[hi - 1] : last[hi - 1]] == own
                if not all(ends):  # other windows of the same hash: a search among the sorted ones
                    same = [k for k in range(lo, hi) if windows.text[first[k] : last[k]] == own]
                    if not same:
                        continue
                    lo, hi = same[0], same[-1] + 1
                row = int(w.row[i])
                at = i - int(w.first[row])
                spans.setdefault(row, []).append((at, at + size))
                if (row, size, lo) not in seen:
                    seen.add((row, size, lo))
                    if (size, lo) not in found:
                        found[size, lo] = frozenset(name for k in item[lo:hi].tolist() if (name := windows.items[k]) is not None)
                    items.setdefault(row, set()).update(found[size, lo])
        out += [(int(w.counts[r]), merged(spans.get(r, ())), items.get(r, set())) for r in range(b - a)]
    return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int) -> int:
    """How many hash blocks the benchmark needs so that a block has about block_bytes of text."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def _found(docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns of _MADE, whose names no table bears."""
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, block_bytes)
    out = docs.withColumns({name: F.lit(0).cast(kind) if kind == "long" else F.expr(f"cast(array() as {kind})") for name, kind in _MADE.items()})
    schema = out.schema
    own = benchmark.select("item_id", "text", F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("block"))
    for start in range(0, blocks, STAGE_BLOCKS):
        held = range(start, min(start + STAGE_BLOCKS, blocks))
        rows: dict[int, list[tuple]] = {block: [] for block in held}
        for r in own.where(F.col("block").between(held[0], held[-1])).toLocalIterator():
            rows[r[2]].append((r[0], r[1]))
        shared = [spark.sparkContext.broadcast(windows_of(part, size)) for part in rows.values()]

        def step(batches, shared=shared):
            looked = [(s.value, s.value.bitmaps(), {}) for s in shared]
            for batch in batches:
                words, spans, items = [0] * len(batch), batch.column("__hit_spans").to_pylist(), batch.column("__item_ids").to_pylist()
                for windows, bitmaps, found in looked:
                    for r, (n, new, names) in enumerate(scan_rows(batch.column("text"), windows, bitmaps, found)):
                        words[r] = n
                        if new:
                            spans[r], items[r] = merged([*map(tuple, spans[r]), *new]), sorted({*items[r], *names})
                made = {"__n_words": pa.array(words, pa.int64()), "__hit_spans": pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32()))), "__item_ids": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

        out = out.mapInArrow(step, schema)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (array of first and end word) and item_ids (sorted as strings)."""
    names = {name: name[2:] for name in _MADE}
    own = [c for c in docs.columns if c not in names.values()]
    return _found(docs.select(own), benchmark, size, block_bytes).withColumnsRenamed(names)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, whole: bool = True) -> DataFrame:
    """docs without the hit words, or (whole) without the documents that hold any; the columns of docs remain.

    Without whole, each run of hit words goes with the text between its words, and n_chars is counted anew.
    """
    found = _found(docs, benchmark, size)
    if whole:
        return found.where(F.size("__hit_spans") == 0).select(docs.columns)
    hit = F.size("__hit_spans") > 0
    out = found.withColumn("text", F.when(hit, cut("text", "__hit_spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


@F.pandas_udf(T.StringType())
def cut(texts, spans):
    """The texts without their words of the given spans."""
    import pandas as pd

    out = []
    for text, own in zip(texts, spans):
        raw = (text or "").encode()
        w = Words(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), SEPARATOR)
        at, kept = 0, []
        for s, e in own:
            kept.append(raw[at : w.starts[s]])
            at = int(w.ends[e - 1])
        out.append(b"".join([*kept, raw[at:]]).decode(errors="ignore"))
    return pd.Series(out)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = n_hit(F.col("hit_spans"))
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
