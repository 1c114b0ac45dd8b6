"""Ranked lexical search: the highest-scoring documents of each item, by buckets of impact vectors of similar length.

A first pass finds of each text the terms that items ask for, by hash, and writes them with their counts and the
number of all terms. Corpus statistics come from that table. A second pass turns each row into a vector of integer
impacts and ranks a batch of rows by norm; runs of them are the buckets. For an item whose ten best so far have the
score t or more, a bucket is discarded

* if the product of the item's norm and the bucket's greatest norm is under t (Cauchy-Schwarz), or
* if the item's products with the bucket's greatest coordinates add up to less than t.

Inside a bucket the terms with the greatest such products are summed until the rest of them cannot reach t: documents
with none of these are out, and so are those whose partial score and the bound of the rest (the lesser of the sum of
the remaining coordinates and the product of the remaining norms) stay under t. Survivors are scored in 64-bit
integers. Bounds are never under the score, and a document is discarded only strictly under t, so ties stay whole.
(Intervals of single coordinates, as for dense vectors of unit length, discard nothing here: the best scores are a
small part of the product of the norms.)

What a task keeps are an item's ten best; their final order is a window over these. The terms of the items are
broadcast in blocks of about ``block_bytes`` of item text, one block being one search; nothing else is.

Defined results: null texts have no terms and are not counted; items without known terms, or null, have no row; equal
rows of items count once, rows that share an item_id are ranked each; documents that share a doc_id are ranked each;
null ids come after all others of equal score; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, byte_view, chunks, documents, written
from .decontaminate import blocks_of

TOP = 10
#: Fixed values of the score: saturation in thousandths and the share of the length in it, in hundredths.
SATURATION_PER_MILLE, LENGTH_PERCENT = 8, 75
UNIT = 1_000_000_000
#: Vectors of a bucket, and bytes of item text whose terms are broadcast at once.
BUCKET, BLOCK_BYTES = 1024, 1 << 24

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    words = Words(_LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0], SEPARATOR)
    return words.hashes(), words


class Asked:
    """The terms of some items: sorted hashes, and of each item the terms' numbers and how often it has them."""

    def __init__(self, texts: list[str]):
        data, offsets = byte_view(pa.array(texts, pa.large_string()))
        hashes, words = term_hashes(data, offsets)
        self.hashes, at = np.unique(hashes, return_inverse=True)
        self.terms, self.times = [], []
        for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            terms, times = np.unique(at[first:end], return_counts=True)
            self.terms.append(terms.astype(np.int64))
            self.times.append(times.astype(np.int64))


def found_terms(batch: pa.RecordBatch, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, n (all terms), terms (numbers of asked ones, ascending) and counts of each row that has a term."""
    ids = batch.column("doc_id")
    data, offsets = byte_view(batch.column("text"))
    for first, end in chunks(offsets):
        own, words = term_hashes(data, offsets[first : end + 1])
        at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
        hit = np.flatnonzero(hashes[at] == own) if len(hashes) else np.empty(0, np.int64)
        pairs, counts = np.unique(words.row[hit] * max(len(hashes), 1) + at[hit], return_counts=True)
        row, term = np.divmod(pairs, max(len(hashes), 1))
        kept = np.flatnonzero(words.counts)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - first)[kept])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, counts)]
        yield pa.RecordBatch.from_arrays([ids.slice(first, end - first).take(pa.array(kept)), pa.array(words.counts[kept].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])


class Scores:
    """The impacts of the corpus: of each asked term its weight, and the factor of a document's length."""

    def __init__(self, n_docs: int, n_terms: int, frequencies: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in frequencies], np.int64)

    def impacts(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, row: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * self.n_docs // self.n_terms
        return self.weights[terms] * (UNIT * counts // (1000 * counts + SATURATION_PER_MILLE * m[row]))


class Best:
    """The ten best documents of each item so far, and the score that a further one must reach."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * items
        self.least = np.ones(items, np.int64)

    def add(self, item: int, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        scores, none, ids = (np.concatenate(x) for x in zip(self.found[item], (scores, none, ids)))
        order = np.lexsort((ids, none, -scores))[: self.top]
        self.found[item] = scores[order], none[order], ids[order]
        if len(order) == self.top:
            self.least[item] = scores[order[-1]]


class Bucket:
    """Vectors of similar norm, by term: the rows that have it and their impacts."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, row: np.ndarray, terms: np.ndarray, impacts: np.ndarray, squares: np.ndarray):
        self.ids, self.none, self.squares = ids, none, squares
        order = np.argsort(terms, kind="stable")
        self.terms, at = np.unique(terms[order], return_index=True)
        self.at = np.append(at, len(order))
        self.row, self.impacts = row[order], impacts[order]
        self.greatest = np.maximum.reduceat(self.impacts, at) if len(at) else np.empty(0, np.int64)

    def search(self, item: int, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Adds the item's documents of this bucket that may be among its best."""
        if not len(self.terms):
            return
        place = np.searchsorted(self.terms, terms)
        there = np.flatnonzero((place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == terms))
        place, times = place[there], times[there]
        bounds = times * self.greatest[place]
        order = np.argsort(-bounds)
        place, times, bounds = place[order], times[order], bounds[order]
        rest = np.cumsum(bounds[::-1])[::-1]  # what a document can gain from each term on
        least = int(best.least[item])
        if not len(rest) or rest[0] < least:
            return
        focus = int(np.searchsorted(-rest, -least, side="right"))  # terms from here on cannot reach it alone
        rows, gains = self._products(place[:focus], times[:focus])
        partial = np.bincount(rows, gains, len(self.ids))
        if focus < len(rest):
            used = np.bincount(rows, np.square(gains / np.repeat(times[:focus], np.diff(self.at)[place[:focus]])), len(self.ids))
            left = np.sqrt(np.maximum(self.squares - used, 0.0)) * math.sqrt(float(np.sum(np.square(times[focus:].astype(float)))))
            partial += np.where(partial > 0, np.minimum(float(rest[focus]), left * (1 + 1e-6) + 1.0), 0.0)
        alive = np.flatnonzero(partial >= least)
        if not len(alive):
            return
        if focus < len(rest):
            rows, gains = self._products(place, times)
        number = np.full(len(self.ids), -1, np.int64)
        number[alive] = np.arange(len(alive))
        mine = number[rows]
        scores = np.zeros(len(alive), np.int64)
        np.add.at(scores, mine[mine >= 0], gains[mine >= 0])
        kept = np.flatnonzero(scores >= least)
        best.add(item, scores[kept], self.none[alive[kept]], self.ids[alive[kept]])

    def _products(self, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.at[place + 1] - self.at[place]
        entries = np.repeat(self.at[place] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.row[entries], self.impacts[entries] * np.repeat(times, size)


def buckets(batch: pa.RecordBatch, scores: Scores, size: int) -> Iterator[tuple[float, Bucket]]:
    """The vectors of a batch by falling norm, cut into buckets, each with its greatest norm."""
    terms = batch.column("terms")
    n = batch.column("n").to_numpy().astype(np.int64)
    lengths = np.diff(terms.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), lengths)
    flat, counts = terms.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy().astype(np.int64)
    impacts = scores.impacts(n, flat, counts, row)
    squares = np.bincount(row, np.square(impacts.astype(float)), len(n))
    none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id").fill_null(0).to_numpy()
    order = np.argsort(-squares, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    by_rank = np.argsort(rank[row], kind="stable")
    ranked = rank[row][by_rank]
    for first in range(0, len(n), size):
        own = order[first : first + size]
        lo, hi = np.searchsorted(ranked, [first, first + len(own)])
        entries = by_rank[lo:hi]
        yield math.sqrt(float(squares[own[0]])), Bucket(ids[own], none[own], ranked[lo:hi] - first, flat[entries], impacts[entries], squares[own])


def searched(vectors: DataFrame, asked, scores, top: int, bucket: int) -> DataFrame:
    """item (number), doc_id, score: of each task the ten best of each item."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weighed = asked.value, scores.value
        best = Best(len(own.terms), top)
        norms = np.array([math.sqrt(float(np.sum(np.square(t.astype(float))))) for t in own.times]) * (1 + 1e-6)
        for batch in batches:
            for greatest, vectors in buckets(batch, weighed, bucket):
                for item in np.flatnonzero(norms * greatest + 1.0 >= best.least).tolist():
                    vectors.search(item, own.terms[item], own.times[item], best)
        for item, (score, none, ids) in enumerate(best.found):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item), pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(step, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, bucket: int = BUCKET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each row of items (item_id, text) its highest-scoring documents."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    kind = items.schema["item_id"].dataType
    asked_rows = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    blocks, out = blocks_of(items, block_bytes), None
    for block in range(blocks):
        rows = asked_rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect() if blocks > 1 else asked_rows.collect()
        rows.sort(key=lambda r: (r[0] is None, str(r[0]), r[1]))
        asked = Asked([r[1] for r in rows])
        hashes = context.broadcast(asked.hashes)

        def step(batches: Iterator[pa.RecordBatch], hashes=hashes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from found_terms(batch, hashes.value)

        vectors = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, "doc_id long, n long, terms array<int>, counts array<int>")
        vectors = written(vectors, "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        frequencies = np.zeros(len(asked.hashes), np.int64)
        for term, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term that is asked for
            frequencies[term] = df
        found = searched(vectors, context.broadcast(asked), context.broadcast(Scores(n_docs, n_terms or 1, frequencies)), top, bucket)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
        part = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op11_lemp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY ALL),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
impacts AS (SELECT doc_id, r, t, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.w) * nn) // l))) AS x FROM tf JOIN d USING (r) JOIN weights USING (t), s),
scores AS (SELECT item_id, r, doc_id, CAST(sum(c * x) AS BIGINT) AS score FROM q JOIN impacts USING (t) GROUP BY ALL HAVING sum(c * x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
