"""Token ids as Parquet list columns, laid out for selective reads.

Texts are dealt by ranges of doc_id and sorted, so the files in name order hold ascending ids. The ids are an
int32 list column, dictionary encoded where that pays and else (page format 2) delta encoded; row groups and
pages have set sizes, and the page indexes that Parquet writes let a reader of a few documents, or of the
metadata columns alone, skip all else. A document's place in the stream of all ids is the total of the files
before its own plus its place in its file; only one number per file is summed up in one place.

Defined results: null and empty texts hold the end id alone; rows that share a doc_id are ordered
(and dealt, if they are many) by a hash of their text; null doc_ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .tokens import WORD_BPE, encode_chunks

SCHEMA = "doc_id long, part int, place long, n_tokens int, tokens array<int>"
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(256 << 10),
}


def token_rows(docs: DataFrame, end_id: int = 2, vocabulary: str = WORD_BPE) -> DataFrame:
    """Per document, in doc_id order: its part, its place among the part's ids, its ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, found, counts in encode_chunks(batch.column("text"), vocabulary):
                offsets = np.concatenate([[0], np.cumsum(counts + 1)])
                ids = np.empty(len(found) + b - a, np.int32)
                own = np.ones(len(ids), bool)
                own[offsets[1:] - 1] = False
                ids[own], ids[~own] = found, end_id
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(place + offsets[:-1]), pa.array((counts + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "place", "n_tokens", "tokens"],
                )
                place += len(ids)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(step, SCHEMA)


def write_tokens(docs: DataFrame, end_id: int = 2, vocabulary: str = WORD_BPE) -> DataFrame:
    """The token table of docs, as written and read back."""
    return written(token_rows(docs, end_id, vocabulary), "tokens", **LAYOUT)


def starts(table: DataFrame) -> DataFrame:
    """table with start, the number of ids of all documents before; reads the metadata columns alone for it."""
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return table.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("place")).drop("before")


def checksums(table: DataFrame) -> DataFrame:
    """table with ids_crc32 in place of tokens: of the ids as little-endian unsigned 32-bit integers."""
    own = [c for c in table.columns if c != "tokens"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            at, ids = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), "<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(sums, pa.int64())], names=[*own, "ids_crc32"])

    return table.mapInArrow(step, table.select(own).withColumn("ids_crc32", F.lit(0).cast("long")).schema)


def op3_token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checksums(starts(write_tokens(documents(spark, sf_dir))))
    return found.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
