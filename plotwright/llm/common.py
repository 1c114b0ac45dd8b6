"""What the corpus operators share: folders, written tables, and byte-level views of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.tables import shared_dir, written  # noqa: F401

#: Bytes of text that the vectorised helpers take at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether the CRC-32 of the id's decimal digits leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about most bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, rows)
        yield first, last
        first = last


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The low bytes of a 64-bit number, by their count.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time; a longer word is hashed by the library.
_LONG_WORD = 64
_PRIME, _BASE = (1 << 31) - 1, 1_566_083_941
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end]: the spans' bytes, eight at a time, each mixed into what came before."""
    import xxhash

    wide = values.dtype.itemsize
    raw = np.concatenate([np.ascontiguousarray(values).view(np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    at, size = starts * wide, (ends - starts) * wide
    odd = np.uint64(_ODD[which])
    out = mix((eight[at] & _LOW[np.minimum(size, 8)]) * odd + size.astype(np.uint64))
    rest = np.flatnonzero(size > 8)
    if len(rest):
        longest = size[rest] > _LONG_WORD
        for k in rest[longest].tolist():
            out[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k] + size[k]], which)
        rest, done = rest[~longest], 8
        while len(rest):
            left = size[rest] - done
            out[rest] = mix((out[rest] ^ eight[at[rest] + done] & _LOW[np.minimum(left, 8)]) * odd)
            done += 8
            rest = rest[left > 8]
    return out


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of that many consecutive word hashes: runs of twice the length from two runs mixed."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out, have = words, 1
    while have < size:
        step = min(have, size - have)
        out = mix(out[:-step] * np.uint64(_ODD[0]) + (out[step:] ^ np.uint64(size)))
        have += step
    return out


def gram_sums(words: np.ndarray, size: int) -> np.ndarray:
    """A second family for the same runs: polynomials modulo the prime 2**31 - 1."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint32)
    if not _powers or len(_powers[0]) < n + 1:
        _powers[:] = [_power_table(x, 1 << int(n + 1).bit_length()) for x in (_BASE, pow(_BASE, -1, _PRIME))]
    power, inverse = _powers
    prime = np.uint64(_PRIME)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words % prime * power[:n] % prime, out=sums[1:])
    return ((sums[size:] - sums[:-size]) % prime * inverse[: n - size + 1] % prime).astype(np.uint32)


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:  # doubled: the second half is the first times a power
        out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, _PRIME)) % np.uint64(_PRIME)
        have *= 2
    return out


class Words:
    """The words of some rows of a byte view: separators are given as a table of 256 flags."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        self.data = data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets = offsets - offsets[0]
        rows, n = len(offsets) - 1, len(data)
        inside = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            np.logical_or(~inside[:-1], edge[1:-1], out=before[1:])
            np.logical_or(~inside[1:], edge[1:-1], out=after[:-1])
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.row, minlength=rows) if rows else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)

    def whole(self, size: int) -> np.ndarray:
        """Whether the run of that many words from each word on lies in one row."""
        n = len(self.row) - size + 1
        return self.row[:n] == self.row[size - 1 :] if n > 0 else np.zeros(0, bool)
