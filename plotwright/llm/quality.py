"""Quality of documents by a linear-chain conditional random field over their lines.

Each line that is not blank is good or bad. What speaks for good is a weighted sum of features of the line and
of its neighbours; a transition table ties the labels of adjoining lines. Forward-backward gives every line's
marginal, their mean weighted by the lines' lengths is the document's share of good text, and a logistic curve
turns that into the probability of label 1.

The field is fitted to labelled documents, all lines of one bearing its label: to ``sample`` of them at most,
those with the least hash of their id, one row of each, and to no more than the first ``most_lines`` lines of each.
That is the only bound; every document is scored whole, where it is read, and no feature looks at labels, lang, source or doc_id.

Defined results: null and empty texts, and texts of blank lines, get the labels' base rate; without labels, or
with one label only, every document gets the base rate (0.5 of none); labels of null are left out; rows that
share a doc_id are scored one by one, and one of them is fitted to its label; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_view, chunks, documents, held_out, mix

SAMPLE, MOST_LINES = 3000, 150
THRESHOLD = 0.3
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*@^~=<>_+\\/", b".,;:?'\"-()[]{}`", bytes(range(128, 256)))
_FLAGS = [np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in _CLASSES]
_CLOSING = np.isin(np.arange(256), np.frombuffer(b".?!", np.uint8))
FEATURES = len(_CLASSES) + 9


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[ends] - total[starts]).astype(np.float64)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with words: the row, the length in bytes, and the features."""
    w = Words(data, offsets)
    raw, at = w.data, w.offsets
    edges = np.unique(np.concatenate([at, np.flatnonzero(raw == 0x0A), [len(raw)]]))
    line_of = np.searchsorted(edges, w.starts, side="right") - 1
    lines, first, words = np.unique(line_of, return_index=True, return_counts=True)
    if not len(lines):
        return np.empty(0, np.int64), np.empty(0), np.empty((0, FEATURES))
    last = first + words - 1
    starts, ends, row = w.starts[first], w.ends[last], w.row[first]
    size = (ends - starts).astype(np.float64)
    hashes = w.hashes()
    number = np.repeat(np.arange(len(lines)), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (number[1:] == number[:-1])
    # distinct words of a line: sort by line, then hash
    order = np.lexsort((hashes, number))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (number[order][1:] != number[order][:-1])
    distinct = np.bincount(number[order][fresh], minlength=len(lines))
    whole = np.zeros(len(lines), np.uint64)
    np.add.at(whole, number, hashes)
    _, same, copies = np.unique(mix(whole + mix(row.astype(np.uint64))), return_inverse=True, return_counts=True)
    shares = [_sums(f[raw], starts, ends) / size for f in _FLAGS]
    out = np.stack([
        *shares, np.log1p(size), np.log1p(words), np.minimum(size / words, 60) / 10, np.bincount(number, again, len(lines)) / words,
        distinct / words, copies[same] > 1, _CLOSING[raw[ends - 1]], _FLAGS[1][raw[starts]], np.minimum(_sums(_FLAGS[5][raw], starts, ends) / words, 5),
    ], axis=1).astype(np.float64)
    return row, size, out


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Features (standardised) of each line with those of the lines before and after it in its row, and a one."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = row[1:] == row[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    ends = np.zeros((len(x), 2))
    ends[0, 0] = ends[-1:, 1] = 1
    ends[1:, 0] = ~same
    ends[:-1, 1] = ~same
    return np.concatenate([x, before, after, ends, np.ones((len(x), 1))], axis=1)


@dataclass
class Field:
    """Standardisation, weights for good, log transitions (from, to), and the curve from shares to scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float
    base: float

    def evidence(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.clip(with_neighbours((x - self.mean) / self.spread, row) @ self.weights, -30, 30)

    def score(self, share: np.ndarray) -> np.ndarray:
        s = np.clip(share, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(s / (1 - s)) + self.shift)))


def marginals(evidence: list[float], moves: np.ndarray) -> list[float]:
    """The probability that each line of a chain is good: forward-backward with the pair kept normalised."""
    (m00, m01), (m10, m11) = np.exp(moves).tolist()
    likely = np.exp(evidence).tolist()
    a0 = a1 = 0.5
    ahead = []
    for k, e in enumerate(likely):
        if k:
            a0, a1 = a0 * m00 + a1 * m10, (a0 * m01 + a1 * m11) * e
        else:
            a1 *= e
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        ahead.append((a0, a1))
    b0 = b1 = 1.0
    out = [0.0] * len(likely)
    for k in range(len(likely) - 1, -1, -1):
        a0, a1 = ahead[k]
        out[k] = a1 * b1 / (a0 * b0 + a1 * b1)
        e = likely[k]
        b0, b1 = m00 * b0 + m01 * e * b1, m10 * b0 + m11 * e * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return out


def shares(evidence: np.ndarray, row: np.ndarray, size: np.ndarray, moves: np.ndarray, rows: int) -> np.ndarray:
    """Per row the share of good text: marginals weighted by length; NaN without lines."""
    out = np.full(rows, np.nan)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]) if len(row) else np.zeros(1, int)
    for s, e in zip(cuts[:-1], cuts[1:]):
        own = size[s:e]
        out[row[s]] = float(np.dot(marginals(evidence[s:e], moves), own) / own.sum())
    return out


def _gradient(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, good: np.ndarray, weights: np.ndarray, moves: np.ndarray):
    """The gradient of the mean log-likelihood a document (by its lines), all chains a step at a time; longest first."""
    score = np.clip(x @ weights, -30, 30)
    n, steps = len(lengths), int(lengths.max())
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # chains longer than t
    factor = np.exp(moves)
    ahead = np.zeros((steps, n, 2))
    local = np.ones((steps, n, 2))
    for t in range(steps):
        k = active[t]
        local[t, :k, 1] = np.exp(score[starts[:k] + t])
        a = local[t, :k] * (ahead[t - 1, :k] @ factor if t else 0.5)
        ahead[t, :k] = a / a.sum(1, keepdims=True)
    d_weights, d_moves = np.zeros_like(weights), np.zeros((2, 2))
    behind = np.ones((n, 2))
    share = 1 / lengths
    for t in range(steps - 1, -1, -1):
        k = active[t]
        p = ahead[t, :k] * behind[:k]
        p /= p.sum(1, keepdims=True)
        d_weights += ((good[:k] - p[:, 1]) * share[:k]) @ x[starts[:k] + t]
        if t:
            right = local[t, :k] * behind[:k]
            pair = ahead[t - 1, :k, :, None] * factor[None] * right[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            d_moves -= (pair * share[:k, None, None]).sum(0)
            d_moves[1, 1] += (share[:k] * good[:k]).sum()
            d_moves[0, 0] += (share[:k] * (1 - good[:k])).sum()
            b = right @ factor.T
            behind[:k] = b / b.sum(1, keepdims=True)
    return d_weights / n, d_moves / n


def fit(row: np.ndarray, size: np.ndarray, x: np.ndarray, good: np.ndarray, steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """The field of some labelled rows (good: label by row), lines in order."""
    base = float(np.clip(good.mean(), 0.01, 0.99)) if len(good) else 0.5
    width = 3 * FEATURES + 3
    if not len(row) or good.min() == good.max():
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(base / (1 - base))), base)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    near = with_neighbours((x - mean) / spread, row)
    own, starts, lengths = np.unique(row, return_index=True, return_counts=True)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, label = starts[order], lengths[order], good[own[order]].astype(np.float64)
    weights, moves = np.zeros(width), np.zeros((2, 2))
    first = [np.zeros(width), np.zeros((2, 2))]
    second = [np.zeros(width), np.zeros((2, 2))]
    for t in range(1, steps + 1):  # Adam
        gradients = _gradient(near, starts, lengths, label, weights, moves)
        moved = []
        for k, (value, g) in enumerate(zip((weights, moves), gradients)):
            g = g - decay * value
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            moved.append(value + rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8))
        weights, moves = moved
    field = Field(mean, spread, weights, moves, 1.0, 0.0, base)
    found = shares(np.clip(near @ weights, -30, 30), row, size, moves, len(good))
    there = ~np.isnan(found)
    s = np.clip(found[there], 1e-4, 1 - 1e-4)
    z = np.stack([np.log(s / (1 - s)), np.ones(there.sum())], axis=1)
    curve = np.array([1.0, 0.0])
    for _ in range(25):  # Newton, drawn a little to the identity
        p = 1 / (1 + np.exp(-(z @ curve)))
        g = z.T @ (good[there] - p) - 0.1 * (curve - [1.0, 0.0])
        curve = curve + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), g)
    field.slope, field.shift = max(0.05, float(curve[0])), float(curve[1])
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES) -> Field:
    """The field of the labelled documents of docs that are not held out; labels: doc_id, quality."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounds what is broadcast and what comes to the driver

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for a, b in chunks(offsets):
                row, size, x = line_features(data, offsets[a : b + 1])
                for r, good in enumerate(batch.column("good")[a:b].to_pylist()):
                    lines = np.flatnonzero(row == r)[:most_lines]
                    if len(lines):
                        yield pa.RecordBatch.from_arrays([pa.array([good], pa.int32()), pa.array([size[lines].tobytes()]), pa.array([x[lines].tobytes()])], names=["good", "size", "x"])

    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = met.groupBy("id").agg(F.max("good").cast("int").alias("good"), F.min_by("text", F.xxhash64("text")).alias("text")).select("good", "text")
    rows = found.mapInArrow(step, "good int, size binary, x binary").collect()
    rows = sorted(rows, key=lambda r: (bytes(r["x"]), r["good"]))  # the same field whatever the order of arrival
    sizes = [np.frombuffer(bytes(r["size"])) for r in rows]
    lines = np.repeat(np.arange(len(rows)), [len(s) for s in sizes])
    x = np.concatenate([np.frombuffer(bytes(r["x"])).reshape(-1, FEATURES) for r in rows]) if rows else np.empty((0, FEATURES))
    return fit(lines, np.concatenate(sizes) if rows else np.empty(0), x, np.array([r["good"] for r in rows], np.float64))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """docs with score, the probability of label 1; its other columns stay."""
    names = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            made = []
            for a, b in chunks(offsets):
                row, size, x = line_features(data, offsets[a : b + 1])
                share = shares(own.evidence(x, row), row, size, own.moves, b - a) if len(row) else np.full(b - a, np.nan)
                made.append(np.where(np.isnan(share), own.base, own.score(np.nan_to_num(share, nan=0.5))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.concatenate(made) if made else np.empty(0))], names=[*names, "score"])

    return docs.select(names).mapInArrow(step, docs.select(names).withColumn("score", F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that score at least THRESHOLD by the field of their labelled part."""
    named = docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs
    kept = scored(named, train(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score")
    return (kept.withColumnRenamed("__score", "score") if "score" in docs.columns else kept).select(docs.columns)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, field)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
