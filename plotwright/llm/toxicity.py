"""Toxicity by a weighted pattern grammar of finite-state transducers.

Words become symbols: insults and threats with weights, persons (pronouns), subjects (articles, demonstratives
and copulas, which open a noun phrase or a predicate), negations, verbs of reported speech, pauses, ends, all
else. Transducers are composed, each rewriting the symbols of the one before: reported speech marks what it
quotes up to the end of the sentence, negation marks what stands in its scope of three words, and targets mark
the insults and threats of a clause that has one. A clause is an address (the word opens the sentence), heaped
(another insult or threat up to twelve words before), of a subject up to ten words before, or of a person up to
four words away on either side; what comes later in this list wins. The last transducer reads those marks and no
other: its arcs bear learned weights, one for each kind of clause, and add up to the score. A word that no clause
ties to a target counts for nothing, whatever its weight; a logistic curve over the arcs' sums, fitted with the
lexicon, gives the probability of label 1.

Insults and their weights are learned from labelled rows: ``sample`` of them at most, those with the least hash
of their id. A word, or a stem of four to seven letters of longer words, is one if it meets toxic rows so often
that chance is ruled out among all that were counted.
Rows that share a doc_id give one of the sample. That sample is the only bound; every document is scored whole, where it is read, and no score looks at labels,
lang, source or doc_id.

Defined results: null and empty texts match nothing and get the score of such texts; without labels, or with
one label only, every document gets the base rate (0.5 of none); labels of null are left out; rows that share a
doc_id are scored one by one; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_view, chunks, documents, gram_hashes, held_out, span_hashes, written

SAMPLE = 8000
THRESHOLD = 0.3
#: Letters of a stem.
STEMS = (4, 5, 6, 7)
#: Nats by which a word's association must beat chance among all words counted.
MARGIN = 2.0

PERSONS = frozenset("you your yours he him she her they them their du dich dein sie ihr euch tu toi ton vous votre tú tu ti usted ustedes vosotros él ella".split())
SUBJECTS = frozenset("the this that these those a an is are was were be der die das den dem ein eine ist sind war le la les un une des est sont était el los las una es son era".split())
NEGATIONS = frozenset("not no never nobody isn aren wasn don doesn nicht kein keine nie ne pas jamais nunca jamás ni".split())
REPORTS = frozenset("said says say called calls wrote writes quoted claimed sagte sagt nannte schrieb dit disait appela écrivit dijo dice llamó escribió".split())
THREATS = {w: 2.0 for w in "kill hurt destroy murder beat töten umbringen verletzen tuer frapper détruire matar golpear destruir".split()}

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n,;:]")
#: Per code point whether it is outside words, by the rule of the tokens.
_SEPARATOR = np.ones(0x110000, bool)
for _m in re.finditer(r"[^\W\d_]+", "".join(map(chr, range(0x110000)))):
    _SEPARATOR[_m.start() : _m.end()] = False
_SYMBOL = {w: symbol for symbol, words in (("subject", SUBJECTS), ("person", PERSONS), ("not", NEGATIONS), ("report", REPORTS), ("end", ".!?\n"), ("pause", ",;:")) for w in words}
WHAT, TIES, MARKS = ("insult", "threat"), ("+address", "+heap", "+subject", "+person"), ("", "+not", "+told")
#: The clauses that score: an insult or a threat, its tie to a target, and whether it is negated or reported.
KINDS = tuple(what + tie + mark for what in WHAT for tie in TIES for mark in MARKS)


def _points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")


class Transducer:
    """Arcs from (state, symbol) to (state, symbol, factor); "*" stands for any other symbol, which passes as it is."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        found = self.arcs.get((state, symbol)) or self.arcs.get((state, "*"))
        if not found:
            return state, symbol, 1.0
        state, out, factor = found
        return state, symbol if out is None else out, factor


class Composition:
    """Transducers in a row: a symbol passes through all of them, its factors multiply."""

    def __init__(self, *parts: Transducer):
        self.parts = parts

    def run(self, symbols) -> Iterator[tuple[str, float]]:
        states = [p.start for p in self.parts]
        for symbol, weight in symbols:
            for k, part in enumerate(self.parts):
                states[k], symbol, factor = part.step(states[k], symbol)
                weight *= factor
            yield symbol, weight


def _reported() -> Transducer:
    arcs = {("plain", "report"): ("quoting", "report", 1.0), ("quoting", "end"): ("plain", "end", 1.0)}
    for what in WHAT:
        arcs["quoting", what] = ("quoting", f"{what}+told", 1.0)
    return Transducer("plain", arcs)


def _negated(scope: int = 3) -> Transducer:
    arcs: dict = {}
    for left in range(scope + 1):
        arcs[left, "not"] = (scope, "not", 1.0)
        arcs[left, "end"], arcs[left, "pause"] = (0, "end", 1.0), (0, "pause", 1.0)
        if left:
            arcs[left, "*"] = (left - 1, None, 1.0)
            for what in WHAT:
                arcs[left, what] = (left - 1, f"{what}+not", 1.0)
    return Transducer(0, arcs)


def _address() -> Transducer:
    arcs: dict = {("inside", "end"): ("start", "end", 1.0), ("start", "end"): ("start", "end", 1.0), ("start", "pause"): ("start", "pause", 1.0), ("start", "*"): ("inside", None, 1.0)}
    for what in WHAT:
        for mark in MARKS:
            arcs["start", what + mark] = ("inside", f"{what}+address{mark}", 1.0)
    return Transducer("start", arcs)


def _tied(tie: str, openers: tuple[str, ...], reach: int, over: tuple[str, ...], pauses: bool = False) -> Transducer:
    """Marks insults and threats that bear no tie or one of over, up to reach words after an opener in its sentence (or between its pauses)."""
    arcs: dict = {}
    for left in range(reach + 1):
        arcs[left, "end"] = (0, "end", 1.0)
        if pauses:
            arcs[left, "pause"] = (0, "pause", 1.0)
        if left:
            arcs[left, "*"] = (left - 1, None, 1.0)
        for what in WHAT:
            for mark in MARKS:
                for old in ("", *TIES):
                    symbol = what + old + mark
                    after = f"{what}{tie}{mark}" if left and old in over else symbol
                    if symbol in openers or left:
                        arcs[left, symbol] = (reach if symbol in openers else left - 1, after, 1.0)
        for symbol in openers:
            arcs.setdefault((left, symbol), (reach, symbol, 1.0))
    return Transducer(0, arcs)


_WORDS_TIED = tuple(what + tie + mark for what in WHAT for tie in ("", "+address") for mark in MARKS)
_PERSON = _tied("+person", ("person",), 4, ("", *TIES[:3]), True)
FORWARD = Composition(_reported(), _negated(), _address(), _tied("+heap", _WORDS_TIED, 12, ("", "+address")), _tied("+subject", ("subject",), 10, ("", *TIES[:2])), _PERSON)
BACKWARD = Composition(_PERSON)  # over the reversed symbols: persons that follow


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS) + 1))

    def symbols(self, text: str) -> list[tuple[str, float]]:
        out = []
        for w in _TOKEN.findall(text):
            if weight := self._insult(w):
                out.append(("insult", weight))
            elif w in THREATS:
                out.append(("threat", THREATS[w]))
            else:
                out.append((_SYMBOL.get(w, "word"), 1.0))
        return out

    def _insult(self, word: str) -> float:
        """The weight of a word, or else of the longest of its stems; 0 of neither."""
        own = self.insults.get(word)
        if own is None:
            own = next((self.insults[stem] for stem in reversed(stems(word)) if stem in self.insults), 0.0)
        return own

    def matches(self, text: str) -> Counter:
        """Weights of the clauses matched in a lower-case text, by kind; what no clause ties to a target is left out."""
        forward = list(FORWARD.run(self.symbols(text)))
        found: Counter = Counter()
        for symbol, weight in BACKWARD.run(reversed(forward)):
            if symbol in KINDS:
                found[symbol] += weight
        return found

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per row the logarithms of the kinds' weights, and a one. Only rows with a word of the grammar's are parsed."""
        lower = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
        data, offsets = byte_view(lower)
        out = np.zeros((len(texts), len(KINDS) + 1))
        out[:, -1] = 1
        known = self._known()
        for a, b in chunks(offsets):
            raw = data[offsets[a] : offsets[b]]
            before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
            w = Words(_points(raw), before[offsets[a : b + 1] - offsets[a]], _SEPARATOR)
            hit = np.zeros(len(w.starts), bool)
            for size, own in known.items():
                there = np.flatnonzero(w.ends - w.starts > size) if size else np.arange(len(w.starts))
                hashes = span_hashes(w.data, w.starts[there], w.starts[there] + size if size else w.ends)
                hit[there] |= own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes
            for r in np.unique(w.row[hit]).tolist():
                found = self.matches(lower[a + r].as_py())
                out[a + r, :-1] = [np.log1p(found[k]) for k in KINDS]
        return out

    def _known(self) -> dict[int, np.ndarray]:
        """Hashes of the grammar's whole words (0) and of its stems, by their letters."""
        by: dict[int, list[str]] = {0: list(THREATS)}
        for w in self.insults:
            by.setdefault(len(w) - 1 if w.endswith("*") else 0, []).append(w.rstrip("*"))
        out = {}
        for size, own in by.items():
            raw = _points(np.frombuffer(" ".join(own).encode(), np.uint8))
            out[size] = np.unique(Words(raw, np.array([0, len(raw)]), _SEPARATOR).hashes())
        return out


def stems(word: str) -> list[str]:
    """The stems of a word, shortest first."""
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    free = np.full(x.shape[1], ridge)
    free[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(free), x.T @ (y - p) - free * w)
    return w


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Words and weights of counts (word, toxic rows, clean rows) that associate with toxic rows beyond chance."""
    rate, out = toxic / (toxic + clean), {}
    need = np.log(max(1, len(counts))) + MARGIN
    for word, t, c in counts:
        share = t / (t + c)
        if share > rate:
            gain = t * np.log(share / rate) + (c * np.log((1 - share) / (1 - rate)) if c else 0.0)
            if gain > need:
                out[word] = float(max(0.1, np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))))
    return out


def one_a_family(rows: DataFrame) -> DataFrame:
    """Of rows (toxic, text) of the same label whose least 3-word hash agrees, copies with few changes, one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            least = np.zeros(batch.num_rows, np.uint64)
            for r in range(batch.num_rows):
                w = Words(data, offsets[r : r + 2]).hashes()
                least[r] = gram_hashes(w, min(3, len(w))).min() if len(w) else 0
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), pa.array(least.view(np.int64))], names=["toxic", "text", "family"])

    found = rows.mapInArrow(step, "toxic int, text string, family long")
    return written(found.groupBy("toxic", "family").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"), "labelled")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammar of the labelled documents of docs that are not held out; labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id", 4, 2)).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounds what is broadcast and what comes to the driver
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = one_a_family(met.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"))
    sums = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sums.get(1, 0), sums.get(0, 0)
    if not toxic or not clean:
        grammar = Grammar()
        base = np.clip(toxic / (toxic + clean), 0.01, 0.99) if toxic + clean else 0.5
        grammar.weights[-1] = np.log(base / (1 - base))
        return grammar

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
                counts[label].update(own | {stem for w in own for stem in stems(w)})
            found = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *[pa.array([counts[k][w] for w in found], pa.int64()) for k in (1, 0)]], names=["word", "toxic", "clean"])

    counted = rows.mapInArrow(words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 3")
    grammar = Grammar(lexicon([tuple(r) for r in counted.orderBy("word").collect()], toxic, clean))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(shared.value.features(batch.column("text"))), pa.list_(pa.float64()))], names=["toxic", "x"])

    found = rows.mapInArrow(features, "toxic int, x array<double>").collect()
    grammar.weights = _logistic(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float))
    return grammar


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with score, the probability of label 1; its other columns stay."""
    names = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = 1 / (1 + np.exp(-np.clip(shared.value.features(batch.column("text")) @ shared.value.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(made)], names=[*names, "score"])

    return docs.select(names).mapInArrow(step, docs.select(names).withColumn("score", F.lit(0.0)).schema)


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
