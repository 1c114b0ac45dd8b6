"""The pipeline stage by stage against what each stage must do."""

import itertools
import re

import corpus_pipeline
import pandas as pd
from test_operators import HARD, brute_ids, brute_random, check_packed, crc, docs, empty, hard, jaccard  # noqa: F401

from plotwright.llm import common, packing, queries


def test_stages_keep_the_columns(spark, data):
    source = spark.read.parquet(f"{data}/documents.parquet")
    at, counts = source, []
    for name, stage in corpus_pipeline.STAGES:
        at = common.written(stage(spark, at, data), name)
        counts.append(at.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == source.columns and at.schema.simpleString() == source.schema.simpleString()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good = sum(v == 1 for v in labels.values()) / len(labels)
    assert counts[0] >= 0.85 * good * source.count() and counts[0] >= counts[1] >= counts[2] == counts[3]
    whole = packing.pieces(common.written(corpus_pipeline.good_quality(spark, source, data), "again")).groupBy().sum("length").first()[0]
    assert 0 < at.groupBy().sum("length").first()[0] <= whole


def test_stages_on_hard_rows(spark, data):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (hard(spark), empty(spark)):
            out = stage(spark, rows, data)
            assert name == "best_fit_packing" or out.columns == rows.columns
            assert out.count() <= rows.count() + 100


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_contaminated(texts, items):
    windows = {}
    for item in items:
        words = benchmark_words(item)
        for i in range(max(1, len(words) - 9) if words else 0):
            own = tuple(words[i : i + 10])
            windows.setdefault(len(own), set()).add(own)
    out = []
    for text in texts:
        words = benchmark_words(text)
        out.append(any(tuple(words[i : i + n]) in known for n, known in windows.items() for i in range(len(words) - n + 1)))
    return out


def brute_redacted(text, spans):
    out, at, end = [], 0, 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= end:
            out += [text[at:s] if s > at else "", "[SECRET]"]
        at = end = max(end, e)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, data):
    """Every stage on all that its predecessor kept, by a plain version of it."""
    at, frames = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = common.written(stage(spark, at, data), name)
        frames.append(at.toPandas())
    good, single, clean, hidden, packed = frames
    source = pd.read_parquet(f"{data}/documents.parquet")
    scores = queries.QUERIES["op1_quality_crf"](spark, data).toPandas()
    assert sorted(good.doc_id) == sorted(scores.doc_id[scores.score >= 0.3])
    text = dict(zip(source.doc_id, source.text))
    kept = set(single.doc_id)
    assert kept <= set(good.doc_id) and all(text[r.doc_id] == r.text for r in single.itertuples())
    ids = sorted(good.doc_id)
    near = {}
    for a, b in itertools.combinations(ids, 2):
        s = jaccard(text[a] or "", text[b] or "")
        near[a, b] = s
        assert s < 0.85 or not (a in kept and b in kept)
    for d in set(ids) - kept:  # what goes has a near copy with a lower id, if by steps
        assert any(s >= 0.5 and d in pair for pair, s in near.items())
    benchmark = pd.read_parquet(f"{data}/benchmark.parquet").text.tolist()
    hit = brute_contaminated(single.text, benchmark)
    assert sorted(clean.doc_id) == sorted(d for d, h in zip(single.doc_id, hit) if not h)
    spans = brute_random(clean.text.tolist())
    want = {d: brute_redacted(t, own) for d, t, own in zip(clean.doc_id, clean.text, spans)}
    assert dict(zip(hidden.doc_id, hidden.text)) == want
    pieces = [(d, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for d, t in want.items() for ids in [brute_ids(t, 1)] for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(tuple, packed[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(pieces)
    check_packed(packed, 4096)
