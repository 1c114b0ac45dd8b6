"""Ranked search, spelling variants and window packing against plain versions of their definitions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from plotwright.llm import lexical, packing, queries, spelling, tokens, window_packing

DOCS = "doc_id long, text string, lang string, n long, word string, score string, rank string"
LONG = " ".join(f"wordly{i % 997}" for i in range(60_000))
HARD = ["", None, " \n\t ", "one", "a b c", "The same text here again.", "The same text here again.", LONG, "É ü 你好 \U0001f600 x\u0085y\xa0z", "colours\x1ccolours \x0b end", "Z" * 300_000]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, 7, "own", "own", "own") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def hard(spark):
    """Null and empty texts, very long ones, copies, a repeated row, a null id, extra columns of clashing names."""
    return docs(spark, [*HARD, "The same text here again.", "null id"], [*range(len(HARD)), 5, None])


def empty(spark):
    return docs(spark, ["x"]).limit(0)


def text_of(data):
    return dict(pd.read_parquet(f"{data}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False))


UPPER = {c: c + 32 for c in range(65, 91)}


# --- ranked search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_search(rows, items, top=10):
    """rows: (doc_id, text); items: (item_id, text). Every document is scored for every item."""
    kept = [(i, collections.Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in rows) if t]
    n, total, df = len(kept), sum(k[2] for k in kept), collections.Counter(t for _, c, _ in kept for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, counts, size in kept:
            m, score = 100 - 75 + (75 * size * n) // total, 0
            for t in terms_of(text):
                if t in counts:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def found(frame):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=key)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, rank int")


@pytest.mark.parametrize("bucket", [3, 1024])
def test_search_against_every_score(spark, bucket):
    rng = random.Random(bucket)
    made = [" ".join(rng.choices([f"t{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 80))) for _ in range(400)]
    texts = [*made, *made[:100], *["t3 t4 copy"] * 40]
    items = [(i, " ".join(rng.choices([f"t{k}" for k in range(70)], k=rng.randrange(0, 12)))) for i in range(30)] + [(99, None), (100, "t5 t5 T5"), (101, "copy")]
    for top in (1, 10, 1000):
        got = found(lexical.search(docs(spark, texts).repartition(3), items_of(spark, items), top, bucket))
        assert got == sorted(brute_search(list(enumerate(texts)), items, top))


def test_search_on_hard_rows(spark):
    rows = [*enumerate(HARD), (5, "The same text here again."), (None, "null id")]
    items = [(1, "the SAME id, null"), (2, ""), (3, "nowhere"), (None, "wordly5 é 你好 z")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = sorted(brute_search(rows, items), key=key)
    assert found(lexical.search(hard(spark), items_of(spark, items))) == expected
    assert found(lexical.search(hard(spark), items_of(spark, [*items, *items]))) == expected
    assert found(lexical.search(hard(spark), items_of(spark, items), block_bytes=8)) == expected
    assert found(lexical.search(empty(spark), items_of(spark, items))) == []
    assert found(lexical.search(hard(spark), items_of(spark, []))) == []


def test_buckets_are_discarded(spark, data, monkeypatch):
    """Bounds leave few of the items' buckets, and fewer documents still."""
    texts, items = list(text_of(data).items()), pd.read_parquet(f"{data}/benchmark.parquet")
    asked = lexical.Asked(items.text.tolist())
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts])], names=["doc_id", "text"])
    vectors = pa.Table.from_batches(lexical.found_terms(batch, asked.hashes)).combine_chunks().to_batches()[0]
    frequencies = np.bincount(vectors.column("terms").flatten().to_numpy(), minlength=len(asked.hashes))
    scores = lexical.Scores(len(vectors), int(np.sum(vectors.column("n").to_numpy())), frequencies)
    best, scored = lexical.Best(len(asked.terms), 10), []
    add = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, item, s, *rest: (scored.append(len(s)), add(self, item, s, *rest)))
    for _ in range(2):  # the second time with the scores that the first has found
        scored.clear()
        for _, bucket in lexical.buckets(vectors, scores, 16):
            for item in range(len(asked.terms)):
                bucket.search(item, asked.terms[item], asked.times[item], best)
    assert sum(scored) < 0.2 * len(texts) * len(asked.terms)


# --- spelling variants


def brute_words(rows, least=7, count=2):
    found = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    return any(a[:k] + a[k + 1 :] == (b if len(a) > len(b) else b[:k] + b[k + 1 :]) for k in range(len(a)))


def brute_variants(rows, least=7, count=2, ratio=10):
    words = brute_words(rows, least, count)
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def variants(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("most", [2, 30, 2048])
def test_variants_against_all_pairs(spark, most):
    """Words over two letters, so that groups are dealt again down to single places; words that repeat a letter."""
    rng = random.Random(most)
    words = ["".join(rng.choices("abé", k=rng.randrange(5, 11))) for _ in range(250)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "×÷" * 4]
    texts = [" ".join(rng.choices(words, [3.0 ** -(k % 7) for k in range(len(words))], k=400)).upper() for _ in range(8)]
    assert variants(spelling.variants(docs(spark, texts), 5, 1, 2, most)) == brute_variants(list(enumerate(texts)), 5, 1, 2)


def test_forms_lead_to_roots(spark):
    """A chain of five words, each over ten times as frequent as the one before, and a tie between two forms."""
    chain = ["harbours", "harbour", "harboar", "harboam", "harbpam"]
    counts = [200_000, 19_000, 1_700, 150, 14]
    text = " ".join(" ".join([w] * n) for w, n in zip(chain, counts)) + " tiedword tiedword" + " tiedworda" * 40 + " tiedwordb" * 40
    got = {r[0]: r for r in variants(spelling.variants(docs(spark, [text], [3])))}
    assert [got[w][1] for w in chain] == [None, *chain[:-1]] and {got[w][2] for w in chain} == {"harbours"}
    assert got["tiedword"][1] == "tiedworda" and got["tiedword"][4] == 2
    assert list(got.values()) == brute_variants([(3, text)])


def test_variants_on_hard_rows(spark):
    rows = [*enumerate(HARD), (5, "The same text here again."), (None, "null id")]
    more = ["Àlpenglow àlpenglow alpenglow", "alpenglowĀalpenglow", "alpenglow"] * 20
    texts, ids = [t for _, t in rows] + more, [i for i, _ in rows] + [100 + k for k in range(len(more))]
    assert variants(spelling.variants(docs(spark, texts, ids))) == brute_variants(list(zip(ids, texts)))
    assert variants(spelling.variants(hard(spark))) == brute_variants(rows)
    assert variants(spelling.variants(empty(spark))) == []


def test_variants_query_equals_brute_force(spark, data):
    assert variants(queries.QUERIES["op12_spelling_variants"](spark, data)) == brute_variants(list(text_of(data).items()))


# --- window packing


def ids_of(text):
    from tokenizers import Tokenizer

    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    return np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


_tokenizer = None


def check_windows(rows, texts, capacity=2048):
    """Pieces cover each document once with its own ids, windows are gapless; gives the padding and the windows."""
    of, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(of) == {d for d, _ in texts}
    for doc_id, text in texts:
        ids, at = ids_of(text), 0
        for r in sorted(of[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, windows


def test_windows_query(spark, data):
    texts = list(text_of(data).items())
    rows = queries.QUERIES["op13_best_fit_decreasing"](spark, data).collect()
    padding, windows = check_windows(rows, texts)
    assert padding < 0.002 * sum(r.length for r in rows)
    short = collections.Counter(r.doc_id for r in rows if r.doc_tokens <= 2048)
    assert sum(n > 1 for n in short.values()) < 0.05 * len(short)


def test_windows_on_hard_rows(spark):
    texts = list(enumerate(HARD))
    check_windows(window_packing.pack(window_packing.pieces(docs(spark, HARD))).collect(), texts)
    for crumb_of in (1, 2):  # all pieces, or every other one, may be cut
        rows = window_packing.pack(window_packing.pieces(docs(spark, HARD), crumb_of=crumb_of), least_gap=1).collect()
        padding, _ = check_windows(rows, texts)
        assert crumb_of > 1 or padding == 0
    twice = window_packing.pack(window_packing.pieces(hard(spark))).collect()
    assert sum(r.length for r in twice) == sum(len(ids_of(t)) for t in [*HARD, HARD[5], "null id"])
    assert window_packing.pack(window_packing.pieces(empty(spark))).collect() == []


def test_tree_finds_the_tightest_window():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        tree, have = window_packing.CapacityTree(capacity), []
        for step in range(600):
            length = rng.randrange(1, capacity + 1)
            fitting = [s for s in have if s >= length]
            assert tree.tightest(length) == (min(fitting) if fitting else None)
            if fitting and rng.random() < 0.6:
                tree.take(min(fitting))
                have.remove(min(fitting))
            space = rng.randrange(1, capacity + 1)
            tree.put(space, step)
            have.append(space)


def test_windows_are_best_fit_decreasing():
    """Against a plain search over all open windows; fewer windows than the bounded packer of the other operator needs at most."""
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 101) for _ in range(2000)), reverse=True)
    packer, free = window_packing.Packer(100), []
    for length in lengths:
        fitting = [s for s in free if s >= length]
        window, offset = packer.put(length)
        expected = min(fitting, default=100)
        assert 100 - offset == expected
        if fitting:
            free.remove(expected)
        free.append(expected - length)
    online = packing.Packer(100)
    for length in rng.sample(lengths, len(lengths)):
        online.put(length)
    assert -(-sum(lengths) // 100) <= packer.opened <= online.opened
    with pytest.raises(ValueError):
        packer.put(101)
