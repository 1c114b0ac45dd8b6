"""Each operator on small hard tables, and its query against brute force or SQL on the given tables."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotwright.llm import chat, common, decontaminate, media, packing, quality, queries, secrets, simhash, substring_dedup, token_columns, tokens, toxicity, wide_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def docs(spark, texts, ids=None):
    rows = [(i, t, None, "src0", None if t is None else len(t), "own", "own") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


HARD = ["", None, " \n\t ", "one", "a b c", "The same text here again.", "The same text here again.", LONG, "É ü 你好 \U0001f600 x\u0085y\xa0z", "key\x1cparts \x0b end"]


def hard(spark):
    """Null and empty texts, a very long one, copies, a repeated row, a null id, extra columns of clashing names."""
    return docs(spark, [*HARD, "The same text here again.", "null id"], [*range(len(HARD)), 5, None])


def empty(spark):
    return docs(spark, ["x"]).limit(0)


def text_of(data):
    return dict(pd.read_parquet(f"{data}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False))


# --- substring dedup


def brute_repeats(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [[False] * len(w) for w in split]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = [True] * window
    return [(len(w), sum(g), " ".join(x for x, k in zip(w, g) if not k)) for w, g in zip(split, gone)]


@pytest.mark.parametrize("window", [5, 35])
def test_repeats_on_hard_rows(spark, window):
    rng = random.Random(window)
    passage = " ".join(f"p{i}" for i in range(60))
    made = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90))) for _ in range(60)] + [f"{i} {passage} tail {i}" for i in range(20)] + ["a " * 200]
    texts = [*HARD, *made]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs(spark, texts), window).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, window)
    twice = substring_dedup.remove_repeats(hard(spark), window).collect()
    assert len(twice) == len(HARD) + 2
    assert substring_dedup.remove_repeats(empty(spark), window).collect() == []


def test_repeats_with_a_full_sketch(spark, monkeypatch):
    """A sketch too narrow lets more windows pass, and changes nothing."""
    monkeypatch.setattr(substring_dedup, "sketch_bits", lambda *a, **k: 16)
    monkeypatch.setattr(substring_dedup, "HELD", 500)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40, 300))) for _ in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs(spark, texts), 6).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 6)


def test_repeats_of_null_ids_whose_texts_share_32_bits(spark):
    """The two texts of each pair have equal 32-bit hashes (Murmur3); only the longer one repeats a passage, beyond the end of the other."""
    passage = " q " * 15 + " ".join(f"p{i}" for i in range(20))
    pairs = [(320201, 360929), (180194, 282417)]
    texts = [t for i, k in pairs for t in (f"x{i}{passage}", f"y{k} b c d e f")]
    frame = docs(spark, texts, [None] * len(texts))
    assert frame.select(F.hash("text")).distinct().count() == len(pairs)
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(frame, 5).collect())
    assert got == sorted(brute_repeats(texts, 5))


def test_repeats_of_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64 for every odd base."""
    for n in (512, 1024, 2048):
        word = "".join("ab"[k.bit_count() % 2] for k in range(n))
        other = word.translate({97: 98, 98: 97})
        head = " ".join(f"w{i}" for i in range(34))
        got = substring_dedup.remove_repeats(docs(spark, [f"{head} {word}", f"{head} {other}", f"{word} {head}", f"{other} {head}"])).collect()
        assert [r.n_removed for r in got] == [0] * 4
    line = np.array([k.bit_count() % 2 for k in range(2048)], np.uint64)
    hashes = common.mix(line + np.uint64(7)), common.mix(np.uint64(8) - line)
    for size in (1024, 2048):
        assert common.gram_hashes(hashes[0], size)[0] != common.gram_hashes(hashes[1], size)[0]
        assert common.gram_sums(hashes[0], size)[0] != common.gram_sums(hashes[1], size)[0]


def test_window_hashes_tell_windows_apart():
    rng = random.Random(6)
    for size in (1, 2, 3, 5, 9):
        words = [rng.choice(["a", "b", "abcdefgh", "abcdefghi", "abcdefgh\0", "x" * 65, "x" * 66]) for _ in range(400)]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        w = common.Words(raw, np.array([0, len(raw)]))
        told = {}
        for of in (common.gram_hashes(w.hashes(), size), common.gram_sums(w.hashes(1), size)):
            assert len(of) == len(words) - size + 1
            for i, h in enumerate(of.tolist()):
                assert told.setdefault((str(of.dtype), h), words[i : i + size]) == words[i : i + size]
            assert len(set(of.tolist())) == len({tuple(words[i : i + size]) for i in range(len(of))})


def test_many_equal_rows_take_linear_work(spark):
    text = " ".join(f"w{i}" for i in range(300))
    got = substring_dedup.remove_repeats(docs(spark, [text] * 2000, [7] * 1000 + [None] * 1000)).collect()
    assert len(got) == 2000 and {(r.n_words, r.n_removed, r.kept) for r in got} == {(300, 300, "")}


def test_places_of_repeated_rows_are_distinct(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = docs(spark, [text] * 40, [7] * 40).coalesce(1).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = substring_dedup.repeated_places(frame, 5, 20).where("places is not null").collect()
    assert sorted(x for r in found for x in np.frombuffer(r.places, "<i4").tolist()) == list(range(26))
    got = substring_dedup.remove_repeats(docs(spark, [text] * 40, [7] * 40), 5).collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == [(30, 30, "")] * 40


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, data, same, name):
    assert same(queries.QUERIES[name](spark, data).toPandas()) == same(duck.sql(queries.SQL[name]).df())


# --- tokens, packing


def test_token_ids_equal_the_library(data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    odd = ["İstanbul ΣΑΣ ς É́ é", "<|endoftext|> x<|STARTOFTEXT|>y <|startoftext|>z", "it's I'LL don't 12.5* a_b ½²", "é 가 ᅡ", "a\u0085b\xa0c　d ŉǄẞ"]
    texts = [t for t in [*HARD[:7], *HARD[8:], *odd, *text_of(data).values()]]
    own = tokens.encoder()
    for t in texts:
        assert next(tokens.encode(pa.array([t], pa.string()))).tolist() == library.encode(t or "", add_special_tokens=False).ids


def brute_ids(text, end):
    from tokenizers import Tokenizer

    library = brute_ids.__dict__.setdefault("t", Tokenizer.from_file(tokens.tokenizer_path()))
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_columns(spark, data):
    want, start = [], 0
    for i, t in sorted(text_of(data).items()):
        ids = brute_ids(t, 2)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op3_token_columns"](spark, data).collect())) == want


def test_token_columns_on_hard_rows(spark):
    table = token_columns.write_tokens(hard(spark))
    got = token_columns.starts(table).orderBy(F.col("start")).collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert all(r.tokens == brute_ids("null id" if r.doc_id is None else HARD[r.doc_id], 2) for r in got)
    assert token_columns.starts(token_columns.write_tokens(empty(spark))).collect() == []


def test_one_document_is_read_from_its_pages_alone(spark, data, tmp_path):
    """Row groups and page indexes let a reader of one document, or of one metadata column, leave the rest unread."""
    import glob

    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    source = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").coalesce(1)
    layout = token_columns.LAYOUT | {"parquet.block.size": str(1 << 16), "parquet.page.row.count.limit": "20"}
    token_columns.token_rows(source).coalesce(1).write.options(**layout).parquet(str(tmp_path / "t"))
    (name,) = glob.glob(str(tmp_path / "t" / "*.parquet"))
    meta = pq.ParquetFile(name).metadata
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            column = meta.row_group(g).column(c)
            assert column.has_offset_index and column.has_column_index
            assert column.path_in_schema != "tokens.list.element" or {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
    ids = sorted(text_of(data))
    wanted = ids[len(ids) // 2]
    fragments = [f for whole in ds.dataset(name).get_fragments() for f in whole.split_by_row_group(ds.field("doc_id") == wanted)]
    assert len(fragments) == 1
    (row,) = ds.dataset(name).to_table(filter=ds.field("doc_id") == wanted).to_pylist()
    assert row["tokens"] == brute_ids(text_of(data)[wanted], 2)
    plan = spark.read.parquet(str(tmp_path / "t")).where(F.col("doc_id") == wanted).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan and "EqualTo(doc_id" in plan
    sizes = {meta.row_group(0).column(c).path_in_schema: sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups)) for c in range(meta.num_columns)}
    assert sizes["n_tokens"] * 20 < sizes["tokens.list.element"]


def test_packing(spark, data):
    frame = queries.QUERIES["op7_best_fit_packing"](spark, data).toPandas()
    want = []
    for i, t in text_of(data).items():
        ids = brute_ids(t, 1)
        want += [(i, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(tuple, frame[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    check_packed(frame, 4096)
    assert frame.sequence_id.nunique() <= frame.length.sum() / 4096 * 1.1 + 4


def check_packed(frame, capacity):
    for _, own in frame.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1].tolist()] and own.length.sum() <= capacity


def test_packing_of_hard_rows(spark):
    frame = packing.pack(packing.pieces(hard(spark), 64), 64, 3).toPandas()
    assert len(frame[frame.doc_id == 5]) == 2 and frame[frame.doc_id == 7].length.sum() == len(brute_ids(LONG, 1))
    check_packed(frame, 64)
    assert packing.pack(packing.pieces(empty(spark))).collect() == []


@pytest.mark.parametrize("open_bins", [1, 2, 7, 1000])
def test_packer_is_best_fit(open_bins):
    rng, capacity = random.Random(open_bins), 100
    packer, bins, live = packing.Packer(capacity, open_bins), {}, []
    for _ in range(3000):
        n = rng.randrange(1, capacity + 1)
        fits = [capacity - bins[b] for b in live if capacity - bins[b] >= n]
        b, offset = packer.put(n)
        assert offset == bins.get(b, 0) and (b in live) == bool(fits)
        if fits:
            assert capacity - bins[b] == min(fits)
        bins[b] = offset + n
        live = [x for x in {*live, b} if bins[x] < capacity]
        if len(live) > open_bins:
            live.remove(max(live, key=lambda x: (bins[x], x != b) if x != b else (bins[x], True)))
            live = sorted(live)
        assert packer.open <= open_bins and sum(map(len, packer.free.values())) == packer.open
        live = [x for own in packer.free.values() for x in own]
    assert max(bins.values()) <= capacity


# --- decontamination


def test_decontamination_of_hard_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, ""), (4, None), (2, "short ITEM"), (None, "no id here"), (10, "short item")], "item_id long, text string")
    texts = [*HARD, "x ONE two, three-four five six seven eight nine ten. y", "a short item and no id here", "one two three four five six seven eight nine"]
    for block in (1 << 20, 10):
        got = {r.doc_id: r for r in decontaminate.scan(docs(spark, texts), items, 10, block).collect()}
        assert got[10].hit_spans == [[1, 11]] and got[10].item_ids == ["1"]
        assert got[11].hit_spans == [[1, 3], [4, 7]] and got[11].item_ids == ["10", "2"]
        assert not got[12].hit_spans and not any(got[i].hit_spans for i in range(10)) and got[7].n_words == 60_000
    cut = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), items, whole=False).collect()}
    assert cut[10].text == "x . y" and cut[10].n_chars == 5 and cut[10].score == "own" and len(cut) == len(texts)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs(spark, texts), items).collect()) == [*range(10), 12]
    assert decontaminate.scan(empty(spark), items).collect() == []
    assert all(not r.hit_spans for r in decontaminate.scan(docs(spark, texts), items.limit(0)).collect())
    assert decontaminate.scan(hard(spark), items).count() == len(HARD) + 2


def test_decontamination_keeps_columns_of_any_name(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    frame = docs(spark, ["a one two three four five six seven eight nine ten b", "clean", None]).withColumns({"n_words": F.lit("own"), "hit_spans": F.lit(1.5), "item_ids": F.lit("mine"), "n_chars": F.col("n_chars").cast("int")})
    for whole, n in ((True, 2), (False, 3)):
        out = decontaminate.decontaminate(frame, items, whole=whole)
        assert out.schema.simpleString() == frame.schema.simpleString()
        got = out.collect()
        assert len(got) == n and all((r.n_words, r.hit_spans, r.item_ids) == ("own", 1.5, "mine") for r in got)


def test_windows_of_a_benchmark_are_compact():
    """A megabyte of benchmark text makes its arrays in a moment, at most 22 bytes a window and the text."""
    import pickle
    import time

    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(400))) for i in range(400)]
    begun = time.monotonic()
    windows = decontaminate.windows_of(items, 10)
    assert time.monotonic() - begun < 5
    n = sum(len(x[0]) for x in windows.by_size.values())
    assert n == 400 * 391 and len(pickle.dumps(windows)) <= 22 * n + len(windows.text)
    text = pa.array([items[7][1][:600], "w1 w2"])
    (words, spans, found), (_, none, _) = decontaminate.scan_rows(text, windows, windows.bitmaps())
    assert spans and spans[0][0] == 0 and found == {"7"} and none == [] and spans[0][1] in (words, words - 1)


def test_windows_that_many_items_share():
    """Four thousand items with one window and eight hundred hits of it: one comparison and one set a hit, in a moment."""
    import time

    same = "one two three four five six seven eight nine ten"
    items = [(i, f"{same} own{i}" if i % 2 else same) for i in range(4000)] + [(5000, "a b c"), (None, same)]
    windows = decontaminate.windows_of(items, 10)
    text = pa.array([" x ".join([same] * 800), f"{same} own7", "a b c", "nothing here", None])
    begun = time.monotonic()
    got = decontaminate.scan_rows(text, windows, windows.bitmaps())
    assert time.monotonic() - begun < 1
    assert len(got[0][2]) == 4000 and len(got[0][1]) == 800 and got[0][0] == 800 * 11 - 1
    assert len(got[1][2]) == 4000 and got[2][2] == {"5000"} and got[3][2] == set() and got[4] == (0, [], set())


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """With hashes that collide, windows are still compared by their words."""
    real = decontaminate.gram_hashes
    monkeypatch.setattr(decontaminate, "gram_hashes", lambda words, size: real(words, size) % np.uint64(3) << np.uint64(61))
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("abcd", k=rng.randrange(1, 7)))) for i in range(60)]
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(0, 30))) for _ in range(40)]
    windows = decontaminate.windows_of(items, 3)
    got = decontaminate.scan_rows(pa.array(texts), windows, windows.bitmaps())
    for text, (n, spans, names) in zip(texts, got):
        words = text.split()
        hit, own = set(), set()
        for i, item in items:
            w = item.split()
            for size in [min(3, len(w))] if w else []:
                for k in range(len(w) - size + 1):
                    for j in range(len(words) - size + 1):
                        if words[j : j + size] == w[k : k + size]:
                            hit.update(range(j, j + size))
                            own.add(str(i))
        assert (n, {k for s, e in spans for k in range(s, e)}, names) == (len(words), hit, own)


def test_blocks_of_a_benchmark_share_a_map_step(spark, monkeypatch):
    """Twenty blocks give what one gives, in three steps of eight at most."""
    rng = random.Random(6)
    items = spark.createDataFrame([(i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=12))) for i in range(60)], "item_id long, text string")
    texts = [" ".join(rng.choices([f"w{k}" for k in range(40)], k=60)) for _ in range(30)] + [r.text for r in items.collect()[:9]]
    key = lambda frame: [(r.doc_id, r.n_words, r.hit_spans, r.item_ids) for r in frame.orderBy("doc_id").collect()]
    whole = decontaminate.scan(docs(spark, texts), items, 2)
    size = -(-sum(len(r.text) for r in items.collect()) // 20)
    many = decontaminate.scan(docs(spark, texts), items, 2, size)
    assert decontaminate.blocks_of(items, size) == 20 and many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3
    assert key(many) == key(whole)


# --- SimHash


def brute_components(prints):
    ids = sorted({i for i, _ in prints if i is not None})
    root = {k: k for k in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array([f & (1 << 64) - 1 for _, f in prints], np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    del ids
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min([v for v in (least.get(find(k)), i) if v is not None], default=None)
    return [least[find(k)] for k in range(len(prints))]


@pytest.mark.parametrize("bucket_most", [512, 3])
def test_components_of_planted_fingerprints(spark, bucket_most):
    rng = random.Random(5)
    made = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            centre ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([0, 1, 2, 3])))
            made.append(centre)
    rng.shuffle(made)
    prints = [(i, f) for i, f in enumerate(made)]
    df = spark.createDataFrame([(i, i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "doc_id long, text_key long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df, bucket_most).collect()}
    assert [got[i] for i in range(len(made))] == brute_components(prints)


def test_hot_buckets_are_dealt_until_they_are_small(spark):
    """2,000 fingerprints that share 32 bits, chains among them: links as of brute force, by pivot coordinates alone."""
    rng = random.Random(17)
    head = rng.getrandbits(32) << 32
    made = {head | rng.getrandbits(32) for _ in range(1500)}
    for f in list(made)[:300]:
        made.add(f ^ 1 << rng.randrange(64))
        made.add(f ^ (1 << rng.randrange(64) | 1 << rng.randrange(64)))
    made = sorted(made)
    signed = [f - (1 << 64) if f >> 63 else f for f in made]
    df = spark.createDataFrame([(i, i, f) for i, f in enumerate(signed)], "doc_id long, text_key long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df, 64).collect()}
    assert [got[i] for i in range(len(made))] == brute_components(list(enumerate(made)))
    seen = df.select("fp", F.lit(0).cast("long").alias("bucket"), F.array(*[F.lit(simhash._signed(m)) for m in simhash.MASKS]).alias("blocks"))
    most = []
    for width in (16, 8, 4):
        seen = simhash.dealt(seen, width)
        most.append(seen.groupBy("bucket").count().agg(F.max("count")).first()[0])
    assert most[0] >= 1500 and most[1] < 200 and most[2] < 30


def test_coordinates_of_small_blocks_tell_all_values_apart():
    import numpy.linalg as la

    for width in (8, 4):
        for low in range(0, 64, width):
            signs = np.array([[1 - 2 * (r >> k & 1) for k in range(low, low + width)] for r in simhash.REFERENCES])
            assert la.matrix_rank(signs) == width


def brute_fingerprint(text):
    import xxhash

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_query(spark, data):
    texts = text_of(data)
    got = queries.QUERIES["op10_simhash_pivots"](spark, data).toPandas().sort_values("doc_id")
    prints = [(i, brute_fingerprint(texts[i])) for i in got.doc_id]
    assert got.fingerprint.tolist() == [f"{f:016x}" for _, f in prints]
    assert got.component_id.tolist() == brute_components(prints)


def test_near_dedup_of_hard_rows(spark):
    kept = simhash.keep_one(hard(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]  # 5 and 6 are copies
    assert all(r.score == "own" and r.fp == "own" for r in kept)
    assert simhash.keep_one(empty(spark)).collect() == []
    assert simhash.near_duplicates(hard(spark)).count() == len(HARD) + 2


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) else set() for t in (a, b))
    return 1.0 if x == y else len(x & y) / len(x | y)


def near_families(rng):
    """Base texts with copies of few changes, chains of copies, and texts that share passages."""
    made = []
    for _ in range(15):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        made.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            made.append(" ".join(own).capitalize() + ".")
    shared = " ".join(f"p{i}" for i in range(100))
    made += [shared + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for _ in range(6)]
    return made


@pytest.mark.parametrize("large", [256, 3])
def test_near_dedup_against_brute_similarity(spark, large):
    """Whatever similarity 0.85 or more connects is one group; what stays under 0.6 is not."""
    texts = near_families(random.Random(12))
    found = wide_simhash.similar(docs(spark, texts), large=large).collect()
    group = {r.doc_id: r.component_id for r in found}
    assert len(found) == len(texts)
    for i, k in itertools.combinations(range(len(texts)), 2):
        s = jaccard(texts[i], texts[k])
        assert s < 0.85 or group[i] == group[k]
        assert s > 0.25 or group[i] != group[k]
    assert all(group[i] <= i for i in group)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect())
    assert kept == sorted(set(group.values()))


@pytest.mark.parametrize("large, side", [(10_000, 4096), (4, 4096), (10_000, 16), (4, 5)])
def test_links_of_a_bucket_lose_none(spark, large, side):
    """A large bucket is connected as brute force connects it, with leaders and without, in one piece and over a grid."""
    rng, radius = random.Random(3), 10
    made = []
    for _ in range(6):
        centre = rng.getrandbits(256)
        for _ in range(rng.choice([1, 4, 40])):
            centre ^= sum(1 << rng.randrange(256) for _ in range(rng.choice([2, 6, 9])))
            made.append(centre)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *[signed(f >> 64 * k & (1 << 64) - 1) for k in range(4)], [7] * 2) for i, f in enumerate(made)]
    sets = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long, bands array<long>")
    found = [(r.a, r.b) for r in wide_simhash.links(sets, radius, large, side).collect()]
    near = [(i, k) for i, k in itertools.combinations(range(len(made)), 2) if (made[i] ^ made[k]).bit_count() <= radius]

    def groups(pairs):
        root = list(range(len(made)))
        for _ in range(len(made)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(found) == groups(near)


def test_pages_of_common_boilerplate_are_dealt_over_a_grid(spark):
    """6,000 pages in one bucket, few of them alike: all are compared, in pieces of 1,024 rows and columns."""
    noise = [F.xxhash64("id", F.lit(k)) for k in range(4)]
    pages = spark.range(6_000).select((F.col("id") * 2).alias("node"), *[n.alias(f"f{k}") for k, n in enumerate(noise)])
    twins = spark.range(0, 6_000, 1000).select((F.col("id") * 2 + 1).alias("node"), *[(n.bitwiseXOR(F.lit(5))).alias(f"f{k}") for k, n in enumerate(noise)])
    sets = pages.union(twins).withColumn("bands", F.array(F.lit(7).cast("long")))
    found = wide_simhash.links(sets, side=1024)
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} == {(k, k + 1) for k in range(0, 12_000, 2000)}


def test_near_dedup_of_null_ids(spark):
    """Near copies without any id are one group, of which one row stays."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    made = [" ".join(base), *(" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 400, 80))]
    frame = docs(spark, [*made, "another text that is not near", None, "", "short one", "Short, one!"], [None] * (len(made) + 5))
    assert simhash.keep_one(frame).count() == 4
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, made)).collect()) == [0]


# --- quality


def accuracy(frame, data, column):
    met = frame.merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
    own = met[met.held_out]
    return len(own), (own.predicted == own[column]).mean()


def test_quality_of_held_out_documents(spark, data):
    frame = queries.QUERIES["op1_quality_crf"](spark, data).toPandas()
    assert frame.score.between(0, 1).all() and len(frame) == len(text_of(data))
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(frame.doc_id, frame.held_out))
    n, share = accuracy(frame, data, "quality")
    assert n > 5 and share >= 0.9


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    evidence, moves = rng.normal(size=5).tolist(), rng.normal(size=(2, 2))
    total = np.zeros((5, 2))
    for y in itertools.product((0, 1), repeat=5):
        weight = np.exp(sum(e * v for e, v in zip(evidence, y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        for k, v in enumerate(y):
            total[k, v] += weight
    assert np.allclose(quality.marginals(evidence, moves), total[:, 1] / total.sum(1))


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    lengths, good = np.array([4, 2, 1]), np.array([1.0, 0.0, 1.0])
    starts, x = np.array([0, 4, 6]), rng.normal(size=(7, 3))
    weights, moves = rng.normal(size=3), rng.normal(size=(2, 2))

    def likelihood(weights, moves):
        out = 0.0
        for s, n, g in zip(starts, lengths, good):
            score = x[s : s + n] @ weights
            every = [sum(score[k] * v for k, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)]
            own = score.sum() * g + (n - 1) * moves[int(g), int(g)]
            out += (own - np.log(np.exp(every).sum())) / n
        return out / 3

    dw, dm = quality._gradient(x, starts, lengths, good, weights, moves)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert np.isclose(dw[k], (likelihood(weights + step, moves) - likelihood(weights - step, moves)) / 2e-6, atol=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-6
        assert np.isclose(dm[a, b], (likelihood(weights, moves + step) - likelihood(weights, moves - step)) / 2e-6, atol=1e-6)


def test_classifiers_on_hard_rows(spark):
    for of, label in ((quality, "quality"), (toxicity, "toxic")):
        kind = f"doc_id long, {label} int, score string"
        for rows in ([], [(3, 1, "x"), (4, 0, "x"), (5, None, "x"), (7, 1, "x"), (None, 1, "x")], [(3, 1, "x"), (4, 1, "x")]):
            model = of.train(hard(spark), spark.createDataFrame(rows, kind))
            got = of.scored(hard(spark), model).collect()
            assert len(got) == len(HARD) + 2 and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
            if not rows:
                assert {r.score for r in got} == {0.5}
            assert of.scored(empty(spark), model).collect() == []
    assert {r.score for r in quality.keep_good(hard(spark), spark.createDataFrame([], "doc_id long, quality int")).collect()} == {"own"}


# --- toxicity


def test_toxicity_of_held_out_documents(spark, data):
    data = os.path.join(os.path.dirname(data.rstrip("/")), "sf0.01")
    frame = queries.QUERIES["op4_toxicity_grammar"](spark, data).toPandas()
    n, share = accuracy(frame, data, "toxic")
    assert n > 50 and share >= 0.9
    met = frame.merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
    both = ((met.predicted == 1) & (met.toxic == 1)).sum()
    assert both >= 0.55 * (met.toxic == 1).sum() and both >= 0.9 * (met.predicted == 1).sum()


def test_fitted_rows_are_bounded(spark):
    """A doc_id gives one row of the sample, however many rows bear it; a long document gives its first lines."""
    texts = [f"line {i} of this text.\nMore of it, {i}." for i in range(200)] + ["bad bad bad\n" * 400]
    frame = docs(spark, texts, [1] * 200 + [2])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")  # neither is held out
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda row, *rest: seen.append(np.bincount(row).tolist()) or fit(row, *rest)
        quality.train(frame, labels)
    finally:
        quality.fit = fit
    assert sorted(seen[0]) == [2, quality.MOST_LINES]


def test_grammar_marks_clauses():
    g = toxicity.Grammar({"idiot": 2.0, "moron*": 1.0})
    assert not g.matches("then plain idiot came.") and not g.matches("") and not g.matches("in time kill")
    assert g.matches("you were an idiot.") == {"insult+person": 2.0}
    assert g.matches("then idiot, said of you") == {} and g.matches("then idiot said of you") == {"insult+person": 2.0}
    assert g.matches("this is not an idiot.") == {"insult+subject+not": 2.0}
    assert g.matches("nobody. idiot") == {"insult+address": 2.0}
    assert g.matches("she said the idiot left. idiot!") == {"insult+person+told": 2.0, "insult+address": 2.0}
    assert g.matches("now we will kill them") == {"threat+person": 2.0}
    assert g.matches("oh worse, moronic idiot") == {"insult+heap": 2.0} and g.matches("moron") == {}


def brute_matches(g, text):
    """Each insult and threat by its place in its sentence."""
    found = {}
    for sentence in re.split(r"[.!?\n]", text):
        words = re.findall(r"[^\W\d_]+|[,;:]", sentence)
        weight = [g.insults.get(w) or max([v for k, v in g.insults.items() if k.endswith("*") and len(w) >= len(k) and w.startswith(k[:-1])], default=0) or toxicity.THREATS.get(w, 0) for w in words]
        is_insult = [bool(v) and (w in g.insults or w not in toxicity.THREATS) for w, v in zip(words, weight)]
        for i, w in enumerate(words):
            if not weight[i]:
                continue
            before = words[:i]
            clause = before[max([k + 1 for k, x in enumerate(before) if x in ",;:"], default=0) :]
            after = words[i + 1 : i + 5]
            after = after[: min([k for k, x in enumerate(after) if x in ",;:"], default=4)]
            plain = lambda x: x not in g.insults and x not in toxicity.THREATS
            tie = None
            if all(x in ",;:" for x in before):
                tie = "+address"
            if any(weight[max(0, i - 12) : i]):
                tie = "+heap"
            if any(x in toxicity.SUBJECTS for x in before[-10:]):
                tie = "+subject"
            if any(x in toxicity.PERSONS and plain(x) for x in (*clause[-4:], *after)):
                tie = "+person"
            if tie:
                mark = "+told" if any(x in toxicity.REPORTS for x in before) else "+not" if any(x in toxicity.NEGATIONS for x in clause[-3:]) else ""
                kind = ("insult" if is_insult[i] else "threat") + tie + mark
                found[kind] = found.get(kind, 0) + weight[i]
    return found


def test_grammar_equals_brute_force():
    rng = random.Random(11)
    g = toxicity.Grammar({"idiot": 2.0, "trottel": 1.0, "scum": 0.5, "worthl*": 1.5})
    words = [*"idiot trottel scum worthless worthlessness kill hurt you them he the is not never said wrote , , ; . ! word other thing".split(), "then", "\n"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        assert dict(g.matches(text)) == pytest.approx(brute_matches(g, text)), text


def test_features_equal_matches_beside_other_punctuation():

    g = toxicity.Grammar({"idiota": 2.0, "trottel": 2.0, "crétin": 1.5, "crétini*": 1.0})
    texts = ["¡Idiota!", "“trottel”", "«crétin» vous", "du—trottel—", "tu\xa0idiota", "„Trottel“ sagte er", "la ünder 你好 \U0001f600idiota\U0001f600", "idiota²", "١idiota", "¿crétinistes?", None, "", "idiotaé", "kill…them", "plain words"]
    found = g.features(pa.array(texts, pa.string()))
    own = [g.matches((t or "").lower()) for t in texts]
    assert sum(bool(m) for m in own) == 10  # not of the superscript, the longer word, the plain words and the empty rows
    assert np.allclose(found[:, :-1], [[np.log1p(m[k]) for k in toxicity.KINDS] for m in own])


# --- secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(f"{secrets.KINDS[k]}", s, e) for s, k, e in sorted(found)]


TRICKY = ["password: token: abcdefgh", "token=token=abcdef", "ApI_Key = 'abc.def' apikey:\"zzzzzz", "é\U0001f600 secret=ééé secret = 123456", "AKIAAKIA" + "B" * 20 + " AKIA123", "f" * 23 + "g" + "0" * 24, "passwd:\nabcdefg", "ſecret=abcdefgh toKen=abcdefgh"]


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_secrets_on_hard_rows(spark):
    texts = [*HARD, *TRICKY]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, texts)).select("doc_id", secrets.told(F.col("base")).alias("b"), "score").collect()}
    assert [got[i].b for i in range(len(texts))] == [told(brute_base(t or "")) for t in texts]
    assert got[0].score == "own" and secrets.scan(empty(spark)).collect() == [] and secrets.scan(hard(spark)).count() == len(HARD) + 2
    red = {r.doc_id: r for r in secrets.redact(docs(spark, texts)).collect()}
    assert red[11].text == "[SECRET]" and red[13].text == "é\U0001f600 secret=ééé [SECRET]" and red[13].n_chars == len(red[13].text) and red[1].text is None and red[7].text == LONG


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(9)
    words = ["antidisestablishmentarianism", "counterrevolutionaries", "internationalizations", "Donaudampfschifffahrt", "electroencephalographs", "incomprehensibilities", "uncharacteristically", "deinstitutionalization", "psychophysicotherapeutics", "hypercholesterolemias", "overintellectualizing", "pneumonoultramicroscopic"]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) + "a1B" for n in (37, 45, 61)] + ["".join(rng.choice("0123456789ABCDEF") for _ in range(40)) + "A1"]
    rows = secrets.scan(docs(spark, [*[f"see {k} here" for k in keys], *[f"the {w} of" for w in words], "zzzzzzzzzzzzzzzzzzzzzzzz1B zzzz1111zzzz1111zzzz1111zzzzB"])).collect()
    spans = {r.doc_id: [(x.s, x.e) for x in r.spans] for r in rows}
    assert [spans[i] for i in range(len(keys))] == [[(4, 4 + len(k))] for k in keys]
    assert not any(spans[i] for i in range(len(keys), len(rows)))


@pytest.mark.parametrize("words", [12, 0])
def test_random_tokens_of_every_alphabet_are_found(spark, words):
    """Upper-case base 36, either case with signs, base 64; also in a corpus without ordinary tokens."""
    rng = random.Random(2)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(rng.choice(a) for _ in range(56)) + end for a, end in ((upper, "0189Z"), (upper.lower() + "_/", "_8z/0"), (upper + "+/", "+9A/1"), (upper + upper.lower() + "+/", "a1B")) for _ in range(3)]
    plain = ["uncharacteristicallyantidisestablishmentarianism", "src/main/resources/settings2/default_values", "SECTION_TWO_OF_THE_CONTRACT_2024", "see/2024/2024/2024/2024/2024"]
    some = ["antidisestablishmentarianism", "counterrevolutionaries", "internationalizations", "electroencephalographs"] * (words // 4)
    spans = {r.doc_id: [(x.s, x.e) for x in r.spans] for r in secrets.scan(docs(spark, [*[f"see {k} here" for k in keys], *plain, *some])).collect()}
    assert [spans[i] for i in range(len(keys))] == [[(4, 4 + len(k))] for k in keys]
    assert not any(spans[i] for i in range(len(keys), len(spans)))
    if not words:
        alone = secrets.scan(docs(spark, [f"see {k} here" for k in keys])).collect()
        assert all([(x.s, x.e) for x in r.spans] == [(4, 4 + len(keys[r.doc_id]))] for r in alone)


def brute_misfit(token, alphabet):
    """Minus the logarithm of the joint tail probability, by loops."""
    import math

    at, k = [alphabet.index(c) for c in token], len(alphabet)
    n = len(at)

    def tail(z):
        return max(1 / (1 + math.exp(min(0.07056 * z**3 + 1.5976 * z, 200))), 1e-80)

    chi = sum((at.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    spread = 2 / (9 * (k - 1))
    uniform = tail(((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    halves = [x >= k / 2 for x in at]
    runs, high = 1 + sum(a != b for a, b in zip(halves, halves[1:])), sum(halves)
    mean = 2 * high * (n - high) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    by_runs = tail(abs(runs - mean) / math.sqrt(variance) if variance > 0 else 6)
    middle = sum(at) / n
    power = sum((x - middle) ** 2 for x in at)
    serial = tail(abs(sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / power + 1 / n) * math.sqrt(n) if power > 0 else 6)
    half = -(math.log(uniform) + math.log(min(1, 2 * by_runs)) + math.log(min(1, 2 * serial)))
    return half - math.log(1 + half + half * half / 2)


def brute_random(texts, rate=secrets.RATE):
    """All spans by text: the tests, the null from ordinary tokens and the prior, Benjamini-Hochberg over bins."""
    import math

    tokens = []
    for d, text in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
            t = m[0].replace("_", "/").replace("-", "")
            for pattern, alphabet, is_open in secrets.ENCODINGS:
                if re.fullmatch(pattern, t):
                    if is_open is not None and len(t) >= secrets.LEAST:
                        tokens.append((d, m.start(), m.end(), len(t), brute_misfit(t, alphabet), is_open))
                    break
    each, usual, apart = secrets.PRIOR
    plain = [(n, x) for _, _, _, n, x, is_open in tokens if not is_open] + [(each, each * usual + sign * apart * math.sqrt(each)) for sign in (-1, 1) for _ in range(secrets.ORDINARY // 2)]
    mean = sum(x for _, x in plain) / sum(n for n, _ in plain)
    spread = max(0.05, math.sqrt(sum((x - mean * n) ** 2 / n for n, x in plain) / len(plain)))
    bins = []
    for d, s, e, n, x, is_open in tokens:
        if is_open:
            z = -(x - mean * n) / (spread * math.sqrt(n))
            bins.append((min(math.floor(-math.log(max(1 / (1 + math.exp(min(0.07056 * z**3 + 1.5976 * z, 200))), 1e-80)) * secrets.BINS_EACH), secrets.BINS), d, s, e))
    held = [b for b, *_ in bins if math.exp(-b / secrets.BINS_EACH) * len(bins) <= rate * sum(x >= b for x, *_ in bins)]
    found = [brute_base(t or "") for t in texts]
    for b, d, s, e in bins:
        if held and b >= min(held) and not any(x < e and s < y for _, x, y in brute_base(texts[d])):
            found[d].append(("random", s, e))
    return [sorted(f, key=lambda x: (x[1], secrets.KINDS.index(x[0]))) for f in found]


def test_added_spans_equal_brute_force(spark, data):
    texts = text_of(data)
    want = dict(zip(texts, brute_random(list(texts.values()))))
    got = {r.doc_id: r.spans for r in queries.QUERIES["op6_secret_randomness"](spark, data).collect()}
    assert got == {i: told(f) for i, f in want.items()}
    rng = random.Random(21)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = [digits + "ABCDEF", lower.upper() + digits, lower + digits + "_/", lower + lower.upper() + digits + "+/_-", "the_of_a/0", "aeinrst"]
    made = [" ".join("".join(rng.choices(rng.choice(kinds), k=rng.randrange(18, 90))) for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    got = {r.doc_id: r.t for r in secrets.scan(docs(spark, made)).select("doc_id", secrets.told(F.col("spans")).alias("t")).collect()}
    assert [got[i] for i in range(len(made))] == [told(f) for f in brute_random(made)] and any("random" in t for t in got.values())


def test_secrets_in_very_long_texts(spark):
    """Places and tests take about linear work: 50,000 tokens in a text, and a token of a million letters."""
    import time

    rng = random.Random(4)
    tokens_of = " ".join(f"{rng.getrandbits(80):020x}" for _ in range(50_000))
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    begun = time.monotonic()
    got = {r.doc_id: r for r in secrets.scan(docs(spark, [tokens_of, f"see {blob} é"])).collect()}
    assert time.monotonic() - begun < 120
    assert [(x.s, x.e) for x in got[1].spans] == [(4, 4 + len(blob))]
    assert all(x.e - x.s == 20 and x.s % 21 == 0 for x in got[0].spans)


def test_secret_stage_keeps_columns_of_any_name(spark):
    text = 'x password = "hunter22" then AKIA' + "B" * 20 + " token=secret=abcdefgh end"
    frame = docs(spark, [text, None]).withColumns({"tokens": F.lit("own"), "spans": F.lit("mine"), "base": F.lit(3), "n_chars": F.col("n_chars").cast("int")})
    got = {r.doc_id: r for r in secrets.redact(frame).collect()}
    assert secrets.redact(frame).schema.simpleString() == frame.schema.simpleString()
    assert all((r.tokens, r.spans, r.base) == ("own", "mine", 3) for r in got.values())
    merged, at = [], 0
    for _, s, e in sorted(brute_base(text), key=lambda x: x[1]):
        if s >= at:
            merged.append([s, e])
        else:
            merged[-1][1] = max(merged[-1][1], e)
        at = max(at, e)
    want, at = [], 0
    for s, e in merged:
        want.append(text[at:s])
        at = e
    assert got[0].text == "[SECRET]".join([*want, text[at:]]) and got[0].n_chars == len(got[0].text) and got[1].text is None
    scanned = secrets.scan(frame)
    assert scanned.columns == [c for c in frame.columns if c not in ("spans", "base")] + ["spans", "base"]


def test_secrets_query(spark, data):
    texts = text_of(data)
    for r in queries.QUERIES["op6_secret_randomness"](spark, data).collect():
        base = brute_base(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in secrets.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [told([b]) for b in base]


# --- media


@pytest.mark.parametrize("size", [0, 1, 576, 577, 18_432, 18_433, 300_001])
def test_stream_round_trip(size):
    payload = media.padded(os.urandom(size))
    stream, index = media.mux(payload)
    back, points, errors = media.demux(stream)
    assert back == payload and not errors and len(stream) % 188 == 0 and all(p[2] for p in points) and points == index
    assert [p[1] for p in points] == [90_000 + 32 * 1080 * k for k in range(len(points))]


def test_stream_faults():
    stream, _ = media.mux(media.padded(os.urandom(9000)))
    assert media.demux(stream[: 188 * 5] + stream[188 * 6 :])[2] == 2  # a gap, and a short packet
    assert media.demux(stream[: 188 * 5] + stream[188 * 4 :]) [2] == 0  # a repeated packet
    assert media.demux(b"") == (b"", [], 1) and media.demux(b"x" * 400)[0] == b""


def test_media_query(spark, data):
    texts = text_of(data)
    for r in queries.QUERIES["op9_media_ts"](spark, data).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes % 188 == 0 and r.feature.endswith("errors=0")


def brute_stream(payload):
    """The stream packet by packet, from the format alone: tables, then the packets of each PES packet."""

    def crc(data):
        crc = 0xFFFFFFFF
        for bit in "".join(f"{b:08b}" for b in data):
            crc = crc << 1 ^ (0x04C11DB7 if (crc >> 31) ^ int(bit) else 0)
            crc &= 0xFFFFFFFF
        return crc.to_bytes(4, "big")

    def section(pid, table, body):
        whole = bytes([table, 0xB0, 5 + len(body) + 4, 0, 1, 0xC1, 0, 0]) + body
        return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + whole + crc(whole)

    out = [section(0, 0, bytes([0, 1, 0xF0, 0])).ljust(188, b"\xff"), section(0x1000, 2, bytes([0xE1, 0, 0xF0, 0, 6, 0xE1, 0, 0xF0, 0])).ljust(188, b"\xff")]
    count = 0
    for k in range(0, len(payload), 576 * 32):
        data, ticks = payload[k : k + 576 * 32], 90_000 + k // 576 * 1080
        bits = f"{ticks:033b}"
        stamp = int("0010" + bits[:3] + "1" + bits[3:18] + "1" + bits[18:] + "1", 2).to_bytes(5, "big")
        rest = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + data
        first = True
        while rest:
            clock = b"\x50" + int(bits + "1" * 6 + "0" * 9, 2).to_bytes(6, "big") if first else b""
            room = 184 - (len(clock) + 1 if first else 0)
            field = bytes([len(clock)]) + clock if first else b""
            if len(rest) < room:
                stuffing = 184 - len(rest)
                field = bytes([stuffing - 1]) + (b"\0" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
                room = len(rest)
            out.append(bytes([0x47, 0x41 if first else 0x01, 0, (0x30 if field else 0x10) | count & 15]) + field + rest[:room])
            rest, first, count = rest[room:], False, count + 1
    return b"".join(out)


def test_media_equals_brute_force(spark, data):
    """media_sha256 and feature of the query, by a writer of its own."""
    texts = text_of(data)
    for r in queries.QUERIES["op9_media_ts"](spark, data).collect():
        payload = media.padded((texts[r.doc_id] or "").encode())
        stream, pes = brute_stream(payload), -(-len(payload) // (576 * 32))
        assert r.media_sha256 == hashlib.sha256(stream).hexdigest() and r.media_bytes == len(stream)
        assert r.feature == f"packets={len(stream) // 188};pes={pes};entries={pes};pts=90000-{90_000 + (pes - 1) * 32 * 1080};errors=0"


def test_stored_points_lead_to_a_moment(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    table = common.written(media.streams(docs(spark, [text, None])), "media")
    payload = media.padded(text.encode())
    for moment in (0, 90_000, 90_000 + 32 * 1080 * 2 + 5, 1 << 40):
        got = {r.doc_id: r for r in media.parsed(media.from_moment(table, moment)).collect()}
        skipped = min(max(0, (moment - 90_000) // (32 * 1080)), (len(payload) - 1) // (576 * 32))
        assert bytes(got[0].payload) == payload[skipped * 576 * 32 :] and not got[0].errors and got[0].points == got[0].found
        assert bytes(got[1].payload) == b"\xff" * 576


def test_media_of_hard_rows(spark):
    got = media.parsed(media.streams(hard(spark))).collect()
    assert len(got) == len(HARD) + 2 and all(not r.errors for r in got)
    assert {bytes(r.payload) for r in got if r.doc_id in (0, 1)} == {b"\xff" * 576}
    assert media.parsed(media.streams(empty(spark))).collect() == []


# --- chat


def brute_cost(roles):
    """The least cost by the rules alone: whatever is opened follows "s?(ua)*", empty turns cost 2, any number of them."""
    may = {"": "su", "s": "u", "u": "a", "a": "u"}

    def opened(last):
        """Costs of having opened empty turns after last, by the last one then."""
        best, todo = {last: 0}, [last]
        while todo:
            x = todo.pop(0)
            for y in may[x]:
                if y not in best:
                    best[y] = best[x] + 2
                    todo.append(y)
        return best

    best = {"": 0}
    for role in roles:
        own, after = {0: None, 1: "s", 2: "u", 3: "a"}[role], {}
        for last, cost in best.items():
            if last:
                c = cost + (1 if own in (None, last) else 4)
                after[last] = min(after.get(last, c), c)
            for before, extra in opened(last).items():
                for y in may[before]:
                    c = cost + extra + (0 if y == own else 3 if own else 1)
                    after[y] = min(after.get(y, c), c)
        best = after
    return min(c + opened(last).get("a", 1 << 40) for last, c in best.items())


def legal(initials):
    return bool(re.fullmatch("s?(ua)+", initials))


def test_chat_repair(spark):
    rng, rows, roles_of = random.Random(4), [], {}
    names = {0: "narrator", 1: "system", 2: "user", 3: "assistant"}
    for conv in range(40):
        roles = [rng.choice((0, 1, 2, 2, 3, 3)) for _ in range(rng.randrange(1, 23))]
        roles_of[conv] = roles
        rows += [(conv, t, names[r], f"t{t} <|user|>") for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    one, few, single = (whole_chats(chat.repaired(df, b)) for b in (256, 4, 1))
    for conv, r in one.items():
        roles = roles_of[conv]
        assert r["cost"] == brute_cost(roles) and r["n_turns"] == len(roles) and legal(r["roles"])
        assert re.findall(r"t\d+", r["rendered"]) == [f"t{t}" for t in range(len(roles))]
        assert re.findall(r"<\|(\w+)\|>", r["rendered"]) == [x for i in r["roles"] for x in ({"s": "system", "u": "user", "a": "assistant"}[i], "end")]
    tree = whole_chats(chat.repaired(df, 1, 2))  # tables of single turns, two to one, over five levels
    assert len(one) == 40 and one == few == single == tree


def whole_chats(frame):
    """The rows of a conversation put together: sums, and roles and text in the order of the blocks."""
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.block)):
        own = out.setdefault(r.conv_id, {"n_turns": 0, "merges": 0, "relabels": 0, "insertions": 0, "roles": "", "rendered": "", "cost": r.cost})
        for c in ("n_turns", "merges", "relabels", "insertions", "roles", "rendered"):
            own[c] += r[c]
        assert own["cost"] == r.cost
    return out


def test_long_and_hot_conversations(spark):
    """Two thousand turns of one number, or of none, are cut into blocks; a text of a million letters passes whole."""
    rng = random.Random(5)
    rows = [(1, None if t % 2 else 7, rng.choice(["user", "assistant", None]), f"t{t:05}") for t in range(2000)]
    rows += [(2, 1, "user", "same")] * 700 + [(None, t, "user" if t % 2 == 0 else "bot", "x") for t in range(600)] + [(3, 0, "user", "y" * 1_000_000)]
    found = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 100)
    assert found.groupBy("conv_id").agg(F.max("n_turns")).where("max(n_turns) > 100").count() == 0
    got = whole_chats(found)
    code = {"user": 2, "assistant": 3, None: 0}
    own = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is None, r[1], r[2] or "", r[3]))
    assert got[1]["n_turns"] == 2000 and got[1]["cost"] == brute_cost([code[r[2]] for r in own]) and legal(got[1]["roles"])
    assert re.findall(r"t\d{5}", got[1]["rendered"]) == [r[3] for r in own]
    assert got[2]["rendered"].count("same") == 700 and got[2]["cost"] == brute_cost([2] * 700)
    assert got[None]["cost"] == 0 and got[None]["n_turns"] == 600 and len(got[3]["rendered"]) > 1_000_000


def test_tables_compose_to_those_of_all_turns():
    rng = random.Random(6)
    for _ in range(300):
        roles = [rng.randrange(4) for _ in range(rng.randrange(2, 30))]
        cuts = sorted({0, len(roles), *(rng.randrange(len(roles)) for _ in range(4))})
        parts = [chat.table(roles[a:b]) for a, b in zip(cuts, cuts[1:])]
        whole, made = chat.table(roles), chat.composed(parts)
        assert made[:16] == whole[:16]
        for e in range(4):
            there = [s for s in range(4) if whole[4 * s + e] < chat.FAR]
            order = lambda t: [[(t[16 + 4 * a + e] > t[16 + 4 * b + e]) - (t[16 + 4 * a + e] < t[16 + 4 * b + e]) for b in there] for a in there]  # noqa: B023, E731
            assert order(made) == order(whole)
        assert chat.edges([made]) == chat.edges([whole])
        total, path = chat.edges(parts)
        assert total == chat.edges([whole])[0] and [path[0], path[-1]] == chat.edges([whole])[1]


def test_chat_on_hard_rows(spark):
    kind = "conv_id long, turn int, role string, text string, cost string"
    rows = [(1, 0, None, None, "x"), (1, None, "USER ", "late", "x"), (1, 1, "bot", "", "x"), (None, 0, "user", "q", "x"), (None, 0, "user", "q", "x"), (2, 0, "Human", "hi", "x"), (2, 1, "gpt", "ho", "x")]
    got = {r.conv_id: r for r in chat.repaired(spark.createDataFrame(rows, kind)).collect()}
    assert got[2].cost == 0 and got[2].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nho<|end|>\n"
    assert got[1].roles == "uaua" and got[None].roles == "ua" and got[None].merges == 1
    assert chat.repaired(spark.createDataFrame([], kind)).collect() == []
