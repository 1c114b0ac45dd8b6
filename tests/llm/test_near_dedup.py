"""The pipeline's near-dedup: candidates by tables of distances to references, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from test_operators import docs, jaccard

from plotwright.llm import wide_simhash


def lanes(fingerprints):
    """A row a lane, as the functions on arrays take them."""
    return np.array([[f >> 64 * k & (1 << 64) - 1 for f in fingerprints] for k in range(4)], np.uint64)


def flipped(rng, f, bits):
    return f ^ sum(1 << b for b in rng.sample(range(256), bits))


def whole(row):
    return sum(int(v) << 64 * k for k, v in enumerate(row))


@pytest.mark.parametrize("width", [12, 13, 16])
def test_keys_are_distances_to_references(width):
    """A bucket is what has equal distances to all references within a block; equal blocks always do, and nearly nothing else does."""
    rng = random.Random(width)
    made = [rng.getrandbits(256) for _ in range(40)]
    blocks = [whole(m) for m in wide_simhash.masks(width)]
    assert len(blocks) == wide_simhash.tables(width) and all(m.bit_count() == width for m in blocks)
    made += [f ^ (rng.getrandbits(256) & ~blocks[k % len(blocks)]) for k, f in enumerate(made)]
    keys = wide_simhash.block_keys(lanes(made), width)
    references = [whole(r) for r in wide_simhash.REFERENCES]
    for b in (0, 7, len(blocks) - 1):
        plain = [tuple(((f ^ r) & blocks[b]).bit_count() for r in references) for f in made]
        for i, k in itertools.combinations(range(len(made)), 2):
            assert (keys[i, b] == keys[k, b]) == (plain[i] == plain[k])
    assert all(keys[k, k % len(blocks)] == keys[40 + k, k % len(blocks)] for k in range(40))
    assert len({int(k) for k in keys[0]}) == len(blocks)  # tables have keys of their own


@pytest.mark.parametrize("width", [12, 14, 17])
def test_tables_miss_few(width):
    """Of 3,000 pairs 39 bits apart about 6 meet in no table, whatever the width."""
    rng = random.Random(4)
    made = [rng.getrandbits(256) for _ in range(3000)]
    one, other = (wide_simhash.block_keys(lanes(x), width) for x in (made, [flipped(rng, f, 39) for f in made]))
    assert (one == other).any(axis=1).sum() >= 2982


def test_coordinates_discard_unrelated_pairs_only():
    rng = random.Random(6)
    made = [rng.getrandbits(256) for _ in range(300)]
    made += [flipped(rng, f, k % 60) for k, f in enumerate(made)]
    table = wide_simhash.coordinates(lanes(made))
    i, j = wide_simhash.survivors(table, np.arange(600), 0, 600, 48)
    kept = set(zip(i.tolist(), j.tolist()))
    near = {(a, b) for a, b in itertools.combinations(range(600), 2) if (made[a] ^ made[b]).bit_count() <= 48}
    assert near <= kept and len(near) >= 240
    assert len(kept - near) <= 0.004 * 600 * 599 / 2


@pytest.mark.parametrize("large, batch", [(4096, 10_000), (4096, 3), (2, 10_000)])
def test_pivot_links_connect_near_fingerprints(spark, large, batch):
    """Chains, clusters and single fingerprints: components as of brute force, whatever share of a bucket an Arrow batch holds."""
    rng = random.Random(9)
    made = []
    for _ in range(25):
        centre = rng.getrandbits(256)
        for _ in range(rng.choice([1, 3, 30])):
            centre = flipped(rng, centre, rng.choice([0, 3, 20, 30]))
            made.append(centre)
    rng.shuffle(made)
    root = list(range(len(made)))
    for i, k in itertools.combinations(range(len(made)), 2):
        if (made[i] ^ made[k]).bit_count() <= 48:
            low, high = sorted((root[i], root[k]))
            root = [low if r == high else r for r in root]
    rows = [(i, *np.array(x, np.uint64).view(np.int64).tolist()) for i, x in enumerate(lanes(made).T)]
    sets = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        pairs = [(r.a, r.b) for r in wide_simhash.links(wide_simhash.with_keys(sets, 12), 48, large).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = list(range(len(made)))
    for a, b in pairs:
        low, high = sorted((got[a], got[b]))
        got = [low if r == high else r for r in got]
    assert got == root


def test_recall_of_similar_texts(spark):
    """Copies of Jaccard similarity 0.8 to 0.86 link, but for one in ten at most; unrelated texts do not."""
    rng = random.Random(21)
    texts = []
    for _ in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(150, 300))]
        copy = list(base)
        while True:
            own = list(copy)
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            if jaccard(" ".join(base), " ".join(own)) < 0.8:
                break
            copy = own
        texts += [" ".join(base), " ".join(copy)]
    group = {r.doc_id: r.component_id for r in wide_simhash.similar(docs(spark, texts)).collect()}
    linked = [group[2 * k] == group[2 * k + 1] for k in range(120)]
    assert sum(linked) >= 108
    assert len(set(group.values())) == 240 - sum(linked)
