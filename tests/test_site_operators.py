"""Operators on small rasters, shapes and graphs with known answers."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright import streaming
from plotwright.functions import crs
from plotwright.functions import features as P
from plotwright.functions import geometry as G
from plotwright.operators import block_search, earthwork, graph, layout, paths, raster, roads, rules, scanlines, selection, spatial, stencil, zones
from plotwright.sources import asciigrid

CELLS = "dem_id long, row int, col int, z double"


def grid(spark, z):
    return spark.createDataFrame([(0, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], CELLS)


def array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize(("z", "slope", "aspect"), [
    (np.tile(np.arange(5.0), (5, 1)), 45.0, 270.0), (np.tile(4 - np.arange(5.0)[:, None], (1, 5)), 45.0, 180.0), (np.zeros((5, 5)), 0.0, -1.0), (2 * np.tile(np.arange(3.0), (3, 1)), 63.43494882, 270.0), (0.1 * np.tile(np.arange(3.0), (3, 1)), 5.71059314, 270.0),
])
def test_ramps(spark, z, slope, aspect):
    found = stencil.terrain(grid(spark, z), 1.0)
    middle = found.where(f"row = {z.shape[0] // 2} and col = {z.shape[1] // 2}").first()
    assert math.isclose(middle.slope_deg, slope, abs_tol=1e-6) and math.isclose(middle.aspect, aspect, abs_tol=1e-6)


def test_horn_equals_padded_arrays(spark):
    z = np.random.default_rng(1).normal(size=(7, 9))
    p = np.pad(z, 1, mode="edge")
    dx = ((p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])) / 8
    assert np.allclose(array(stencil.horn(grid(spark, z), 1.0), "dzdx", z.shape), dx)
    z[3, 4] = np.nan
    holes = np.isnan(array(stencil.horn(grid(spark, z), 1.0), "dzdx", z.shape))
    assert holes[2:5, 3].all() and holes[2:5, 5].all() and not holes[0].any()


def test_gaps_of_a_plane_are_filled(spark):
    z = 100 + 0.5 * np.arange(8.0)[:, None] + 0.25 * np.arange(8.0)[None, :]
    holed = z.copy()
    holed[2, 3] = holed[5, 5] = np.nan
    assert np.allclose(array(raster.fill_linear(grid(spark, holed)), "filled", z.shape), z)
    near = array(raster.fill_nearest(grid(spark, holed)), "filled", z.shape)
    assert near[2, 3] == z[1, 3] and near[5, 5] == z[4, 5]
    alone = np.full((6, 30), np.nan)
    alone[5, 29] = 7.0
    assert (array(raster.fill_nearest(grid(spark, alone)), "filled", alone.shape) == 7.0).all()
    assert raster.fill_nearest(grid(spark, np.full((2, 2), np.nan))).where("filled is not null").count() == 0


def test_resampling(spark):
    z = np.random.default_rng(2).normal(size=(8, 8))
    assert np.allclose(array(raster.resample(grid(spark, z), 2), "z", (4, 4)), z.reshape(4, 2, 4, 2).mean((1, 3)))
    assert np.allclose(array(raster.resample(grid(spark, z), 2, "bilinear"), "z", (4, 4)), z.reshape(4, 2, 4, 2).mean((1, 3)))


def flood(mask, diagonal):
    label, n = np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for at in zip(*np.nonzero(mask)):
        if not label[at]:
            n += 1
            stack = [at]
            label[at] = n
            while stack:
                r, c = stack.pop()
                for a, b in near:
                    o = (r + a, c + b)
                    if 0 <= o[0] < mask.shape[0] and 0 <= o[1] < mask.shape[1] and mask[o] and not label[o]:
                        label[o] = n
                        stack.append(o)
    return label


@pytest.mark.parametrize("diagonal", [True, False])
def test_zones_equal_a_flood_fill(spark, diagonal):
    mask = np.random.default_rng(3).random((17, 23)) < 0.45
    cells = grid(spark, mask.astype(float)).withColumn("buildable", F.col("z") > 0)
    found = array(zones.components(cells, "buildable", diagonal), "zone_id", mask.shape)
    assert np.array_equal(np.nan_to_num(found).astype(int), flood(mask, diagonal))


def test_spiral_is_one_zone(spark):
    mask = np.zeros((15, 15), bool)
    r = c = 0
    mask[0, 0] = True
    for k, (a, b) in enumerate([(0, 1), (1, 0), (0, -1), (-1, 0)] * 3):
        for _ in range(14 - 2 * ((k + 1) // 2) + (2 if k else 0) - (2 if k > 1 else 0)):
            if 0 <= r + a < 15 and 0 <= c + b < 15:
                r, c = r + a, c + b
                mask[r, c] = True
    cells = grid(spark, mask.astype(float)).withColumn("buildable", F.col("z") > 0)
    found = np.nan_to_num(array(zones.components(cells, "buildable", False), "zone_id", mask.shape)).astype(int)
    assert np.array_equal(found, flood(mask, False))


def test_fragmented_patches(spark):
    percent = np.full((100, 100), 30.0)
    for r in range(2, 98, 12):
        for c in range(2, 98, 12):
            percent[r : r + 8, c : c + 8] = 3.0
    cells = grid(spark, percent).withColumns({"slope_percent": F.col("z"), "buildable": F.col("z") <= 25})
    found = zones.measures(zones.components(cells), 10.0, 100.0).collect()
    assert len(found) == 64 and {r.area for r in found} == {6400.0} and math.isclose(found[0].compactness, math.pi / 4)


def test_cut_volume(spark):
    before = np.full((60, 60), 100.0)
    after = before.copy()
    after[45:55, 45:55] = 90.0
    sites = spark.createDataFrame([(0, "mixed")], "dem_id long, soil string")
    v = earthwork.volumes(earthwork.depths(grid(spark, before), grid(spark, after)), sites, 1.0).first()
    assert math.isclose(v.cut_cy, 398.67, rel_tol=0.05) and v.fill_cy == 0 and v.import_cy == 0
    back = earthwork.volumes(earthwork.depths(grid(spark, after), grid(spark, before)), sites, 1.0).first()
    assert math.isclose(back.fill_cy, v.cut_cy)


@pytest.mark.parametrize(("lon", "lat", "zone"), [(-0.1278, 51.5074, 30), (-74.006, 40.7128, 18), (151.2093, -33.8688, 56), (0.0, 0.0, 31), (6.0, 60.0, 32), (5.0, 78.0, 31), (15.0, 78.0, 33), (180.0, 10.0, 1), (200.0, 0.0, None), (0.0, 100.0, None)])
def test_utm_zones(spark, lon, lat, zone):
    assert spark.range(1).select(crs.utm_zone(F.lit(lon), F.lit(lat))).first()[0] == zone


def test_utm_of_paris(spark):
    e, n = crs.to_utm(F.lit(2.3522), F.lit(48.8566), F.lit(31), F.lit(True))
    r = spark.range(1).select(e, n).first()
    assert 440_000 < r[0] < 460_000 and 5_400_000 < r[1] < 5_420_000


def test_clip_of_turned_squares(spark):
    a = G.footprint(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(0.0))
    b = G.footprint(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(45.0))
    far = G.footprint(F.lit(9.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(30.0))
    r = spark.range(1).select(G.clip_area(a, b), G.clip_area(a, far), G.ring_distance(a, far)).first()
    assert math.isclose(r[0], 8 * (math.sqrt(2) - 1)) and r[1] == 0 and r[2] > 6


def test_feature_parsing(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(P.flood_zone(F.lit(" floodway "))) == "AE" and one(P.flood_zone(F.lit("x levee"))) == "X_PROTECTED" and one(P.flood_zone(F.lit(None).cast("string"))) == "UNKNOWN"
    assert one(P.number(F.lit("+ 15.5"))) == 15.5 and one(P.number(F.lit("N/A"))) is None
    assert one(P.redacted(F.lit("password: abc, mail a.b@c.org ssn 123-45-6789"))) == f"{P.HIDDEN}, mail {P.HIDDEN} ssn {P.HIDDEN}"
    assert one(P.elevation_in(F.lit("1200m line"))) == 1200.0 and one(P.elevation_in(F.lit("ridge"))) is None


def random_graph(seed, n=40, m=90):
    rng = random.Random(seed)
    return [(s, *sorted(rng.sample(range(n), 2)), float(rng.randrange(1, 20))) for s in (0, 1) for _ in range(m)]


EDGES = "site_id long, src long, dst long, weight double"


def test_least_costs_equal_dijkstra(spark):
    rows = random_graph(1)
    got = {(r.site_id, r.node): r.dist for r in graph.least_costs(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(0, 3), (1, 5)], "site_id long, source long")).collect()}
    want = {}
    for site, source in ((0, 3), (1, 5)):
        heap, seen = [(0.0, source)], {}
        while heap:
            d, u = heapq.heappop(heap)
            if u in seen:
                continue
            seen[u] = d
            for s, a, b, w in rows:
                if s == site and u in (a, b):
                    heapq.heappush(heap, (d + w, b if u == a else a))
        want |= {(site, k): v for k, v in seen.items()}
    assert got == want


def test_paths_add_up(spark):
    rows = random_graph(2)
    reach = graph.least_costs(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(0, 3)], "site_id long, source long"))
    far = reach.orderBy(F.desc("dist"), "node").first()
    walked = graph.path_nodes(reach, spark.createDataFrame([(0, 3, far.node)], "site_id long, source long, goal long")).orderBy("back").collect()
    nodes = [r.node for r in walked]
    least = {}
    for s, a, b, w in rows:
        if s == 0:
            least[a, b] = least[b, a] = min(w, least.get((a, b), w))
    assert nodes[0] == far.node and nodes[-1] == 3 and math.isclose(sum(least[p] for p in zip(nodes, nodes[1:])), far.dist)


def test_spanning_forest_has_least_weight(spark):
    rows = random_graph(3)
    got = graph.spanning_forest(spark.createDataFrame(rows, EDGES)).collect()
    for site in (0, 1):
        root = list(range(40))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        total = count = 0
        for w, a, b in sorted((w, a, b) for s, a, b, w in rows if s == site):
            if find(a) != find(b):
                root[find(a)] = find(b)
                total, count = total + w, count + 1
        own = [r for r in got if r.site_id == site]
        assert len(own) == count and math.isclose(sum(r.weight for r in own), total)


def test_chain_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 50 != 49], "a long, b long")
    got = {r.node: r.root for r in graph.stars(links, "a", "b").collect()}
    assert got == {k: k // 50 * 50 for k in range(200)}
    assert graph.stars(links.limit(0), "a", "b").count() == 0


def test_path_simplification(spark):
    line = [("p", i, float(i), 0.0 if i < 5 else float(i - 5), 0.0) for i in range(11)]
    got = paths.simplified(spark.createDataFrame(line, "path_id string, seq int, x double, y double, z double"), 0.1, 15.0)
    assert sorted(r.seq for r in got.collect()) == [0, 5, 10]


def brute_simplified(points, tolerance, grade):
    kept, at = [0], 0
    while at < len(points) - 1:
        to = at + 1
        for j in range(len(points) - 1, at + 1, -1):
            (x0, y0, z0), (x1, y1, z1) = points[at], points[j]
            size = math.hypot(x1 - x0, y1 - y0)
            if size < 1e-9 or abs(z1 - z0) / size * 100 > grade:
                continue
            if all(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) / size <= tolerance for x, y, _ in points[at + 1 : j]):
                to = j
                break
        kept.append(to)
        at = to
    return kept


def test_simplification_equals_brute_force(spark):
    rng, rows, want = random.Random(9), [], {}
    for path in range(40):
        x = y = z = turn = 0.0
        points = []
        for _ in range(rng.randrange(2, 60)):
            points.append((x, y, z))
            turn += rng.gauss(0, rng.choice([0.02, 0.3]))
            x, y, z = x + 10 * math.cos(turn), y + 10 * math.sin(turn), z + rng.uniform(-1, 1)
        rows += [(str(path), i, *p) for i, p in enumerate(points)]
        want[str(path)] = brute_simplified(points, 2.0, 10.0)
    got = {}
    for r in paths.simplified(spark.createDataFrame(rows, "path_id string, seq int, x double, y double, z double"), 2.0, 10.0).collect():
        got.setdefault(r.path_id, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_grid_source_opens_only_the_stretches_of_a_window(spark, tmp_path):
    """Two grids with lines of any length, blank lines, words that are no numbers and no end of line at the end; with an index and without."""
    rng, want = random.Random(2), {}
    for name, height in (("a", 50), ("b", 3)):
        text = f"ncols 4\nNROWS {height}\n\nxllcorner 0\ncellsize 10\nNODATA_value -1\n"
        for row in range(height):
            cells = [rng.choice(["-1", "x", "7", f"{rng.random() * 10 ** rng.randrange(6):.3f}"]) for _ in range(4)]
            want |= {(name, row, col): None if c in ("-1", "x") else float(c) for col, c in enumerate(cells)}
            text += " ".join(cells) + rng.choice(["\n", " \n", "\n\n", "\r\n"])
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.asc").write_bytes(text.rstrip().encode())
    path = f"file://{tmp_path}/in"
    for stretch in (None, 1, 7, 100, 1 << 20):
        index = stretch and asciigrid.line_index(spark, path, f"file://{tmp_path}/lines{stretch}", stretch)
        cells = asciigrid.load(spark, path, index)
        assert {(r.dem_id, r.row, r.col): r.z for r in cells.collect()} == want
        window = cells.where("row >= 10 and row < 13 and col > 1 and z is not null")
        assert {(r.dem_id, r.row, r.col): r.z for r in window.collect()} == {k: z for k, z in want.items() if 10 <= k[1] < 13 and k[2] > 1 and z is not None}
    reader = asciigrid.GridReader({"path": path, "index": f"file://{tmp_path}/lines7", "row0": "10", "rows": "3"})
    opened, every = reader.partitions(), asciigrid.GridReader({"path": path, "index": f"file://{tmp_path}/lines7"}).partitions()
    assert 3 >= len(opened) and len(every) > 40 and all(10 <= p.row <= 12 for p in opened)


def test_long_paths_are_simplified_by_blocks(spark):
    """Paths of up to 400 points in blocks of 8: turns, straight ways over many blocks, and steps of less than a tolerance."""
    rng, rows, want = random.Random(21), [], {}
    for path in range(12):
        x = y = z = turn = 0.0
        points = []
        for _ in range(rng.choice([7, 8, 9, 60, 400])):
            points.append((x, y, z))
            turn += rng.gauss(0, (0.0, 0.03, 0.4, 1.5)[path % 4])
            step = rng.choice([10.0, 1.5, 0.3])
            x, y, z = x + step * math.cos(turn), y + step * math.sin(turn), z + rng.uniform(-0.05, 0.05)
        rows += [(path or None, i, *p, f"n{i}") for i, p in enumerate(points)]
        want[path or None] = brute_simplified(points, 2.0, 10.0)
    df = spark.createDataFrame(rows, "path_id long, seq int, x double, y double, z double, block string")
    for block in (8, 1024):
        got = {}
        for r in paths.simplified(df, 2.0, 10.0, block).collect():
            assert r.block == f"n{r.seq}"
            got.setdefault(r.path_id, []).append(r.seq)
        assert {k: sorted(v) for k, v in got.items()} == want
    assert paths.simplified(df.limit(0), 2.0, 10.0).count() == 0


def test_long_paths_and_chains_settle(spark):
    """Loops run until no node improves: a path of 40 edges, in rounds of one."""
    rows = [(0, k, k + 1, 1.0) for k in range(40)]
    reach = graph.least_costs(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(0, 0)], "site_id long, source long"), 1)
    assert reach.agg(F.max("dist")).first()[0] == 40.0 and reach.count() == 41
    assert graph.path_nodes(reach, spark.createDataFrame([(0, 0, 40)], "site_id long, source long, goal long")).count() == 41


def test_nearest_fill_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(14, 11)).round(3)
    z[rng.random(z.shape) < 0.8] = np.nan
    z[4:9] = np.nan
    z[:, 5] = np.nan
    known = [(r, c) for r, c in zip(*np.nonzero(~np.isnan(z)))]
    want = [[z[min(known, key=lambda k: ((k[0] - r) ** 2 + (k[1] - c) ** 2, k))] for c in range(11)] for r in range(14)]
    assert np.allclose(array(raster.fill_nearest(grid(spark, z)), "filled", z.shape), want)


def test_smoothing_of_small_and_large_grids(spark):
    """Lags and leads inside, mirrored values at the edges, also where a row is shorter than the reach."""
    weights = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    weights /= weights.sum()
    rng = np.random.default_rng(4)
    for shape in ((3, 2), (12, 20)):
        z = rng.normal(size=shape)
        want = z
        for axis in (1, 0):
            padded = np.pad(want, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            want = sum(w * np.take(padded, range(k, k + shape[axis]), axis=axis) for k, w in enumerate(weights))
        assert np.allclose(array(stencil.gaussian(grid(spark, z)), "smooth", shape), want)


def test_switchbacks(spark):
    zig = [(0, "p", i, float(i % 2) * 10, i * 0.5, 0.0) for i in range(6)]
    got = roads.path_measures(spark.createDataFrame(zig, "site_id long, path_id string, seq int, x double, y double, z double")).first()
    assert got.switchbacks == 4 and got.n_points == 6


def adjacency(rows):
    """site and node: the other ends, weights and lengths of its edges."""
    out = {}
    for r in rows:
        for a, b in ((r[1], r[2]), (r[2], r[1])):
            out.setdefault((r[0], a), []).append((b, r[3], r[4]))
    return out


def dijkstra(links, site, sources, by=0):
    """Per node the least sum of weights (by 0) or lengths (by 1) from the nearest source."""
    heap, seen = [(0.0, u) for u in sources], {}
    while heap:
        d, u = heapq.heappop(heap)
        if u not in seen:
            seen[u] = d
            for v, *w in links.get((site, u), ()):
                heapq.heappush(heap, (d + w[by], v))
    return seen


def kruskal(pairs):
    """The chosen pairs of (weight, a, b)."""
    root, chosen = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted(pairs):
        if find(a) != find(b):
            root[find(a)] = find(b)
            chosen.append((w, a, b))
    return chosen


def grid_graph(size, seed, least=0):
    """site, src, dst, weight, length: a grid of nodes (row * 100000 + column), with weights and lengths that disagree."""
    rng, rows = random.Random(seed), []
    for r in range(size):
        for c in range(size):
            for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
                if r + dr < size and 0 <= c + dc < size:
                    rows.append((0, r * 100_000 + c, (r + dr) * 100_000 + c + dc, float(rng.randrange(least, 6)), float(rng.randrange(1, 9))))
    return rows


MEASURED = "site_id long, src long, dst long, weight double, length double"


@pytest.mark.parametrize(("block", "width"), [(4, None), (4, 5.0), (64, None)])
def test_least_costs_over_many_blocks(spark, block, width):
    """Equal to Dijkstra whatever the blocks and buckets, edges of no weight included; paths lead back along least ways."""
    rows, cut = grid_graph(11, 7), lambda node: block_search.grid_block(node, block)
    edges = spark.createDataFrame(rows, MEASURED)
    reach = graph.least_costs(edges, spark.createDataFrame([(0, 0), (0, 500_003)], "site_id long, source long"), width, cut)
    links, got = adjacency(rows), reach.collect()
    for source in (0, 500_003):
        assert {r.node: r.dist for r in got if r.source == source} == dijkstra(links, 0, [source])
    goals = [(0, 0, 1_000_010), (0, 0, 10), (0, 500_003, 1_000_000), (0, 500_003, 500_003)]
    walked = {}
    for r in graph.path_nodes(reach, spark.createDataFrame(goals, "site_id long, source long, goal long"), cut).collect():
        walked.setdefault((r.source, r.goal), []).append((r.back, r.node))
    dist = {(r.source, r.node): r.dist for r in got}
    for _, source, goal in goals:
        nodes = [n for _, n in sorted(walked[source, goal])]
        assert nodes[0] == goal and nodes[-1] == source
        assert sum(min(w for v, w, _ in links[0, a] if v == b) for a, b in zip(nodes, nodes[1:])) == dist[source, goal]


def test_least_costs_of_lone_and_missing_sources(spark):
    edges = spark.createDataFrame([(0, 1, 2, 3.0), (1, 1, 2, 4.0)], EDGES)
    got = graph.least_costs(edges, spark.createDataFrame([(0, 99), (0, 1), (7, 1)], "site_id long, source long")).collect()
    assert sorted((r.site_id, r.source, r.node, r.dist, r.prev) for r in got if r.source == 99 or r.site_id == 7) == [(0, 99, 99, 0.0, None), (7, 1, 1, 0.0, None)]
    assert len(got) == 4
    assert graph.least_costs(edges, spark.createDataFrame([], "site_id long, source long")).collect() == []
    assert graph.least_costs(edges.limit(0), spark.createDataFrame([(0, 5)], "site_id long, source long")).count() == 1


def test_entries_grow_with_the_frontier(spark):
    """What a round passes on are nodes at the borders of blocks, 60 of 256 in each, and a block is settled a few times."""
    from plotwright.operators import block_search as b

    rows, sizes = grid_graph(64, 8, 1), []
    kept, b.written = b.written, lambda df, name, **k: (lambda out: (sizes.append((name, out.count())), out)[1])(kept(df, name, **k))
    try:
        found = b.searched(spark.createDataFrame(rows, MEASURED), spark.createDataFrame([(0, 0, 0)], "site_id long, search long, node long"), lambda n: b.grid_block(n, 16))
    finally:
        b.written = kept
    assert found.agg(F.sum(F.size("ways"))).first()[0] == 64 * 64
    assert max(n for name, n in sizes if name == "entries") <= 16 * 60 // 2 and sum(n for name, n in sizes if name == "settled") <= 8 * 16


def test_tree_of_two_hundred_terminals(spark):
    """As short as Kruskal's tree over the shortest ways between all pairs, without a table of these."""
    rows, rng = grid_graph(30, 9), random.Random(10)
    nodes = sorted({r[1] for r in rows} | {r[2] for r in rows})
    ends, links = rng.sample(nodes, 200), adjacency(rows)
    net = roads.terminal_network(spark.createDataFrame(rows, MEASURED), spark.createDataFrame([(0, e) for e in ends], "site_id long, node long"), block=lambda n: block_search.grid_block(n, 8))
    tree = net.tree.collect()
    far = {e: dijkstra(links, 0, [e], 1) for e in ends}
    assert len(tree) == 199 and sum(r.length for r in tree) == sum(w for w, _, _ in kruskal([(far[a][b], a, b) for a in ends for b in ends if a < b]))
    paths = {}
    for r in net.paths().collect():
        paths.setdefault((r.src, r.dst), []).append((r.seq, r.node))
    for r in tree:
        way = [n for _, n in sorted(paths[r.src, r.dst])]
        assert way[0] == r.src and way[-1] == r.dst and sum(min(x for v, _, x in links[0, a] if v == b) for a, b in zip(way, way[1:])) == r.length


def test_tree_follows_length_where_cost_disagrees(spark):
    """The cheap way from 1 to 3 is long: the tree takes the short edges. A second site falls apart, a third has one terminal."""
    rows = [(0, 1, 2, 9.0, 1.0), (0, 2, 3, 9.0, 1.0), (0, 1, 3, 1.0, 5.0), (1, 1, 2, 1.0, 1.0), (1, 8, 9, 1.0, 1.0)]
    ends = [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 9), (2, 4)]
    net = roads.terminal_network(spark.createDataFrame(rows, MEASURED), spark.createDataFrame(ends, "site_id long, node long"))
    assert sorted((r.site_id, r.src, r.dst, r.length) for r in net.tree.collect()) == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (1, 1, 2, 1.0)]
    assert sorted((r.site_id, r.n_terminals, r.n_links, r.connected) for r in net.status().collect()) == [(0, 3, 2, True), (1, 3, 1, False), (2, 1, 0, True)]
    start = spark.createDataFrame([(0, 3), (1, 2)], "site_id long, node long")
    assert sorted(tuple(r) for r in net.reached(start).collect()) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]


def test_site_network_against_kruskal(spark):
    """Roads of a steep and a flat site: cheapest ways, of them the tree of least length; straight roads where no way leads."""
    rng, nodes = random.Random(6), []
    for site in (0, 1):
        for r in range(4):
            for c in range(5):
                nodes.append((site, r * 100_000 + c, r, c, c * 25.0, r * 25.0, rng.choice([0.0, 1.0]) if site == 0 else (0.0 if c < 3 else 50.0), rng.choice([2.0, 10.0, 20.0])))
    node_df = spark.createDataFrame(nodes, "site_id long, id long, row int, col int, x double, y double, z double, slope double")
    assets = [(0, 1, 100.0, 75.0), (0, 2, 51.0, 1.0), (0, 3, 900.0, 900.0), (1, 4, 49.0, 74.0), (1, 5, 100.0, 0.0)]
    asset_df = spark.createDataFrame(assets, "site_id long, id long, x double, y double")
    gates = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0)], "site_id long, x double, y double")
    got = roads.site_network(node_df, gates, asset_df, 25.0, 12.0).collect()
    assert sorted((r.site_id, r.dst) for r in got if r.kind == "straight") == [(0, 3), (1, 5)]
    rows = [(r.site_id, r.src, r.dst, r.weight, r.length) for r in roads.edges(node_df, 12.0).collect()]
    links = adjacency(rows)
    for site, ends in ((0, [0, 2, 300_004]), (1, [0, 300_002])):
        near = {}
        for n in {r[1] for r in rows if r[0] == site} | {r[2] for r in rows if r[0] == site}:
            near[n] = min((dijkstra(links, site, [e]).get(n, math.inf), e) for e in ends)[1]
        far = {(e, by): dijkstra(links, site, [e], by) for e in ends for by in (0, 1)}
        built = [r for r in got if r.site_id == site and r.kind == "path"]
        assert len(built) == len(ends) - 1
        for r in built:  # no road is shorter than the shortest way, and each joins two regions that touch
            assert r.length >= far[r.src, 1][r.dst] - 1e-9 and math.isclose(r.length_ft, r.length * 3.28084)
            assert any({near[a], near[b]} == {r.src, r.dst} for s, a, b, _, _ in rows if s == site)
    assert {r["class"] for r in got if r.kind == "path" and 0 in (r.src, r.dst)} == {"primary"}
    assert all(r.length > 0 and (r.max_grade is None or r.max_grade <= 12.0) for r in got)


@pytest.mark.parametrize(("n", "other"), [(5, "access"), (6, "secondary"), (8, "secondary")])
def test_road_classes_go_by_the_assets_of_the_site(spark, n, other):
    nodes = [(0, c, 0, c, c * 25.0, 0.0, 0.0, 2.0) for c in range(12)]
    node_df = spark.createDataFrame(nodes, "site_id long, id long, row int, col int, x double, y double, z double, slope double")
    asset_df = spark.createDataFrame([(0, k, 25.0 * (k + 1), 0.0) for k in range(n)], "site_id long, id long, x double, y double")
    got = roads.site_network(node_df, spark.createDataFrame([(0, 0.0, 0.0)], "site_id long, x double, y double"), asset_df, 25.0, 12.0).collect()
    assert sorted(r["class"] for r in got) == sorted(["primary", *[other] * (n - 1)])


def test_costs_and_results_by_the_surveyed_rates(spark):
    """Two assets, one on terrain; three road segments; the share of area in metres, and in the surveyed system's feet."""
    own = spark.createDataFrame([(0, 0, 1, 20.0, 10.0), (0, 0, 2, 10.0, 10.0), (0, 1, 1, 20.0, 10.0)], "site_id long, solution_id int, id long, width double, length double")
    earth = spark.createDataFrame([(0, 0, 1, 40.0, 10.0)], "site_id long, solution_id int, id long, cut double, fill double")
    segments = spark.createDataFrame([(0, 0, 30.0), (0, 0, 20.0), (0, 0, 10.0)], "site_id long, solution_id int, length double")
    sites = spark.createDataFrame([(0, 40_000.0)], "site_id long, area double")
    one = {r.solution_id: r for r in layout.project_costs(own, earth, segments, sites).collect()}
    cut, fill = 40.0 + 50.0 * 1.30795, 10.0 + 30.0 * 1.30795
    assert math.isclose(one[0].cut, cut) and math.isclose(one[0].fill, fill) and math.isclose(one[0].earthwork, 15 * cut + 12 * fill)
    assert (one[0].roads, one[0].assets, one[0].road_length) == (15_000.0, 150_000.0, 60.0) and math.isclose(one[0].area_used, 0.75)
    assert math.isclose(one[0].total, one[0].earthwork + 165_000.0) and (one[1].roads, one[1].road_length) == (0.0, 0.0)
    assert math.isclose(layout.project_costs(own, earth, segments, sites, area_in_feet=True).where("solution_id = 0").first().area_used, 0.75 / 0.092903)
    scored = spark.createDataFrame([(0, 0, 72.5), (0, 1, -10_000.0)], "site_id long, solution_id int, fitness double")
    got = {r.solution_id: r for r in layout.results(layout.project_costs(own, earth, segments, sites), scored).collect()}
    assert got[0].road_cost == 6000.0 and math.isclose(got[0].contingency, got[0].total * 0.1) and math.isclose(got[0].balance_ratio, cut / fill) and math.isclose(got[0].score, 72.5)
    assert math.isclose(got[0].asset_cost, got[0].total / 1.1 - got[0].earthwork - 6000.0)


def test_grid_files_in_many_stretches(spark, tmp_path):
    """A file that several tasks read keeps its rows in order; keys in any case, blank lines, a centre, gaps and a wrong header."""
    from plotwright.sources import grids

    rows = [" ".join(str(r * 100 + c) if (r + c) % 7 else "-1" for c in range(40)) for r in range(60)]
    for dem_id, head in ((1, "NCOLS 40\nnrows 60\nxllcenter 5\nyllcorner 7\ncellsize 10\nNODATA_value -1\n"), (2, "ncols 41\nnrows 60\ncellsize 10\n")):
        (tmp_path / f"dem_id={dem_id}").mkdir()
        (tmp_path / f"dem_id={dem_id}" / "a.asc").write_text(head + "\n" + "\n".join(rows[:30]) + "\n\n" + "\r\n".join(rows[30:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        cells, meta = grids.scan(spark, str(tmp_path))
        got = {(r.dem_id, r.row, r.col): r.z for r in cells.collect()}
        heads = {r.dem_id: r for r in meta.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2 * 60 * 40
    for r in range(60):
        for c in range(40):
            gap = (r + c) % 7 == 0
            assert got[1, r, c] == (None if gap else r * 100 + c) and got[2, r, c] == (-1 if gap else r * 100 + c)
    assert (heads[1].min_x, heads[1].min_y, heads[1].issues) == (0.0, 7.0, []) and heads[2].issues == ["shape differs from header"]


def traced(cells):
    """The rings of a set of cells by walking along their sides, the cells to the left; at a corner where two cells touch the walk stays with its cell."""
    sides = {}
    for r, c in cells:
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if (r + dr, c + dc) not in cells:
                sides.setdefault(a, []).append((b, (r, c)))
    out = []
    while sides:
        at = start = min(sides)
        ring, cell = [], None
        while True:
            options = sides[at]
            pick = next((o for o in options if o[1] == cell), options[0])
            options.remove(pick)
            if not options:
                del sides[at]
            ring.append(at)
            at, cell = pick
            if at == start and not any(o[1] == cell for o in sides.get(at, [])):
                break
        corners = [p for k, p in enumerate(ring) if (ring[k - 1][0] - p[0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (ring[k - 1][1] - p[1]) * (ring[(k + 1) % len(ring)][0] - p[0])]
        least = corners.index(min(corners))
        out.append(tuple(corners[least:] + corners[:least]))
    return sorted(out)


def largest_piece(cells):
    """The largest piece joined by sides, of equal ones the first in raster order."""
    left, best = set(cells), []
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        piece = []
        while todo:
            r, c = todo.pop()
            piece.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
        if len(piece) > len(best):
            best = piece
    return set(best)


@pytest.mark.parametrize("given", [True, False])
def test_rings_against_a_tracer(spark, given):
    """Random masks (holes, cells that touch by corners, pieces joined by corners only), a frame, one cell, gaps in the raster."""
    rng, rows = random.Random(11), []
    for dem_id, share in enumerate((0.35, 0.5, 0.7, 0.85)):
        rows += [(dem_id, r, c, 1.0, rng.random() < share) for r in range(12) for c in range(13) if rng.random() < 0.97]
    rows += [(8, r, c, 1.0, r in (0, 4) or c in (0, 4)) for r in range(5) for c in range(5)] + [(9, 3, 3, 1.0, True)]
    zoned = zones.components(spark.createDataFrame(rows, CELLS + ", buildable boolean"), parts=given)
    by_zone = {}
    for r in zoned.where("zone_id is not null").collect():
        by_zone.setdefault((r.dem_id, r.zone_id), set()).add((r.row, r.col))
    got, areas = {}, {}
    for r in zones.rings(zoned, 1.0).collect():
        got.setdefault((r.dem_id, r.zone_id), {}).setdefault(r.ring, []).append((r.seq, (int(r.x), int(r.y))))
        areas.setdefault((r.dem_id, r.zone_id), {})[r.ring] = r.area
    assert set(got) == set(by_zone)
    for key, cells in by_zone.items():
        part = largest_piece(cells)
        found = []
        for ring in got[key].values():
            corners = [p for _, p in sorted(ring)]
            assert [k for k, _ in sorted(ring)] == list(range(len(ring)))
            least = corners.index(min(corners))
            found.append(tuple(corners[least:] + corners[:least]))
        assert sorted(found) == traced(part)
        assert math.isclose(sum(areas[key].values()), len(part)) and sum(a > 0 for a in areas[key].values()) == 1
    shapes = {(r.dem_id, r.zone_id): r.parts for r in zones.polygons(zones.rings(zoned, 1.0)).collect()}
    frame = shapes[8, 1]
    assert len(frame) == 2 and len(frame[0]) == 5 and frame[0][0] == frame[0][-1] and {(p.x, p.y) for p in frame[1]} == {(1, 1), (1, 4), (4, 1), (4, 4)}


def test_measures_follow_the_largest_part(spark):
    """A zone of a block and a cell that touches it by a corner: all cells count, but the outline is the block's."""
    cells = [(0, r, c, 10.0, 3.0, (r < 3 and c < 4) or (r, c) == (3, 4)) for r in range(5) for c in range(6)]
    zoned = zones.components(spark.createDataFrame(cells, CELLS + ", slope_percent double, buildable boolean"), parts=True)
    found = zones.measures(zoned, 10.0).collect()
    assert [(r.n_cells, r.area, r.perimeter, r.x, r.y) for r in found] == [(13, 1300.0, 140.0, 20.0, 15.0)]
    assert math.isclose(found[0].compactness, 4 * math.pi * 1200 / 140**2)


def test_zones_over_many_blocks(spark, monkeypatch):
    """Blocks of a few rows and columns give the zones that one block gives."""
    rng = random.Random(12)
    cells = spark.createDataFrame([(d, r, c, 1.0, rng.random() < 0.55) for d in (0, 1) for r in range(20) for c in range(17)], CELLS + ", buildable boolean")
    key = lambda frame: sorted((r.dem_id, r.row, r.col, r.zone_id, r.part) for r in frame.where("buildable").collect())
    whole = key(zones.components(cells, parts=True))
    monkeypatch.setattr(zones, "BLOCK_ROWS", 3)
    monkeypatch.setattr(zones, "BLOCK_COLUMNS", 5)
    assert key(zones.components(cells, parts=True)) == whole


def in_rings(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax:
                odd = not odd
    return odd


def test_scan_lines_against_point_in_ring(spark):
    """Stars, shapes with holes, rings that cross themselves, corners and sides on the middles of cells, shapes beyond the raster, equal shapes."""
    rng = random.Random(13)
    star = lambda cx, cy, n: [(cx + rng.uniform(1, 30) * math.cos(k * 2 * math.pi / n), cy + rng.uniform(1, 30) * math.sin(k * 2 * math.pi / n)) for k in range(n)]
    shapes = [[star(rng.uniform(-10, 60), rng.uniform(-10, 60), rng.randrange(3, 14))] for _ in range(12)]
    shapes += [[[(0.5, 0.5), (20.5, 0.5), (20.5, 20.5), (0.5, 20.5)], [(5.5, 5.5), (5.5, 9.5), (9.5, 9.5), (9.5, 5.5)]], [[(0, 0), (40, 40), (40, 0), (0, 40)]], [[(3, 3), (9, 3), (6, 3)]], [[(-500, -500), (900, -500), (900, 900), (-500, 900)]]]
    shapes = [[ring + ring[:1] for ring in s] for s in shapes]
    rows = [(0, k, s) for k, s in enumerate(shapes)] + [(0, 3, shapes[3]), (1, 0, shapes[0])]
    frame = spark.createDataFrame([(d, k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s]) for d, k, s in rows], "site_id long, id long, parts array<array<struct<x: double, y: double>>>")
    cells = spark.createDataFrame([(d, r, c, 0.0) for d in (0, 1) for r in range(50) for c in range(55)], CELLS)
    got = sorted((r.dem_id, r.shape_id, r.row, r.col) for r in spatial.zonal(cells, frame, 1.0).collect())
    assert got == sorted((d, k, r, c) for d, k, s in rows for r in range(50) for c in range(55) if in_rings(c + 0.5, r + 0.5, s))
    flagged = {(r.dem_id, r.row, r.col) for r in scanlines.mask(cells, frame, 1.0).where("inside").collect()}
    assert flagged == {(d, r, c) for d, _, r, c in got}


@pytest.mark.parametrize(("bins", "few"), [(2, 1), (3, 4), (64, 20), (4096, 10_000)])
def test_percentiles_by_selection(spark, bins, few):
    """Exact whatever the bins: ties, one value, two values, a group without values, values far apart, shares at both ends."""
    rng = random.Random(bins)
    groups = {"a": [rng.gauss(0, 1) for _ in range(157)], "b": [float(rng.randrange(4)) for _ in range(200)], "c": [7.0], "d": [1.0, 2.0], "e": [10.0**k for k in range(-12, 13)], "f": [5.0] * 90, "g": [None] * 3, "h": [1e-300, 0.0, -1e300, 3.0, None]}
    rows = [(g, k % 2, v) for g, vs in groups.items() for k, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "g string, h int, v double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r[1:] for r in selection.percentiles(frame, ["g"], "v", shares, [f"p{k}" for k in range(5)], bins, few).collect()}
    want = {g: np.percentile([v for v in vs if v is not None], [100 * s for s in shares]) for g, vs in groups.items() if any(v is not None for v in vs)}
    assert set(got) == set(want)
    for g in want:
        assert np.allclose(got[g], want[g], rtol=1e-12, atol=0)
    assert selection.percentiles(frame.limit(0), ["g"], "v", [0.5], ["m"], bins, few).collect() == []
    two = {(r.g, r.h): r.m for r in selection.percentiles(frame, ["g", "h"], "v", [0.5], ["m"], bins, few).collect()}
    assert math.isclose(two["a", 1], np.median(groups["a"][1::2]))


def test_overlap_of_any_rings(spark):
    """L shapes either way round and turned, stars, a ring inside another, rings that touch: against the share of fine cells in both."""
    rng = random.Random(14)
    ell = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]

    def turned(ring, angle, dx, dy):
        c, s = math.cos(angle), math.sin(angle)
        return [(x * c - y * s + dx, x * s + y * c + dy) for x, y in ring]

    star = lambda n: [((1 if k % 2 else 4) * math.cos(k * math.pi / n) + 4, (1 if k % 2 else 4) * math.sin(k * math.pi / n) + 4) for k in range(2 * n)]
    cases = [(ell, ell), (ell, ell[::-1]), (ell, [(2, 2), (6, 2), (6, 6), (2, 6)]), (ell, [(1, 1), (3, 1), (3, 3), (1, 3)]), (star(5), ell), (star(4)[::-1], star(7)), ([(0, 0), (9, 0), (9, 9), (0, 9)], star(5))]
    cases += [(turned(ell, rng.uniform(0, 6), 3, 3), turned(star(rng.randrange(3, 6)), rng.uniform(0, 6), rng.uniform(-2, 4), rng.uniform(-2, 4))) for _ in range(6)]
    as_ring = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring + ring[:1]]
    kind = "array<struct<x: double, y: double>>"
    frame = spark.createDataFrame([(k, as_ring(a), as_ring(b)) for k, (a, b) in enumerate(cases)], f"k int, a {kind}, b {kind}")
    got = {r.k: (r.either, r.other, r.slabs) for r in frame.select("k", G.overlap_area(F.col("a"), F.col("b")).alias("either"), G.overlap_area(F.col("b"), F.col("a")).alias("other"), G.slab_area(F.col("a"), F.col("b")).alias("slabs")).collect()}
    assert math.isclose(got[0][0], 20) and math.isclose(got[1][0], 20) and abs(got[2][0]) < 1e-9 and math.isclose(got[3][0], 3)
    step = 0.02
    for k, (a, b) in enumerate(cases):
        both = [[*r, r[0]] for r in (a, b)]
        xs, ys = ([p[i] for r in both for p in r] for i in (0, 1))
        n = sum(in_rings(min(xs) + (i + 0.5) * step * 5, min(ys) + (j + 0.5) * step * 5, both[:1]) and in_rings(min(xs) + (i + 0.5) * step * 5, min(ys) + (j + 0.5) * step * 5, both[1:]) for i in range(int((max(xs) - min(xs)) / step / 5) + 1) for j in range(int((max(ys) - min(ys)) / step / 5) + 1))
        assert math.isclose(got[k][0], got[k][1], abs_tol=1e-9) and math.isclose(got[k][0], got[k][2], abs_tol=1e-9) and abs(got[k][0] - n * (5 * step) ** 2) < 0.5


def test_pairs_of_boxes_of_all_sizes(spark):
    """Against all pairs; a zone of ten kilometres takes four tiles, and one wide spacing widens its own search only."""
    rng = random.Random(15)
    rows = [(0, k, *(rng.uniform(-500, 500) for _ in "xy"), rng.choice([0.5, 3.0, 40.0, 300.0]), rng.choice([0.0, 1.0, 20.0])) for k in range(150)] + [(0, 150, -5000.0, -5000.0, 10_000.0, 0.0), (0, 151, 3.0, 3.0, 1.0, 1000.0), (1, 0, 0.0, 0.0, 5.0, 9.0)]
    frame = spark.createDataFrame(rows, "site_id long, id long, x double, y double, w double, reach double").select("site_id", "id", "reach", "w", "x", "y", G.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("ring"))
    for within in ("reach", 0.0, 7.5):
        far = lambda p: p[5] if within == "reach" else within
        want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[2] - far(p) <= q[2] + q[4] and q[2] <= p[2] + p[4] + far(p) and p[3] - far(p) <= q[3] + q[4] and q[3] <= p[3] + p[4] + far(p))
        assert sorted((r.site_id, r.a_id, r.b_id) for r in spatial.pairs(frame, frame, within).collect()) == want
    boxed = spatial._boxed(frame, "a_", 50.0, "ring", F.col("reach"))
    tiles = spatial._tiles(boxed, "a_", 50.0, F.array("a_level")).groupBy("site_id", "a_id").count()
    assert tiles.agg(F.max("count")).first()[0] <= 4
    small = spark.createDataFrame([(0, k, float(k % 60) * 50, float(k // 60) * 50, 1.0, 1000.0 if k == 0 else 1.0) for k in range(3000)], "site_id long, id long, x double, y double, w double, spacing double")
    small = small.select("site_id", "id", "spacing", G.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("ring"))
    assert spatial.pairs(small, small, "spacing").count() < 2 * 3000 + 21 * 21 and spatial.crowded(small).count() > 250


def moment(text):
    import datetime

    return datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)


def stream_of(spark, folder, batches, kind):
    import time

    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return streaming.source(spark, str(folder), 1)


def test_observations_are_fresh_again_after_their_time(spark, tmp_path):
    """Repeats inside the time, in the same batch and the next one, are dropped; one beyond it passes; what comes too late is dropped, its key new or not."""
    one = [("a", 1, moment("2024-01-01 00:00")), ("a", 2, moment("2024-01-01 00:30")), ("b", 3, moment("2024-01-01 02:00")), ("a", 4, moment("2024-01-01 01:00"))]
    two = [("a", 5, moment("2024-01-01 02:30")), ("b", 6, moment("2024-01-01 02:59")), ("a", 7, moment("2024-01-01 03:20")), ("c", 8, moment("2024-01-01 00:10"))]
    three = [("b", 9, moment("2024-01-01 03:30")), ("d", 10, moment("2024-01-01 01:00")), (None, 11, moment("2024-01-01 04:00")), (None, 12, moment("2024-01-01 04:30"))]
    stream = stream_of(spark, tmp_path / "in", [one, two, three], "key string, id long, ts timestamp")
    with streaming.keyed_state(spark):
        got = streaming.run(streaming.fresh_again(stream, "1 hour"), "fresh")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5, 9, 11]


def test_state_since_a_key_was_idle(spark, tmp_path):
    at = lambda t: moment(f"2024-01-01 {t}")
    one = [("a", 1, at("00:00"), "new", 5.0), ("a", 2, at("00:40"), "run", 9.0), ("b", 3, at("00:10"), "new", None)]
    two = [("a", 4, at("01:30"), "done", 1.0), ("b", 5, at("03:00"), "run", 2.0)]
    three = [("a", 6, at("04:00"), "new", 3.0), ("a", 7, at("04:00"), "run", None), ("c", 8, at("00:05"), "late", 7.0)]
    stream = stream_of(spark, tmp_path / "in", [one, two, three], "key string, id long, ts timestamp, status string, value double")
    with streaming.keyed_state(spark):
        found = streaming.run(streaming.live_state(stream, "1 hour"), "live", "update").collect()
    last = {}
    for r in sorted(found, key=lambda r: r.batch):
        last[r.key] = (r.status, r.most, r.n)
    assert last == {"a": ("run", 3.0, 2), "b": ("run", 2.0, 1)}
    assert ("done", 9.0, 3) in {(r.status, r.most, r.n) for r in found if r.key == "a"}


def test_nearest_road_among_many_segments(spark):
    """Against every segment: long and short ones, far gates, equal distances, a site without roads, lines of one point."""
    rng, rows = random.Random(16), []
    for site in (0, 1):
        for k in range(400):
            x, y = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)
            line = [(x, y)]
            for _ in range(rng.randrange(0, 6)):
                line.append((line[-1][0] + rng.uniform(-60, 60), line[-1][1] + rng.choice([1, 1, 40]) * rng.uniform(-60, 60)))
            rows.append((site, k, line))
    rows += [(3, 5, [(10.0, 0.0), (10.0, 9.0)]), (3, 2, [(-10.0, 0.0), (-10.0, 9.0)]), (4, 1, [(90_000.0, 0.0), (90_000.0, 5.0)])]
    gates = [(0, 100.0, 50.0), (1, -9000.0, 4000.0), (2, 1.0, 2.0), (3, 0.0, 3.0), (4, 0.0, 0.0)]

    def nearest(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((x - a[0]) * dx + (y - a[1]) * dy) / size)) if size else 0.0
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    frame = spark.createDataFrame([(s, k, [{"x": x, "y": y} for x, y in line]) for s, k, line in rows], "site_id long, seq long, line array<struct<x: double, y: double>>")
    got = {r.site_id: r for r in spatial.nearest_road(spark.createDataFrame(gates, "site_id long, x double, y double"), frame).collect()}
    for site, x, y in gates:
        want = min(((nearest(x, y, a, b), k) for s, k, line in rows if s == site for a, b in zip(line, line[1:] or line)), default=None)
        if want is None:
            assert (got[site].entry_x, got[site].entry_y, got[site].road) == (x, y, None)
        else:
            assert math.isclose(got[site].distance, want[0], rel_tol=1e-9) and got[site].road == want[1]
            assert math.isclose(math.hypot(got[site].entry_x - x, got[site].entry_y - y), want[0], rel_tol=1e-9)


def copies(spark, n=700):
    """n assets of three footprints (type, spacing by footprint), their boxes by id, and one zone."""
    at = {0: (0.0, 0.0), 1: (16.0, 0.0), 2: (27.0, 0.0)}  # ten wide and twenty long, turned: twenty by ten
    rows = [(0, i, i % 3, *at[i % 3], 10.0, 20.0, 90.0, (0.0, 1.0, 5.0)[i % 3]) for i in range(n)]
    frame = layout.placed(spark.createDataFrame(rows, "site_id long, id long, type long, x double, y double, width double, length double, rotation double, spacing double"))
    zone = spark.createDataFrame([(0, 1, "high", 0.0)], "site_id long, id long, severity string, x double").withColumn("ring", G.box(F.col("x"), F.col("x"), F.col("x") + 1.0, F.col("x") + 1.0))
    return rows, frame, zone


def counted_pairs(monkeypatch):
    """The products of the sides that spatial.pairs() is given from now on."""
    given, own = [], spatial.pairs
    monkeypatch.setattr(spatial, "pairs", lambda left, right, *a, **b: given.append(left.count() * right.count()) or own(left, right, *a, **b))
    return given


def near_pairs(rows, most):
    """Pairs a < b and their distances, of assets whose distance is most(a) at most."""
    gap = lambda p, q: max(abs(p[3] - q[3]) - 20.0, 0.0)
    return sorted((p[1], q[1], gap(p, q)) for p in rows for q in rows if p[1] < q[1] and gap(p, q) <= most(p))


def test_equal_footprints_are_measured_once(spark, monkeypatch):
    rows, frame, _ = copies(spark)
    given = counted_pairs(monkeypatch)
    found = spatial.crowded(frame.drop("spacing").withColumn("spacing", F.lit(7.0)))
    assert sorted((r.a_id, r.b_id, r.distance) for r in found.collect()) == near_pairs(rows, lambda _: 7.0)
    assert max(given) <= 9


def test_equal_footprints_overlap_once(spark, monkeypatch):
    rows, frame, _ = copies(spark)
    given = counted_pairs(monkeypatch)
    x = {i: (0.0, 16.0, 27.0)[i % 3] for i in range(len(rows))}
    expected = sorted((i, j, 10.0 * (20.0 - abs(x[i] - x[j]))) for i in x for j in x if i < j and abs(x[i] - x[j]) < 20.0)
    assert sorted((r.a_id, r.b_id, r.area) for r in spatial.overlaps(frame).collect()) == expected
    assert max(given) <= 9


def test_breaches_of_equal_footprints(spark, monkeypatch):
    rows, frame, zone = copies(spark)
    given = counted_pairs(monkeypatch)
    site = spark.createDataFrame([(0, -10.0)], "site_id long, x double").select("site_id", F.array(G.box(F.col("x"), F.col("x"), F.lit(30.0), F.lit(10.0))).alias("parts"))
    found = {r.kind: r.n for r in rules.breaches(frame, site, zone).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n = [sum(i % 3 == k for i in range(len(rows))) for k in range(3)]
    assert found == {"overlap": sum(m * (m - 1) // 2 for m in n) + n[0] * n[1] + n[1] * n[2], "boundary": n[2], "exclusion": n[0]}
    assert max(given) <= len(rows)  # the zone with every asset


def test_moves_count_equal_footprints(spark, monkeypatch):
    """Errors are counted by kind; an asset's own old place is no error, another's is."""
    rows, frame, zone = copies(spark)
    given = counted_pairs(monkeypatch)
    site = spark.createDataFrame([(0, -100.0)], "site_id long, x double").select("site_id", F.array(G.box(F.col("x"), F.col("x"), F.lit(100.0), F.lit(100.0))).alias("parts"))
    moved = layout.placed(frame.drop("ring").where("id < 3").withColumn("x", F.when(F.col("id") == 2, 0.0).otherwise(F.col("x"))))
    n = [sum(i % 3 == k for i in range(len(rows))) for k in range(3)]
    found = {r.id: (r.n_errors, r.is_valid) for r in rules.checked_moves(moved, frame, site, zone).collect()}
    assert found == {0: (n[0] - 1 + n[1] + 1, False), 1: (n[0] + n[1] - 1 + n[2], False), 2: (n[0] + n[1] + 1, False)}
    assert max(given) <= 9


def test_rules_of_equal_footprints(spark, monkeypatch):
    rows, frame, _ = copies(spark)
    given = counted_pairs(monkeypatch)
    found = spatial.rule_spacing(frame, spark.createDataFrame([(0, 2, 8.0), (1, 1, 1.0)], "from_type long, to_type long, metres double"))
    kinds = [(p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and sorted((p[2], q[2])) in ([0, 2], [1, 1])]
    assert sorted((r.a_id, r.b_id) for r in found.collect()) == sorted(kinds)
    assert max(given) <= 9


@pytest.mark.parametrize("spacing", [0.0, 7.0])
def test_spacing_is_kept_to_the_last_digit(spark, spacing):
    """Turned footprints that are apart by their spacing exactly, or touch where none is asked for, count as close."""
    rows = [(0, i, 0, (20.0 + spacing) * (i // 4) + 0.5, 7.0 * (i % 4), 10.0, 20.0, 90.0 * (1 + 2 * (i % 2)), spacing) for i in range(12)]
    frame = layout.placed(spark.createDataFrame(rows, "site_id long, id long, type long, x double, y double, width double, length double, rotation double, spacing double"))
    gap = lambda p, q: math.hypot(max(abs(p[3] - q[3]) - 20.0, 0.0), max(abs(p[4] - q[4]) - 10.0, 0.0))
    expected = sorted((p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and gap(p, q) <= spacing)
    assert sorted((r.a_id, r.b_id) for r in spatial.crowded(frame).collect()) == expected


def test_fill_looks_ahead_in_one_pass(spark):
    """A frame up to the end of a row is gone through anew for every cell: no plan of a fill holds one."""
    z = np.full((1, 40), np.nan)
    z[0, [3, 30]] = 1.0, 28.0
    cells = grid(spark, z)
    for fill, expected in ((raster.fill_nearest, np.where(np.arange(40) < 17, 1.0, 28.0)), (raster.fill_linear, np.clip(np.arange(40) - 2.0, 1.0, 28.0))):
        found = fill(cells)
        assert np.allclose(array(found, "filled", z.shape)[0], expected)
        assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def laid_out(spark):
    """Two layouts of four assets on one site: of the first, two overlap; in the second all are apart."""
    rows = [(0, s, i, 30.0 * i + (15.0 if (s, i) == (0, 0) else 0.0), 20.0, 20.0, 10.0, 0.0, 5.0) for s in range(2) for i in range(4)]
    return layout.placed(spark.createDataFrame(rows, "site_id long, solution_id int, id long, x double, y double, width double, length double, rotation double, spacing double"))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_breaches_of_layouts_are_not_broadcast(spark, monkeypatch):
    """Layouts are more rows than a plan can know of: with a small table of assets the driver would collect them."""
    plans, own = [], layout.written
    monkeypatch.setattr(layout, "written", lambda df, name: plans.append(planned(df)) or own(df, name))
    box = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    site = spark.range(1).select(F.col("id").alias("site_id"), F.array(box(-20, 0, 101, 100)).alias("parts"))
    zone = spark.range(1).select(F.col("id").alias("site_id"), F.lit(7).alias("id"), box(-10, 10, -9, 30).alias("ring"))
    found = layout.violations(laid_out(spark), site, zone, 12_000.0)
    # of the first: an overlap, which lacks spacing too; of the second: one on the zone
    assert {r.solution_id: r.n_violations for r in found.collect()} == {0: 2, 1: 1}
    assert "BroadcastHashJoin" not in "".join([*plans, planned(found)])


def test_terrain_of_layouts_is_not_broadcast(spark):
    z = np.add.outer(np.arange(10.0), np.arange(20.0))
    cells = stencil.terrain(grid(spark, z), 10.0)
    found = layout.terrain_objectives(laid_out(spark), cells, 10.0)
    assert found.count() == 2 and "BroadcastHashJoin" not in planned(found)


def test_grading_zones_are_not_broadcast(spark):
    cells = grid(spark, np.zeros((4, 6)))
    k = F.col("id")
    zones_ = spark.range(3).select(F.lit(0).cast("long").alias("dem_id"), k.alias("seq"), (k % 2).alias("priority"), F.lit("pad").alias("kind"), (k * 1.0).alias("target"), F.lit(2.0).alias("slope"), G.box(k * 10.0, F.lit(0.0), k * 10.0 + 20.0, F.lit(20.0)).alias("ring"))
    found = earthwork.graded(cells, earthwork.covers(cells, zones_, 10.0))
    assert [r.z for r in found.where("row = 0").orderBy("col").collect()] == [0.0, 1.0, 1.0, 2.0, 0.0, 0.0]
    assert "BroadcastHashJoin" not in planned(found)


def test_scores_of_layouts_are_not_broadcast(spark, data, monkeypatch):
    from plotwright.plans import sites

    plans, own = {}, sites.written
    monkeypatch.setattr(sites, "written", lambda df, name: plans.setdefault(name, planned(df)) and own(df, name))
    assert layout.elite(sites.scored(spark, data), 0.2).count()
    assert "BroadcastHashJoin" not in plans["scored"]


def test_alternatives_do_not_broadcast_layouts(spark):
    scored = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "site_id long, solution_id int, fitness double")
    found = layout.alternatives(scored, laid_out(spark), 3)
    assert sorted(map(tuple, found.collect())) == [(0, 0, 1), (0, 1, 0)] and "BroadcastHashJoin" not in planned(found)


def test_results_of_layouts_are_not_broadcast(spark):
    own = laid_out(spark)
    shapes = own.select("site_id", F.struct("site_id", "solution_id", "id").alias("id"), "ring")
    earth = earthwork.pad_volumes(grid(spark, np.add.outer(np.arange(10.0), np.arange(20.0))), shapes, 10.0).select("shape_id.*", "cut", "fill")
    segments = own.select("site_id", "solution_id", F.col("x").alias("length"))
    costs = layout.project_costs(own, earth, segments, spark.createDataFrame([(0, 40000.0)], "site_id long, area double"))
    found = layout.results(costs, own.select("site_id", "solution_id").distinct().withColumn("fitness", F.lit(50.0)))
    assert found.count() == 2 and "BroadcastHashJoin" not in planned(found)


def test_nodes_of_roads_are_not_broadcast(spark):
    sites = spark.createDataFrame([(0, 0.0, 0.0, 60.0, 40.0)], "site_id long, min_x double, min_y double, max_x double, max_y double")
    own = roads.node_rows(roads.grid_nodes(sites, 20.0), stencil.terrain(grid(spark, np.zeros((4, 6))), 10.0), 10.0)
    found = roads.edges(own, 12.0)
    assert found.count() == 11 and "BroadcastHashJoin" not in planned(found)
