"""Zones: connected components of raster masks, their measures and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions import terrain as T
from plotwright.tables import written

from . import graph
from .raster import ACRE
from .stencil import along


#: Columns in a stretch by which runs of adjoining rows meet.
STRETCH = 64
#: A run's number is its row times this and its first column; runs of so many rows and columns are joined in one task.
ROW = 1 << 31
BLOCK_ROWS, BLOCK_COLUMNS = 128, 4096


def components(cells: DataFrame, mask: str = "buildable", diagonal: bool = True, parts: bool = False) -> DataFrame:
    """cells with zone_id, 1, 2, ... in raster order of the zones' first cells, null outside the mask.

    Cells in a row are joined to runs first, runs that touch the next row's are linked, blocks of runs are joined in
    one task each, and the components of what is left between blocks give the zones. Runs and labels pack so well that
    their tables look small enough to broadcast; the joins name the sort-merge join. With parts (and diagonal), part
    numbers the pieces of a zone whose cells are joined by their sides, by their first runs.
    """
    row = Window.partitionBy("dem_id", "row").orderBy("col")
    inside = cells.where(mask).select("dem_id", "row", "col", (F.col("col") - F.row_number().over(row)).alias("run"))
    node = F.col("row").cast("long") * ROW + F.min("col")
    runs = written(inside.groupBy("dem_id", "row", "run").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), node.alias("node")), "runs")
    slack = 1 if diagonal else 0
    # runs meet by stretches of columns; a pair that shares several is kept in the first one
    stretch = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / STRETCH), F.floor(hi / STRETCH)))
    high = runs.select("dem_id", "row", F.col("node").alias("a"), F.col("c0").alias("h0"), F.col("c1").alias("h1"), stretch(F.col("c0") - slack, F.col("c1") + slack).alias("at"))
    low = runs.select("dem_id", (F.col("row") - 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"), stretch(F.col("c0"), F.col("c1")).alias("at"))
    first = F.col("at") == F.floor(F.greatest(F.col("h0") - slack, F.col("d0"), F.lit(0)) / STRETCH)
    met = high.join(low.hint("merge"), ["dem_id", "row", "at"]).where((F.col("h0") <= F.col("d1") + slack) & (F.col("h1") >= F.col("d0") - slack) & first)
    links = met.select(F.col("dem_id").alias("graph"), "a", "b", ((F.col("h0") <= F.col("d1")) & (F.col("h1") >= F.col("d0"))).alias("side"))
    block = lambda n: F.floor(n / (ROW * BLOCK_ROWS)).cast("long") * ROW + F.floor(n % ROW / BLOCK_COLUMNS).cast("long")
    nodes = runs.select(F.col("dem_id").alias("graph"), "node")
    if parts and diagonal:
        links = written(links, "run-links")
        own = written(graph.labelled_by_blocks(nodes, links.where("side"), block).withColumnRenamed("root", "part"), "parts")
        look = lambda c: own.select("graph", F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
        across = links.where("not side").join(look("a").hint("merge"), ["graph", "a"]).join(look("b").hint("merge"), ["graph", "b"]).select("graph", F.col("a_part").alias("a"), F.col("b_part").alias("b")).where("a <> b").distinct()
        whole = graph.labelled_by_blocks(own.select("graph", F.col("part").alias("node")).distinct(), across, block)
        roots = own.join(whole.withColumnRenamed("node", "part").hint("merge"), ["graph", "part"])
    else:
        roots = graph.labelled_by_blocks(nodes, links, block)
    roots = roots.withColumnRenamed("graph", "dem_id")
    ranked = numbered_roots(roots.select("dem_id", "root").distinct())
    more = ["part"] if parts and diagonal else []
    zones = runs.join(roots.hint("merge"), ["dem_id", "node"]).join(ranked.hint("merge"), ["dem_id", "root"]).select("dem_id", "row", "run", "zone_id", *more)
    numbered = inside.join(zones.hint("merge"), ["dem_id", "row", "run"]).select("dem_id", "row", "col", "zone_id", *more)
    return cells.join(numbered.hint("merge"), ["dem_id", "row", "col"], "left")


def numbered_roots(roots: DataFrame) -> DataFrame:
    """roots (dem_id, root) with zone_id, their rank in their raster: ranks within blocks of rows, and the sums of the blocks before."""
    block = roots.withColumn("__b", F.floor(F.col("root") / (ROW * BLOCK_ROWS)))
    inner = block.withColumn("__k", F.row_number().over(Window.partitionBy("dem_id", "__b").orderBy("root")))
    sums = block.groupBy("dem_id", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("dem_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    return inner.join(sums.withColumn("__o", F.coalesce(before, F.lit(0))), ["dem_id", "__b"]).select("dem_id", "root", (F.col("__k") + F.col("__o")).alias("zone_id"))


def exposed_edges(zone: Column) -> Column:
    """How many of a cell's four sides its zone does not go on beyond."""
    sides = [f.over(along(a)) for a in ("col", "row") for f in (F.lag(zone), F.lead(zone))]
    return sum((F.when(s.eqNullSafe(zone), 0).otherwise(1) for s in sides), F.lit(0))


def with_parts(zoned: DataFrame) -> DataFrame:
    """zoned with part, the pieces of a zone whose cells are joined by their sides; as it is if components() has given them."""
    if "part" in zoned.columns:
        return zoned
    split = components(zoned.withColumnRenamed("zone_id", "__zone").withColumn("__in", F.col("__zone").isNotNull()), "__in", diagonal=False)
    return split.drop("__in").withColumnsRenamed({"zone_id": "part", "__zone": "zone_id"})


def largest_parts(zoned: DataFrame) -> DataFrame:
    """Per zone its outline's part: dem_id, zone_id, part (of equal ones the first), n_parts, part_cells, perimeter (in cells), and the middle x and y of its cells."""
    edged = with_parts(zoned).withColumn("__edges", exposed_edges(F.col("part"))).where("zone_id is not null")
    each = edged.groupBy("dem_id", "zone_id", "part").agg(F.count("*").alias("n"), F.sum("__edges").alias("p"), F.avg(F.col("col") + 0.5).alias("x"), F.avg(F.col("row") + 0.5).alias("y"))
    best = F.max_by(F.struct("part", "n", "p", "x", "y"), F.struct("n", -F.col("part")))
    found = each.groupBy("dem_id", "zone_id").agg(best.alias("o"), F.count("*").alias("n_parts"))
    return found.select("dem_id", "zone_id", "o.part", "n_parts", F.col("o.n").alias("part_cells"), F.col("o.p").alias("perimeter"), "o.x", "o.y")


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter == 0, 0.0).otherwise(F.least(4.0 * math.pi * area / (perimeter * perimeter), F.lit(1.0)))


def measures(zoned: DataFrame, cell: float, least_area: float = 1000.0) -> DataFrame:
    """Per zone of at least that area: cells, area, slopes and elevations of all its cells; perimeter, compactness and centroid of its outline, the largest part joined by sides; class, quality."""
    found = zoned.where("zone_id is not null").groupBy("dem_id", "zone_id").agg(F.count("*").alias("n_cells"), F.avg("slope_percent").alias("mean_slope"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"))
    found = found.withColumn("area", F.col("n_cells") * cell * cell).where(F.col("area") >= least_area)
    met = found.join(largest_parts(zoned).drop("part", "n_parts"), ["dem_id", "zone_id"]).withColumns({c: F.col(c) * cell for c in ("perimeter", "x", "y")})
    scored = met.withColumns({"compactness": compactness(F.col("part_cells") * cell * cell, F.col("perimeter")), "class": T.buildability_class(F.col("mean_slope"))}).drop("part_cells")
    return scored.withColumn("quality", T.zone_quality(F.col("area"), F.col("mean_slope"), F.col("compactness"), F.col("class")))


def outlines(zoned: DataFrame, cell: float) -> DataFrame:
    """Per zone its largest part whose cells are joined by their sides (of equal ones the first): cells, area, perimeter, compactness; and how many parts it has."""
    found = largest_parts(zoned).withColumns({"perimeter": F.col("perimeter") * cell, "area": F.col("part_cells") * cell * cell})
    return found.select("dem_id", "zone_id", F.col("part_cells").alias("n_cells"), "perimeter", "n_parts", "area", compactness(F.col("area"), F.col("perimeter")).alias("compactness"))


def outline_edges(zoned: DataFrame) -> DataFrame:
    """The straight stretches of the outlines of the zones' largest parts: dem_id, zone_id, side, x0, y0, x1, y1 in cells, the part to the left of each.

    A stretch ends where the outline turns, so it is followed by one stretch only, but where two cells touch by a
    corner: there the outline stays with its cell (ends and starts at that corner name the cell), and rings touch.
    """
    parts = with_parts(zoned)
    most = largest_parts(parts).select("dem_id", "zone_id", "part")
    along_row, along_col = along("col"), along("row")
    part = F.col("part")
    beside = lambda f, at, by, w: F.when(f(at).over(w) == F.col(at) + by, f(part).over(w))
    near = {"left": beside(F.lag, "col", -1, along_row), "right": beside(F.lead, "col", 1, along_row), "below": beside(F.lag, "row", -1, along_col), "above": beside(F.lead, "row", 1, along_col)}
    open_ = parts.withColumns({c: ~w.eqNullSafe(part) for c, w in near.items()}).where("part is not null").join(most, ["dem_id", "zone_id", "part"], "left_semi")
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    one = lambda side, line, at: F.struct(F.lit(side).alias("side"), line.alias("line"), at.alias("at"))
    sides = F.array(*[F.when(F.col(name), one(k, line, at)) for k, (name, line, at) in enumerate((("below", r, c), ("right", c + 1, r), ("above", r + 1, c), ("left", c, r)))])
    each = open_.select("dem_id", "zone_id", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("dem_id", "zone_id", "s.*")
    line = Window.partitionBy("dem_id", "zone_id", "side", "line").orderBy("at")
    runs = each.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy("dem_id", "zone_id", "side", "line", "run").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    ahead, level = F.col("side") < 2, F.col("side") % 2 == 0
    first, last = F.when(ahead, F.col("a")).otherwise(F.col("b")), F.when(ahead, F.col("b")).otherwise(F.col("a"))
    placed = runs.select("dem_id", "zone_id", "side", F.when(level, first).otherwise(F.col("line")).alias("x0"), F.when(level, F.col("line")).otherwise(first).alias("y0"), F.when(level, last).otherwise(F.col("line")).alias("x1"), F.when(level, F.col("line")).otherwise(last).alias("y1"))
    return placed.withColumn("id", F.xxhash64("side", "x0", "y0"))


def rings(zoned: DataFrame, cell: float) -> DataFrame:
    """dem_id, zone_id, ring, seq, x, y, area, is_hole: the corners of each zone's outline in order, around the outside counterclockwise, around holes clockwise.

    Each stretch points at the next one. By pointer doubling it learns the least stretch of its ring and how many steps
    ahead that lies; these steps are the order. A ring is named by its least stretch and starts there; area is signed.
    """
    edges = written(outline_edges(zoned), "outline")
    key = ["dem_id", "zone_id"]
    start = edges.select(*key, F.col("id").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("side").alias("next_side"))
    turn = F.pmod(F.col("next_side") - F.col("side"), F.lit(4))  # 1 is a turn to the left, which stays with the cell
    follow = edges.join(start, [*key, "x1", "y1"]).groupBy(*key, "id").agg(F.min(F.struct(turn.alias("turn"), "next"))["next"].alias("next"))
    state = written(follow.select(*key, "id", "next", F.col("id").alias("least"), F.lit(0).cast("long").alias("ahead")), "ring")
    width = 1
    while True:
        there = state.select(*key, F.col("id").alias("next"), F.col("next").alias("far"), F.col("least").alias("their_least"), F.col("ahead").alias("their_ahead"))
        better = F.col("their_least") < F.col("least")
        both = state.join(there, [*key, "next"]).select(
            *key, "id", F.col("far").alias("next"), F.when(better, F.col("their_least")).otherwise(F.col("least")).alias("least"),
            F.when(better, F.col("their_ahead") + width).otherwise(F.col("ahead")).alias("ahead"), better.alias("moved"),
        )
        state, width = written(both, "ring"), 2 * width
        if not state.where("moved").limit(1).count():
            break
    met = edges.join(state.select(*key, "id", F.col("least").alias("ring"), "ahead"), [*key, "id"])
    twice = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    size = met.groupBy(*key, "ring").agg(F.count("*").alias("n"), (F.sum(twice) * (cell * cell / 2.0)).alias("area"))
    seq = F.pmod(F.col("n") - F.col("ahead"), F.col("n")).cast("int")
    return met.join(size, [*key, "ring"]).select(*key, "ring", seq.alias("seq"), (F.col("x0") * cell).alias("x"), (F.col("y0") * cell).alias("y"), "area", (F.col("area") < 0).alias("is_hole"))


def polygons(rings: DataFrame) -> DataFrame:
    """dem_id, zone_id, parts: each zone's outline closed, the outer ring first, for the sinks of features."""
    closed = F.array_sort(F.collect_list(F.struct("seq", F.struct("x", "y").alias("p"))))
    each = rings.groupBy("dem_id", "zone_id", "ring").agg(closed.alias("r"), F.first("area").alias("area"))
    each = each.select("dem_id", "zone_id", F.transform(F.concat("r", F.slice("r", 1, 1)), lambda v: v["p"]).alias("r"), "area", "ring")
    return each.groupBy("dem_id", "zone_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("o"), "ring", "r"))), lambda v: v["r"]).alias("parts"))


def site_scores(zoned: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """Per raster: buildable cells, area (small zones too), share, zones, the largest, and the site's quality."""
    whole = zoned.groupBy("dem_id").agg(F.count("*").alias("n_cells"), F.count_if("buildable").alias("n_buildable"), F.avg(F.when(F.col("buildable"), F.col("slope_percent"))).alias("buildable_slope"))
    best = zones.groupBy("dem_id").agg(
        F.count("*").alias("n_zones"), F.max("area").alias("largest_area"), F.max("quality").alias("best"), F.avg("quality").alias("mean_quality"), F.median("quality").alias("median_quality"),
        F.avg("compactness").alias("mean_compactness"), F.min("area").alias("least_area"), F.avg("area").alias("mean_area"),
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in T.BUILDABILITY],
    )
    percent = F.col("n_buildable") * 100.0 / F.col("n_cells")
    score = F.least(percent / 50.0, F.lit(1.0)) * 30.0 + F.col("best") / 100.0 * 30.0 + F.greatest(20.0 - 3.0 * (F.col("n_zones") - 1), F.lit(5.0)) + F.greatest(F.lit(0.0), 1.0 - F.col("buildable_slope") / 25.0) * 20.0
    counts = ["n_zones", *[f"n_{c}" for c in T.BUILDABILITY]]
    found = whole.join(best, "dem_id", "left").withColumns({"area": F.col("n_buildable") * cell * cell, "percent": percent, "quality": F.coalesce(F.least(score, F.lit(100.0)), F.lit(0.0))})
    return found.withColumns({"acres": F.col("area") / ACRE} | {c: F.coalesce(c, F.lit(0)) for c in counts}).drop("best")


def steep_zones(cells: DataFrame, inside: Column, limit: float, cell: float, least_area: float = 1.0) -> DataFrame:
    """Zones (4-connected) steeper than a limit, clipped to the site: cells and area."""
    steep = components(cells.withColumn("steep", F.coalesce(F.col("slope_percent") > limit, F.lit(False))), "steep", diagonal=False)
    return steep.where(F.col("zone_id").isNotNull() & inside).groupBy("dem_id", "zone_id").agg(F.count("*").alias("n_cells")).withColumn("area", F.col("n_cells") * cell * cell).where(F.col("area") > least_area)


def fill_gaps(cells: DataFrame, most: int, method: str = "linear") -> DataFrame:
    """cells with filled: gaps of no more than that many cells (joined by their sides) are interpolated, larger ones stay open."""
    from . import raster

    gaps = components(cells.withColumn("__gap", F.col("z").isNull()), "__gap", diagonal=False).withColumnRenamed("zone_id", "__zone").drop("__gap")
    sizes = gaps.where("__zone is not null").groupBy("dem_id", "__zone").agg(F.count("*").alias("__n"))
    filled = (raster.fill_linear if method == "linear" else raster.fill_nearest)(gaps.join(sizes.hint("merge"), ["dem_id", "__zone"], "left"))
    return filled.withColumn("filled", F.when(F.coalesce(F.col("__n"), F.lit(0)) <= most, F.col("filled"))).drop("__zone", "__n")
