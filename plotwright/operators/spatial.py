"""Spatial joins by tiles, and the joins of sites, assets, zones, roads and cells.

Two sides meet by equal (site_id, tile); a pair that shares several tiles is kept in the one that holds the
lower left corner of their common box, so nothing needs to be made distinct afterwards. Equal rings of a site meet
others once, as one kind, and pairs of kinds become pairs of ids last.

Sides with rows of their own for tiles, cells or ids are larger than Spark can know when it plans; their joins name
the sort-merge join, so that none of them is collected by the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions import geometry as G
from plotwright.tables import written

from . import scanlines
from .selection import with_percentiles


def tiled(df: DataFrame, ring: str, tile: float, prefix: str, grow: float = 0.0) -> DataFrame:
    """df with its columns prefixed, one row for each tile that the box of its ring (grown) meets."""
    b = G.bounds(F.col(ring))
    low = lambda c: F.floor((b[c] - grow) / tile)
    high = lambda c: F.floor((b[c] + grow) / tile)
    named = df.select("site_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "site_id"], b.alias(prefix + "box"), low("min_x").alias(prefix + "tx0"), low("min_y").alias(prefix + "ty0"), high("max_x").alias("__x1"), high("max_y").alias("__y1"))
    return named.withColumn("tx", F.explode(F.sequence(prefix + "tx0", "__x1"))).withColumn("ty", F.explode(F.sequence(prefix + "ty0", "__y1"))).drop("__x1", "__y1")


def _boxed(df: DataFrame, prefix: str, tile: float, ring: str, grow: Column) -> DataFrame:
    """df with its columns prefixed, its grown box and the level of its size: tiles double in width from level to level, and a box meets four of its level at most."""
    box = F.col(prefix + "box")
    by = F.col("__grow")
    grown = F.struct(*[(box[c] - by if c.startswith("min") else box[c] + by).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    bounded = df.withColumns({prefix + "box": G.bounds(F.col(ring)), "__grow": grow})
    named = bounded.withColumn(prefix + "box", grown).select("site_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "site_id"], prefix + "box")
    size = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"], F.lit(tile))
    return named.withColumn(prefix + "level", F.ceil(F.log2(size / tile)).cast("int"))


def _tiles(boxed: DataFrame, prefix: str, tile: float, levels: Column) -> DataFrame:
    """A row for each tile of the given levels that a box meets: level, tx, ty, and the first of these tiles."""
    box = F.col(prefix + "box")
    each = boxed.withColumn("level", F.explode(levels)).withColumn("__w", tile * F.pow(F.lit(2.0), F.col("level")))
    low, high = (lambda c: F.floor(box[c] / F.col("__w"))), (lambda c: F.floor(box[c] / F.col("__w")))
    first = each.withColumns({prefix + "tx0": low("min_x"), prefix + "ty0": low("min_y")})
    return first.withColumn("tx", F.explode(F.sequence(prefix + "tx0", high("max_x")))).withColumn("ty", F.explode(F.sequence(prefix + "ty0", high("max_y")))).drop("__w")


def pairs(left: DataFrame, right: DataFrame, within: float | str = 0.0, tile: float = 50.0, ring: str = "ring") -> DataFrame:
    """Candidate pairs of a site whose boxes come within a distance, one for all or a column of left: columns a_* and b_*.

    Boxes are dealt by tiles of their own size, and the smaller one of a pair looks for the larger one at its level; so
    a large box costs no more rows than a small one, and a wide distance widens the search of its own row only.
    """
    grow = (F.col(within) if isinstance(within, str) else F.lit(float(within))) + 1e-6  # a sum's last digit must not lose a pair
    a, b = _boxed(left, "a_", tile, ring, grow), _boxed(right, "b_", tile, ring, F.lit(0.0))
    seen = lambda df, c: df.groupBy("site_id").agg(F.collect_set(c).alias("levels"))  # noqa: E731  # some dozen at most
    own = lambda df, p: _tiles(df, p, tile, F.array(p + "level"))
    above = lambda df, other, p, q, same: _tiles(df.join(seen(other, q + "level").hint("merge"), "site_id"), p, tile, F.filter("levels", lambda v: v >= F.col(p + "level") if same else v > F.col(p + "level"))).drop("levels")
    key = ["site_id", "level", "tx", "ty"]
    up = above(a, b, "a_", "b_", True).join(own(b, "b_").hint("merge"), key)
    down = own(a, "a_").join(above(b, a, "b_", "a_", False).hint("merge"), key)
    met = up.unionByName(down)
    first = (F.col("tx") == F.greatest("a_tx0", "b_tx0")) & (F.col("ty") == F.greatest("a_ty0", "b_ty0"))
    near = [F.col(f"{p}_box.min_{c}") <= F.col(f"{q}_box.max_{c}") for c in "xy" for p, q in ("ab", "ba")]
    return met.where(first & near[0] & near[1] & near[2] & near[3]).drop("level", "tx", "ty", *[p + c for p in ("a_", "b_") for c in ("tx0", "ty0", "box", "level")])


#: Ids of a kind that stand in one row.
SOME = 512


def kinds(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows (site_id, id) of a site that are equal in columns as one: these, their id, and n, how many they are."""
    return rows.groupBy("site_id", *columns).agg(F.struct(F.min("id").alias("least"), F.xxhash64(*columns).alias("of")).alias("id"), F.count("*").alias("n"))


def ids_of_kinds(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """site_id, kind, ids: the ids that kinds() has made one of, some in a row."""
    met = rows.select("site_id", *columns, F.col("id").alias("member")).join(found.select("site_id", *columns, "id", "n").hint("merge"), ["site_id", *columns])
    part = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / SOME))
    return met.groupBy("site_id", F.col("id").alias("kind"), part.alias("part")).agg(F.collect_list("member").alias("ids")).drop("part")


def pairs_of_ids(met: DataFrame, a_ids: DataFrame, b_ids: DataFrame) -> DataFrame:
    """Pairs of kinds (a_id, b_id) as pairs of the ids that they stand for: all ids of both, dealt over all tasks by some of either."""
    side = lambda ids, p: ids.select("site_id", F.col("kind").alias(f"{p}_id"), F.col("ids").alias(f"{p}_ids")).hint("merge")
    both = met.join(side(a_ids, "a"), ["site_id", "a_id"]).join(side(b_ids, "b"), ["site_id", "b_id"])
    met = written(met, "met")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = both.repartition(n, "site_id", F.xxhash64("a_ids"), F.xxhash64("b_ids"))  # a small table of many pairs would be one task
    return each.withColumn("a_id", F.explode("a_ids")).withColumn("b_id", F.explode("b_ids")).drop("a_ids", "b_ids")


def known(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with what is found once a ring, not once a pair: its bounds if it is a rectangle along the axes, and whether it can be clipped."""
    found = rows.select("site_id", "id", "ring", *columns, G.upright(F.col("ring")).alias("upright"))
    return found.withColumn("plain", F.when(F.col("upright").isNull(), G.is_plain(F.col("ring"))).otherwise(G.signed_area(F.col("ring")) > 0))


def known_kinds(rows: DataFrame, *columns: str) -> DataFrame:
    """kinds() of rings with what is known() of them, as a table: its plan ends there."""
    return written(known(kinds(rows, *columns), *columns[1:], "n"), "kinds")


def common_area() -> Column:
    """Of a pair of known() rings."""
    both = F.col("a_upright").isNotNull() & F.col("b_upright").isNotNull()
    return F.when(both, G.upright_area(F.col("a_upright"), F.col("b_upright"))).otherwise(G.overlap_area(F.col("a_ring"), F.col("b_ring"), F.col("a_plain") & F.col("b_plain")))


def apart() -> Column:
    """The distance of a pair of known() rings."""
    both = F.col("a_upright").isNotNull() & F.col("b_upright").isNotNull()
    return F.when(both, G.upright_distance(F.col("a_upright"), F.col("b_upright"))).otherwise(G.ring_distance(F.col("a_ring"), F.col("b_ring")))


def overlaps(assets: DataFrame) -> DataFrame:
    """Pairs of assets (id, ring) of a site whose areas meet, and by how much."""
    own = known_kinds(assets, "ring")
    met = pairs(own, own).withColumn("area", common_area()).where("area > 1e-9").select("site_id", "a_id", "b_id", "area")
    ids = ids_of_kinds(assets, own, "ring")
    return pairs_of_ids(met, ids, ids).where("a_id < b_id").select("site_id", "a_id", "b_id", "area")


def corner_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rings of a site of which a corner of either lies in the other."""
    return pairs(left, right).where(G.has_corner_inside(F.col("a_ring"), F.col("b_ring"))).select("site_id", "a_id", "b_id")


def crowded(assets: DataFrame, spacing: str = "spacing") -> DataFrame:
    """Pairs a < b closer than a's spacing."""
    own, others = known_kinds(assets, "ring", spacing), known_kinds(assets, "ring")
    met = pairs(own, others, spacing).withColumn("distance", apart()).where(F.col("distance") <= F.col(f"a_{spacing}")).select("site_id", "a_id", "b_id", "distance")
    return pairs_of_ids(met, ids_of_kinds(assets, own, "ring", spacing), ids_of_kinds(assets, others, "ring")).where("a_id < b_id").select("site_id", "a_id", "b_id", "distance")


def on_zones(assets: DataFrame, zones: DataFrame, least_area: float = 0.1) -> DataFrame:
    """Assets and zones of a site that share more than an area."""
    met = pairs(known(assets), known(zones)).withColumn("area", common_area())
    return met.where(F.col("area") > least_area).select("site_id", F.col("a_id").alias("asset_id"), F.col("b_id").alias("zone_id"), "area")


def outside(assets: DataFrame, sites: DataFrame) -> DataFrame:
    """Assets with a corner outside their site (site_id, parts)."""
    met = assets.join(sites.hint("merge"), "site_id", "left")
    inside = F.forall("ring", lambda p: G.contains(F.col("parts"), p["x"], p["y"]) | (F.array_min(F.transform("parts", lambda r: G.line_distance(p["x"], p["y"], r))) < 1e-9))
    return met.where(~F.coalesce(inside, F.lit(False))).select("site_id", "id")


def zonal(cells: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """Cells of a raster whose middle lies in a shape of its site (id, and ring or parts), with shape_id."""
    return scanlines.covered(cells, scanlines.spans(shapes, cell))


def zonal_statistics(cells: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """Per shape on its raster: cells with a value, their mean, variance and median."""
    under = written(zonal(cells, shapes, cell).where("z is not null").select("dem_id", "shape_id", "z"), "under")
    found = under.groupBy("dem_id", "shape_id").agg(F.count("*").alias("n_cells"), F.avg("z").alias("mean_z"), F.var_pop("z").alias("var_z"))
    return with_percentiles(under, ["dem_id", "shape_id"], "z", {"median_z": 0.5}, found)


def sample(cells: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """points (dem_id, id, x, y) with z of the cell that they lie in, null outside."""
    at = points.withColumns({"row": (F.col("y") / cell).cast("int"), "col": (F.col("x") / cell).cast("int")})
    return at.join(cells.select("dem_id", "row", "col", "z").hint("merge"), ["dem_id", "row", "col"], "left")


def nearest(points: DataFrame, items: DataFrame, boxes: tuple[str, str, str, str], best: Column, reach: float) -> DataFrame:
    """Per point (site_id, point, x, y) the least struct best, of its distance and more, over the items of its site that may be nearest.

    items: columns of their own and those of their boxes (min x, min y, max x, max y). A round looks into the nine tiles
    around a point; what lies within a tile's width is settled, the others look again in tiles four times as wide. A
    point of a site without items has no row. Each round is written, so that the next one does not run it again.
    """
    low_x, low_y, high_x, high_y = boxes
    left, found, width = written(points.join(items.select("site_id").distinct(), "site_id", "left_semi"), "left"), None, reach
    while True:
        tile = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        steps = lambda lo, hi: F.explode(F.sequence(tile(lo), tile(hi)))  # noqa: E731, B023
        dealt = items.withColumn("tx", steps(low_x, high_x)).withColumn("ty", steps(low_y, high_y))
        around = F.explode(F.array(*[F.struct((tile("x") + a).alias("tx"), (tile("y") + b).alias("ty")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        met = left.withColumn("__t", around).select("site_id", "point", "x", "y", "__t.*").join(dealt, ["site_id", "tx", "ty"])
        near = met.groupBy("site_id", "point").agg(F.min(best).alias("of")).where(F.col("of.distance") <= width)
        near = written(near, "near")
        found = near if found is None else found.unionByName(near)
        left = written(left.join(near.select("site_id", "point"), ["site_id", "point"], "left_anti"), "left")
        if not left.limit(1).count():
            return found
        width *= 4


def nearest_road(sites: DataFrame, roads: DataFrame, reach: float = 100.0) -> DataFrame:
    """Per site (x, y) the nearest point of its roads (seq, line), the earliest of equals; the site's own point without a road.

    Roads are taken apart into segments, and a gate meets those of the tiles around it, not its site's whole lines.
    """
    line = F.when(F.size("line") > 1, F.col("line")).otherwise(F.concat("line", "line"))
    cut = roads.where(F.size("line") > 0).select("site_id", "seq", F.explode(G.edges(line)).alias("e"))
    ends = lambda f, c: f(F.col(f"e.a.{c}"), F.col(f"e.b.{c}"))
    segments = cut.select("site_id", "seq", "e", ends(F.least, "x").alias("x0"), ends(F.least, "y").alias("y0"), ends(F.greatest, "x").alias("x1"), ends(F.greatest, "y").alias("y1"))
    at = G.segment_nearest(F.col("x"), F.col("y"), F.col("e"))
    best = F.struct(at["d"].alias("distance"), "seq", at["x"].alias("x"), at["y"].alias("y"))
    found = nearest(sites.select("site_id", F.lit(0).alias("point"), "x", "y"), segments, ("x0", "y0", "x1", "y1"), best, reach)
    met = sites.join(found.select("site_id", "of"), "site_id", "left")
    return met.select("site_id", F.coalesce("of.x", "x").alias("entry_x"), F.coalesce("of.y", "y").alias("entry_y"), F.col("of.distance").alias("distance"), F.col("of.seq").alias("road"))


def within_radius(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs of points and nodes (site_id, id, x, y) at most a radius apart: a point looks into the nine tiles around its own."""
    tx, ty = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.explode(F.array(*[F.struct((tx + a).alias("tx"), (ty + b).alias("ty")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = points.select("site_id", F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"), around.alias("t")).select("*", "t.tx", "t.ty").drop("t")
    met = p.join(nodes.select("site_id", "id", "x", "y", tx.alias("tx"), ty.alias("ty")).hint("merge"), ["site_id", "tx", "ty"])
    d = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))
    return met.withColumn("distance", d).where(F.col("distance") <= radius).select("site_id", "point_id", F.col("id").alias("node_id"), "distance")


def nearest_node(points: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """Per point its nearest node, the least id of equals: by tiles of the reach, then for what is left by four times as wide ones."""
    items = nodes.select("site_id", F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    away = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
    found = nearest(points.select("site_id", F.col("id").alias("point"), "x", "y"), items, ("nx", "ny", "nx", "ny"), F.struct(away.alias("distance"), "node_id"), reach)
    return found.select("site_id", F.col("point").alias("point_id"), "of.*")


def grid_adjacency(nodes: DataFrame) -> DataFrame:
    """Links of grid nodes (site_id, id, row, col) to their neighbours at the right and below, corners too."""
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = nodes.select("site_id", F.col("id").alias("src"), ahead.alias("o"), "row", "col").select("site_id", "src", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    return sent.join(nodes.select("site_id", F.col("id").alias("dst"), "row", "col").hint("merge"), ["site_id", "row", "col"]).select("site_id", "src", "dst")


def type_spacing(rules: DataFrame) -> DataFrame:
    """rules (from_type, to_type, metres) in both directions; a pair's own rule goes before the mirrored one. A pair without a rule needs no room."""
    both = rules.select("from_type", "to_type", "metres", F.lit(0).alias("order")).union(rules.select("to_type", "from_type", "metres", F.lit(1)))
    return both.groupBy("from_type", "to_type").agg(F.min_by("metres", "order").alias("metres"))


def rule_spacing(assets: DataFrame, rules: DataFrame, tile: float = 50.0) -> DataFrame:
    """Pairs a < b of assets (id, type, ring) of a site that are closer than the rule for their types asks for.

    Rules are few by their nature, one a pair of types; an asset looks as far as the widest rule of its own type.
    """
    ruled = type_spacing(rules)
    widest = ruled.groupBy(F.col("from_type").alias("type")).agg(F.max("metres").alias("reach"))
    own = known_kinds(assets, "ring", "type")
    met = pairs(own.join(F.broadcast(widest), "type"), own, "reach", tile)
    both = met.join(F.broadcast(ruled), (F.col("a_type") == F.col("from_type")) & (F.col("b_type") == F.col("to_type")))
    near = both.withColumn("distance", apart()).where("distance < metres").select("site_id", "a_id", "b_id", "metres", "distance")
    ids = ids_of_kinds(assets, own, "ring", "type")
    return pairs_of_ids(near, ids, ids).where("a_id < b_id").select("site_id", "a_id", "b_id", "metres", "distance")


def shared_points(lines: DataFrame, digits: int = 8) -> DataFrame:
    """Points (x, y, rounded) that lines (site_id, line) use twice or more."""
    p = lines.select("site_id", F.explode("line").alias("p")).select("site_id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y"))
    return p.groupBy("site_id", "x", "y").agg(F.count("*").alias("n")).where("n >= 2")
