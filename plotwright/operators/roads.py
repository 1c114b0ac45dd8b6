"""Road networks: grids over sites, edge weights, terminals, paths, trees, segments, junctions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions import geometry as G
from plotwright.tables import written

from . import block_search as blocks
from . import graph, spatial

#: Widths in metres.
WIDTHS = {"primary": 7.3, "secondary": 5.5, "access": 3.7}


def grid_nodes(sites: DataFrame, spacing: float) -> DataFrame:
    """Nodes every spacing over each site's box (min_x, min_y, max_x, max_y), its far sides left out."""
    steps = lambda lo, hi: F.explode(F.sequence(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / spacing).cast("int") - 1))
    at = sites.withColumn("row", steps("min_y", "max_y")).withColumn("col", steps("min_x", "max_x"))
    return at.select("site_id", (F.col("row") * 100_000 + F.col("col")).cast("long").alias("id"), "row", "col", (F.col("min_x") + F.col("col") * spacing).alias("x"), (F.col("min_y") + F.col("row") * spacing).alias("y"))


def zone_hits(nodes: DataFrame, zones: DataFrame, tile: float = 50.0) -> DataFrame:
    """site_id, id and zone_id of nodes that lie in zones (site_id, id, ring)."""
    z = spatial.tiled(zones, "ring", tile, "z_")
    at = nodes.select("site_id", "id", "x", "y", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    return at.join(z, ["site_id", "tx", "ty"]).where(G.in_ring(F.col("x"), F.col("y"), F.col("z_ring"))).select("site_id", "id", F.col("z_id").alias("zone_id"))


def free_nodes(nodes: DataFrame, zones: DataFrame, tile: float = 50.0) -> DataFrame:
    """nodes that lie in no zone."""
    return nodes.join(zone_hits(nodes, zones, tile), ["site_id", "id"], "left_anti")


def edge_weight(length: Column, slope: Column, rise: Column) -> Column:
    """Length, length by the mean slope, and earth moved, weighed 3 : 4 : 3."""
    steepness = F.when(slope < 8, 0.5).when(slope < 15, 1.5).when(slope < 25, 3.0).otherwise(10.0)
    return 0.3 * length + 0.4 * length * steepness + 0.3 * (F.abs(rise) * 6.0 * length * 0.01)


def edges(nodes: DataFrame, max_grade: float | None = None) -> DataFrame:
    """Weighted edges between neighbours of grid nodes (with z and slope); steeper ones than the grade are left out."""
    n = lambda end: nodes.select("site_id", F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("x", "y", "z", "slope")])
    met = spatial.grid_adjacency(nodes).join(n("src").hint("merge"), ["site_id", "src"]).join(n("dst").hint("merge"), ["site_id", "dst"])  # nodes are exploded from sites
    length = F.sqrt(F.pow(F.col("src_x") - F.col("dst_x"), 2) + F.pow(F.col("src_y") - F.col("dst_y"), 2))
    rise = F.col("dst_z") - F.col("src_z")
    out = met.withColumns({"length": length, "rise": rise, "grade": F.when(length < 0.1, 0.0).otherwise(F.abs(rise) / length * 100.0), "weight": edge_weight(length, (F.col("src_slope") + F.col("dst_slope")) / 2.0, rise)})
    return (out if max_grade is None else out.where(F.col("grade") <= max_grade)).select("site_id", "src", "dst", "length", "rise", "grade", "weight")


def path_measures(points: DataFrame) -> DataFrame:
    """Per path (site_id, path_id; points seq, x, y, z): length, greatest and mean grade, switchbacks (turns over 135 degrees)."""
    w = Window.partitionBy("site_id", "path_id").orderBy("seq")
    d = points.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "dz": F.col("z") - F.lag("z").over(w)})
    d = d.withColumns({"len": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))})
    d = d.withColumns({"pdx": F.lag("dx").over(w), "pdy": F.lag("dy").over(w), "plen": F.lag("len").over(w)})
    cosine = F.try_divide(F.col("dx") * F.col("pdx") + F.col("dy") * F.col("pdy"), F.col("len") * F.col("plen"))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    grade = F.when(F.col("len") > 0.1, F.abs("dz") / F.col("len") * 100.0)
    return d.groupBy("site_id", "path_id").agg(F.sum("len").alias("length"), F.max(grade).alias("max_grade"), F.avg(grade).alias("mean_grade"), F.count_if(turn > 135.0).alias("switchbacks"), F.count("*").alias("n_points"))


def road_class(at_entrance: Column, n_assets: Column) -> Column:
    return F.when(at_entrance, "primary").when(n_assets > 5, "secondary").otherwise("access")


def with_width(segments: DataFrame) -> DataFrame:
    width = F.when(F.col("class") == "primary", WIDTHS["primary"]).when(F.col("class") == "secondary", WIDTHS["secondary"]).otherwise(WIDTHS["access"])
    return segments.withColumn("width", width)


def segment_earth(points: DataFrame, width: Column) -> DataFrame:
    """Per segment the earth moved: over its steps length x width x half the rise."""
    w = Window.partitionBy("site_id", "path_id").orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)) * F.abs(F.col("z") - F.lag("z").over(w)) / 2.0
    return points.withColumn("v", step * width).groupBy("site_id", "path_id").agg(F.sum("v").alias("earth"))


def junctions(segments: DataFrame) -> DataFrame:
    """Nodes where three segments (site_id, src, dst, width) or more meet: how many, of what kind, and the radius."""
    ends = segments.select("site_id", F.col("src").alias("node"), "width").union(segments.select("site_id", "dst", "width"))
    found = ends.groupBy("site_id", "node").agg(F.count("*").alias("n"), (1.5 * F.max("width")).alias("radius")).where("n >= 3")
    return found.withColumn("kind", F.when(F.col("n") == 3, "T-junction").when(F.col("n") == 4, "cross").otherwise(F.concat(F.col("n"), F.lit("-way"))))


def star(entrances: DataFrame, assets: DataFrame) -> DataFrame:
    """Straight roads from each site's entrance (x, y) to its assets."""
    met = assets.select("site_id", "id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(entrances.hint("merge"), "site_id")
    return met.select("site_id", "id", F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2)).alias("length"))


def areas(segments: DataFrame, shoulder: float) -> DataFrame:
    return segments.withColumns({"area": F.col("length") * F.col("width"), "area_with_shoulders": F.col("length") * (F.col("width") + 2.0 * shoulder)})


def network_statistics(segments: DataFrame) -> DataFrame:
    """Per site, and per class in it, count, length, area and greatest grade: one rollup gives both."""
    return segments.groupingSets([["site_id", "class"], ["site_id"]], "site_id", "class").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum(F.col("length") * F.col("width")).alias("area"), F.max("grade").alias("max_grade"), F.avg("grade").alias("mean_grade"))


def node_rows(nodes: DataFrame, cells: DataFrame, cell: float, level: float = 100.0) -> DataFrame:
    """nodes with z and slope of the site's raster where they lie; a site or place without one is flat at a level."""
    found = spatial.sample(cells, nodes.select(F.col("site_id").alias("dem_id"), "id", "x", "y"), cell).join(cells.select("dem_id", "row", "col", "slope_percent").hint("merge"), ["dem_id", "row", "col"], "left")
    own = found.select(F.col("dem_id").alias("site_id"), "id", F.coalesce("z", F.lit(level)).alias("z"), F.coalesce("slope_percent", F.lit(0.0)).alias("slope"))
    return nodes.join(own.hint("merge"), ["site_id", "id"])


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A road graph as GeoJSON features, one a row: its nodes (site_id, id, x, y, z, slope, is_entrance) as points, its edges (src, dst, weight) as lines."""
    at = lambda p: F.array(f"{p}x", f"{p}y")
    feature = lambda kind, coordinates, properties: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))
    points = nodes.select("site_id", feature("Point", at(""), F.struct("id", F.col("z").alias("elevation"), F.col("slope").alias("slope_percent"), "is_entrance", F.lit("node").alias("type"))).alias("feature"))
    end = lambda p, c: nodes.select("site_id", F.col("id").alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    met = edges.join(end("a", "src"), ["site_id", "src"]).join(end("b", "dst"), ["site_id", "dst"])
    lines = met.select("site_id", feature("LineString", F.array(at("a"), at("b")), F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "weight", F.lit("edge").alias("type"))).alias("feature"))
    return points.union(lines)


FEET = 3.28084


def site_network(nodes: DataFrame, entrances: DataFrame, assets: DataFrame, spacing: float, max_grade: float) -> DataFrame:
    """Roads of each site as segments: site_id, src, dst (node ids, or an asset's id), kind, length, length_ft, max_grade, class, width.

    Grid nodes (site_id, id, row, col, x, y, z, slope) are linked where the grade allows; the entrance (site_id, x, y)
    and every asset (site_id, id, x, y) take the nearest node within two spacings. Roads follow the ways of least cost
    between these nodes, and the tree of least length among them is built. A road at the entrance is primary, others
    are secondary on a site of more than five assets. An asset without a node, or whose node no way reaches from the
    entrance, gets a straight road from the entrance instead.
    """
    gate = F.lit(-1).cast("long")
    points = assets.select("site_id", "id", "x", "y").union(entrances.select("site_id", gate, "x", "y"))
    nearest = spatial.within_radius(points, nodes, 2.0 * spacing).groupBy("site_id", "point_id").agg(F.min(F.struct("distance", "node_id"))["node_id"].alias("node"))
    nearest = written(nearest, "terminals")
    network = terminal_network(edges(nodes, max_grade), nearest.select("site_id", "node").distinct(), routed_by="weight", block=blocks.grid_block)
    at = network.paths().join(nodes.select("site_id", F.col("id").alias("node"), "x", "y", "z").hint("merge"), ["site_id", "node"])
    own = path_measures(at.withColumn("path_id", F.struct("src", "dst"))).select("site_id", "path_id.src", "path_id.dst", "length", "max_grade")
    start = nearest.where(F.col("point_id") == gate).select("site_id", F.col("node").alias("gate"))
    n_assets = assets.groupBy("site_id").agg(F.count("*").alias("n_assets"))
    ends = own.join(start.hint("merge"), "site_id", "left").join(n_assets.hint("merge"), "site_id", "left")
    at_gate = F.coalesce((F.col("src") == F.col("gate")) | (F.col("dst") == F.col("gate")), F.lit(False))
    found = ends.select("site_id", "src", "dst", F.lit("path").alias("kind"), "length", "max_grade", road_class(at_gate, F.coalesce("n_assets", F.lit(0))).alias("class"))
    reached = network.reached(start.select("site_id", F.col("gate").alias("node")))
    alone = assets.select("site_id", "id", "x", "y").join(nearest.join(reached.hint("merge"), ["site_id", "node"]).hint("merge").select("site_id", F.col("point_id").alias("id")), ["site_id", "id"], "left_anti")
    straight = star(entrances, alone).select("site_id", gate.alias("src"), F.col("id").alias("dst"), F.lit("straight").alias("kind"), "length", F.lit(None).cast("double").alias("max_grade"), F.lit("access").alias("class"))
    return with_width(found.unionByName(straight).withColumn("length_ft", F.col("length") * FEET))


@dataclass
class Network:
    """The tree between each site's terminals: tree (site_id, src, dst, length, cost, and the edge a, b where their regions meet) and the ways that it follows."""

    tree: DataFrame
    ways: DataFrame
    terminals: DataFrame
    block: Callable[[Column], Column]

    def paths(self) -> DataFrame:
        """site_id, src, dst, seq, node: the nodes of each road, from src through a and b to dst."""
        ends = self.tree.select("site_id", "src", "dst", "a", "b")
        goals = ends.select("site_id", F.explode(F.array("a", "b")).alias("goal")).withColumn("search", F.lit(0))
        walked = blocks.paths(self.ways, goals, self.block).select("site_id", "goal", "node", "arcs")
        half = lambda c, seq: ends.withColumn("goal", F.col(c)).join(walked.hint("merge"), ["site_id", "goal"]).select("site_id", "src", "dst", seq.cast("long").alias("seq"), "node")
        return half("a", F.col("arcs")).unionByName(half("b", F.lit(1 << 40) - F.col("arcs")))

    def status(self) -> DataFrame:
        """site_id, n_terminals, n_links, connected: a row for every site, also for one that no road joins."""
        n = self.terminals.groupBy("site_id").agg(F.count("*").alias("n_terminals"))
        links = self.tree.groupBy("site_id").agg(F.count("*").alias("n_links"))
        found = n.join(links, "site_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        return found.withColumn("connected", F.col("n_links") == F.col("n_terminals") - 1)

    def reached(self, starts: DataFrame) -> DataFrame:
        """site_id, node: the terminals that roads join with the starts (site_id, node), and these."""
        key = lambda c: F.struct("site_id", F.col(c).alias("node"))
        parts = graph.labelled(self.terminals.select(key("node").alias("node")), self.tree.select(key("src").alias("s"), key("dst").alias("d")), "s", "d")
        roots = parts.join(starts.select(key("node").alias("node")), "node", "left_semi").select("root").distinct()
        return parts.join(roots.hint("merge"), "root").select("node.*")


def terminal_network(links: DataFrame, terminals: DataFrame, routed_by: str = "length", block: Callable[[Column], Column] = blocks.id_block) -> Network:
    """The tree of least length that joins each site's terminals (site_id, node) over links (site_id, src, dst, weight, length).

    One search a site starts from all its terminals at once; ways are routed by weight or by length. Routed by length,
    the tree is as short as one of the shortest ways between all pairs; routed by weight, as short as one of the
    cheapest ways through the edges where the terminals' regions meet.
    """
    terminals = written(terminals.select("site_id", "node").distinct(), "terminals")
    own = links.select("site_id", "src", "dst", F.col(routed_by).alias("weight"), "length")
    ways = blocks.searched(own, terminals.withColumn("search", F.lit(0)), block)
    met = written(blocks.nearest_links(own, ways), "links")
    tree = graph.spanning_forest(met.select("site_id", "src", "dst", F.col("length").alias("weight"))).select("site_id", "src", "dst")
    return Network(written(met.join(tree.hint("merge"), ["site_id", "src", "dst"]), "tree"), ways, terminals, block)
