"""Queries over headers, styles, coordinate systems, outlines, flood zones and road networks of sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwright.functions import crs
from plotwright.functions import geometry as G
from plotwright.operators import observations, paths, raster, roads, spatial, zones
from plotwright.operators.stencil import terrain as derive
from plotwright.sources import kml

from .fixtures import CELL, dem, r, rounded, table, terrain_sql
from .sites import ASSETS, NODES, SURVEYED, assets, entrances, nodes, nudged, surveyed
from .zones import PARTS, ZONES, zoned

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def styled_files(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("<LineStyle><color>ff00"), F.lpad((k % 100).cast("string"), 4, "0"), F.lit("</color>"), F.when(k % 3 > 0, F.concat(F.lit("<width>"), k % 7 + 0.5, F.lit("</width>"))).otherwise(""), F.lit("</LineStyle>"))
    poly = F.when(k % 2 == 0, F.concat(F.lit("<PolyStyle><color>7f"), F.lpad((k % 50).cast("string"), 6, "0"), F.lit("</color>"), F.when(k % 4 == 0, "<fill>0</fill>").otherwise(""), F.lit("</PolyStyle>"))).otherwise("")
    head = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name> '), "s_name", F.lit(" </name>"), F.when(k % 5 > 0, F.concat(F.lit("<description>about "), k, F.lit("</description>"))).otherwise(""))
    body = F.concat(head, F.lit('<Style id="own">'), line, poly, F.lit('</Style><Style id="bare"/><Style><LineStyle/></Style></Document></kml>'))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("site"), k, F.lit(".kml")).alias("path"), body.cast("binary").alias("content"))


@query("a07_kml_styles", """SELECT 'site' || s_suppkey || '.kml' AS path, 'own' AS style, 'ff00' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 4, '0') AS line_color, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 + 0.5e0 ELSE 1e0 END AS line_width, CASE WHEN s_suppkey % 2 = 0 THEN '7f' || lpad(CAST(s_suppkey % 50 AS VARCHAR), 6, '0') ELSE '' END AS fill_color, s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 AS filled FROM supplier
UNION ALL SELECT 'site' || s_suppkey || '.kml', 'bare', '', -1e0, '', false FROM supplier""")
def _(spark, sf_dir):
    return kml.styles(styled_files(spark, sf_dir)).fillna({"line_color": "", "line_width": -1.0, "fill_color": "", "filled": False})


@query("a07_kml_heads", "SELECT 'site' || s_suppkey || '.kml' AS path, s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN 'about ' || s_suppkey ELSE '' END AS description FROM supplier")
def _(spark, sf_dir):
    return kml.heads(styled_files(spark, sf_dir)).fillna("")


HEADERS = """hd AS (SELECT c_custkey AS dem_id, 0.05e0 + c_custkey % 13 * 10e0 AS cell_x, 0.05e0 + c_custkey % 13 * 10e0 + c_custkey % 2 * 0.5e0 AS cell_y, c_custkey % 400 - 200e0 AS min_x, c_custkey % 70 - 35e0 AS min_y, c_custkey % 400 - 200e0 + (c_custkey % 11 - 1) * CASE WHEN c_custkey % 5 = 0 THEN 200000e0 ELSE 1.5e0 END AS max_x, c_custkey % 70 - 35e0 + (c_custkey % 9 - 1) * 1e0 AS max_y, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 4326 ELSE 32633 END AS epsg FROM customer)"""


def headers(spark, sf_dir):
    k = F.col("c_custkey")
    cell, x, y = 0.05 + k % 13 * 10.0, k % 400 - 200.0, k % 70 - 35.0
    epsg = F.when(k % 3 == 1, 4326).when(k % 3 == 2, 32633)
    return table(spark, sf_dir, "customer").select(
        k.alias("dem_id"), cell.alias("cell_x"), (cell + k % 2 * 0.5).alias("cell_y"), x.alias("min_x"), y.alias("min_y"), (x + (k % 11 - 1) * F.when(k % 5 == 0, 200_000.0).otherwise(1.5)).alias("max_x"),
        (y + (k % 9 - 1) * 1.0).alias("max_y"), epsg.alias("epsg"), (epsg == 4326).alias("geographic"),
    )


def _listed(*rules: tuple[str, str]) -> str:
    return "array_to_string([v for v in [" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + "] if v IS NOT NULL], ';')"


CELLS = _listed(("abs(cell_x - cell_y) > 0.01", "cells are not square"), ("greatest(cell_x, cell_y) > 100", "coarse cells"), ("least(cell_x, cell_y) < 0.1", "very fine cells"))
WIDE = _listed(("deg AND most > 10", "over ten degrees wide"), ("NOT deg AND most > 1000000", "over a thousand kilometres wide"))
ORDER = _listed(("min_x >= max_x", "west is not before east"), ("min_y >= max_y", "south is not before north"))
SYSTEM = _listed(("epsg IS NULL", "no coordinate system"), ("epsg = 4326", "geographic coordinates"))
BOUNDED = f"{HEADERS}, hb AS (SELECT *, min_x BETWEEN -180 AND 180 AND min_y BETWEEN -90 AND 90 AS deg, greatest(max_x - min_x, max_y - min_y) AS most FROM hd)"


def _of(found, column: str, texts: tuple[str, ...]):
    return found.select("dem_id", F.array_join(F.filter(column, lambda t: t.isin(*texts)), ";").alias(column))


@query("q01_cell_checks", f"WITH {HEADERS} SELECT dem_id, {CELLS} AS warnings FROM hd")
def _(spark, sf_dir):
    return _of(raster.header_checks(headers(spark, sf_dir)), "warnings", ("cells are not square", "coarse cells", "very fine cells"))


@query("q02_bounds_checks", f"WITH {BOUNDED} SELECT dem_id, {ORDER} AS issues, {WIDE} AS warnings FROM hb")
def _(spark, sf_dir):
    found = raster.header_checks(headers(spark, sf_dir))
    return _of(found, "warnings", ("over ten degrees wide", "over a thousand kilometres wide")).join(found.select("dem_id", F.array_join("issues", ";").alias("issues")), "dem_id")


@query("q03_system_checks", f"WITH {HEADERS} SELECT dem_id, {SYSTEM} AS warnings FROM hd")
def _(spark, sf_dir):
    return _of(raster.header_checks(headers(spark, sf_dir)), "warnings", ("no coordinate system", "geographic coordinates"))


@query("c13_crs_of_content", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 4326 WHEN 1 THEN 32600 + s_suppkey % 60 WHEN 2 THEN 4326 WHEN 3 THEN 32700 + s_suppkey % 60 ELSE -1 END AS epsg FROM supplier")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    body = (
        F.when(k % 5 == 0, '{"type":"FeatureCollection","features":[]}').when(k % 5 == 1, F.concat(F.lit(' {"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::'), 32600 + k % 60, F.lit('"}}}')))
        .when(k % 5 == 2, '<kml xmlns="http://www.opengis.net/kml/2.2"><Document/></kml>').when(k % 5 == 3, F.concat(F.lit("<kml><Document><srs> EPSG:"), 32700 + k % 60, F.lit(" </srs></Document></kml>"))).otherwise("neither")
    )
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.coalesce(crs.by_content(body), F.lit(-1)).alias("epsg"))


@query("c26_point_transform", """WITH p AS (SELECT c_custkey AS id, c_custkey * 7 % 300 - 150 + 0.25e0 AS lon, c_custkey * 11 % 140 - 70 + 0.5e0 AS lat, c_custkey % 90 * 1e0 AS z, c_custkey % 3 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN round(radians(lon) * 6378137e0, 4) + 0.0 WHEN 1 THEN lon ELSE NULL END AS x, CASE k WHEN 0 THEN round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 4) + 0.0 WHEN 1 THEN lat ELSE NULL END AS y, CASE WHEN k < 2 THEN z END AS z, CASE k WHEN 0 THEN 'EPSG:4326 to EPSG:3857' WHEN 1 THEN 'EPSG:4326 to EPSG:4326' ELSE '' END AS description FROM p""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = k * 7 % 300 - 150 + 0.25, k * 11 % 140 - 70 + 0.5
    to = F.when(k % 3 == 0, 3857).when(k % 3 == 1, 4326).otherwise(27700)
    moved = table(spark, sf_dir, "customer").select(k.alias("id"), crs.transformed(lon, lat, k % 90 * 1.0, F.lit(4326), to).alias("p"))
    return moved.select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"), "p.z", F.coalesce("p.description", F.lit("")).alias("description"))


@query("c26_transform_round_trip", "SELECT c_custkey AS id, c_custkey * 7 % 300 - 150 + 0.25e0 AS lon, c_custkey * 11 % 140 - 70 + 0.5e0 AS lat FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = k * 7 % 300 - 150 + 0.25, k * 11 % 140 - 70 + 0.5
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    there = F.when(k % 2 == 0, 3857).otherwise(F.when(lat >= 0, 32600).otherwise(32700) + zone)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), there.alias("there"), crs.transformed(lon, lat, F.lit(0.0), F.lit(4326), there).alias("p"))
    back = rows.select("id", crs.transformed(F.col("p.x"), F.col("p.y"), F.col("p.z"), F.col("there"), F.lit(4326)).alias("q"))
    return back.select("id", F.round("q.x", 5).alias("lon"), F.round("q.y", 5).alias("lat"))


@query("g02_outlines", f"{ZONES}{PARTS} SELECT dem_id, zone_id, n_cells, n_parts, {r('perimeter')}, n_cells * 100e0 AS area, round(least(4e0 * pi() * n_cells * 100e0 / (perimeter * perimeter), 1e0), 6) + 0.0 AS compactness FROM pl")
def _(spark, sf_dir):
    return zones.outlines(zoned(spark, sf_dir), CELL).withColumn("zone_id", F.col("zone_id").cast("long"))


@query("h10_ring_convexity", "SELECT c_custkey AS id, c_custkey % 4 < 2 AS convex FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    p = lambda x, y: G.point(k * 1.0 + x, k * 1.0 + y)
    square, angled = G.closed([p(0, 0), p(2, 0), p(2, 2), p(0, 2)]), G.closed([p(0, 0), p(2, 0), p(2, 1), p(1, 1), p(1, 2), p(0, 2)])
    ring = F.when(k % 4 == 0, square).when(k % 4 == 1, F.reverse(square)).when(k % 4 == 2, angled).otherwise(G.closed([p(0, 0), p(2, 2), p(2, 0), p(0, 2)]))
    return table(spark, sf_dir, "customer").select(k.alias("id"), G.is_convex(ring).alias("convex"))


CORNER = "(({a}.x0 > {b}.x0 AND {a}.x0 < {b}.x1) OR ({a}.x1 > {b}.x0 AND {a}.x1 < {b}.x1)) AND (({a}.y0 > {b}.y0 AND {a}.y0 < {b}.y1) OR ({a}.y1 > {b}.y0 AND {a}.y1 < {b}.y1))"


#: L-shaped footprints, every other one clockwise: two boxes each, for the SQL.
ELLS = """el AS (SELECT c_custkey // 12 AS site_id, c_custkey AS id, c_custkey * 37 % 90 + 0.25e0 AS x, c_custkey * 53 % 90 + 0.5e0 AS y, 20 + c_custkey % 7 * 3e0 AS w, 6 + c_custkey % 3 * 1e0 AS t FROM customer),
eb AS (SELECT site_id, id, x AS x0, y AS y0, x + w AS x1, y + t AS y1 FROM el UNION ALL SELECT site_id, id, x, y + t, x + t, y + w FROM el)"""


@query("h10_overlap_areas", f"""WITH {ELLS}, x AS (SELECT p.site_id, p.id AS a_id, q.id AS b_id, sum(greatest(0e0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0e0, least(p.y1, q.y1) - greatest(p.y0, q.y0))) AS area FROM eb p JOIN eb q ON p.site_id = q.site_id AND p.id < q.id GROUP BY ALL) SELECT site_id, a_id, b_id, {r('area')} FROM x WHERE area > 1e-9""")
def _(spark, sf_dir):
    """Overlaps of footprints that are not convex."""
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 12").alias("site_id"), k.alias("id"), (k * 37 % 90 + 0.25).alias("x"), (k * 53 % 90 + 0.5).alias("y"), (20 + k % 7 * 3.0).alias("w"), (6 + k % 3 * 1.0).alias("t"))
    x, y, w, t = (F.col(c) for c in "xywt")
    ring = G.closed([G.point(x, y), G.point(x + w, y), G.point(x + w, y + t), G.point(x + t, y + t), G.point(x + t, y + w), G.point(x, y + w)])
    return spatial.overlaps(at.select("site_id", "id", F.when(F.col("id") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring")))


@query("h11_corner_overlaps", f"WITH {ASSETS}, b AS (SELECT site_id, id, x0 + 0.3e0 AS x0, x1 + 0.3e0 AS x1, y0 + 0.3e0 AS y0, y1 + 0.3e0 AS y1 FROM a) SELECT a.site_id, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.site_id = b.site_id WHERE ({CORNER.format(a='a', b='b')}) OR ({CORNER.format(a='b', b='a')})")
def _(spark, sf_dir):
    return spatial.corner_overlaps(assets(spark, sf_dir), nudged(spark, sf_dir))


@query("h16_simplified_paths", """WITH p AS (SELECT c_custkey AS path_id, i AS seq, c_custkey % 6 + 3 AS bend, c_custkey % 2 AS steep FROM customer, range(12) t(i))
SELECT path_id, CAST(seq AS INT) AS seq FROM p WHERE steep = 1 OR seq IN (0, bend, 11)""")
def _(spark, sf_dir):
    """Right-angled paths keep their ends and the bend; on steep ground nothing is skipped."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("path_id"), (k % 6 + 3).alias("bend"), (k % 2).alias("steep"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seq"))
    path = rows.select("path_id", "seq", (10.0 * F.least("seq", "bend")).alias("x"), (10.0 * F.greatest(F.col("seq") - F.col("bend"), F.lit(0))).alias("y"), (F.col("steep") * F.col("seq") * 5.0).alias("z"))
    return paths.simplified(path, 2.0, 15.0).select("path_id", "seq")


FLOODED = """fl AS (SELECT o_orderkey % 200 AS site_id, o_orderkey AS id, list_element(['AE', 'X', 'VE', 'floodway', 'D', 'AO'], o_orderkey % 6 + 1) AS code, o_orderkey * 37 % 180 - 20 + 0e0 AS x0, o_orderkey * 53 % 180 - 20 + 0e0 AS y0, 5 + o_orderkey % 40 + 0e0 AS s FROM orders)"""


@query("j10_flood_on_sites", f"""WITH {FLOODED}, x AS (SELECT site_id, id, CASE code WHEN 'floodway' THEN 'AE' ELSE code END AS zone, greatest(0e0, least(x0 + s, 150e0) - greatest(x0, 0e0)) * greatest(0e0, least(y0 + s, 150e0) - greatest(y0, 0e0)) AS area FROM fl) SELECT site_id, id, zone, {r('area')} FROM x WHERE zone IN ('AE', 'VE', 'AO') AND area > 1""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    x, y, s = k * 37 % 180 - 20.0, k * 53 % 180 - 20.0, 5.0 + k % 40
    code = F.element_at(F.array(*[F.lit(c) for c in ("AE", "X", "VE", "floodway", "D", "AO")]), (k % 6 + 1).cast("int"))
    found = table(spark, sf_dir, "orders").select((k % 200).alias("site_id"), k.alias("id"), code.alias("code"), G.box(x, y, x + s, y + s).alias("ring"))
    every = found.select("site_id").distinct().withColumn("ring", G.box(*[F.lit(v) for v in (0.0, 0.0, 150.0, 150.0)]))
    return observations.flood_on_sites(found, every)


@query("b04_road_features", f"""WITH {SURVEYED} SELECT site_id, 'Point' AS kind, id AS "from", CAST(-1 AS BIGINT) AS "to", x AS x0, y AS y0, round(z, 6) + 0.0 AS value, id = 0 AS is_entrance FROM sv
UNION ALL SELECT ew.site_id, 'LineString', src, dst, p.x, p.y, round(weight, 6) + 0.0, false FROM ew JOIN sv p ON p.site_id = ew.site_id AND p.id = src""")
def _(spark, sf_dir):
    """The road graph as features, read back from their text."""
    own = surveyed(spark, sf_dir)
    found = roads.features(own.withColumn("is_entrance", F.col("id") == 0), roads.edges(own))
    text, line = F.col("feature"), F.get_json_object("feature", "$.geometry.type") == "LineString"
    get = lambda path: F.get_json_object(text, path)
    first = lambda k: F.when(line, get(f"$.geometry.coordinates[0][{k}]")).otherwise(get(f"$.geometry.coordinates[{k}]")).cast("double")
    return found.select(
        "site_id", get("$.geometry.type").alias("kind"), F.coalesce(get("$.properties.from"), get("$.properties.id")).cast("long").alias("from"), F.coalesce(get("$.properties.to").cast("long"), F.lit(-1)).alias("to"),
        first(0).alias("x0"), first(1).alias("y0"), F.coalesce(get("$.properties.weight"), get("$.properties.elevation")).cast("double").alias("value"), F.coalesce(get("$.properties.is_entrance").cast("boolean"), F.lit(False)).alias("is_entrance"),
    )


@query("r16_node_rows", f"""{terrain_sql()}, {NODES} SELECT nd.site_id, nd.id, coalesce(t.z, 100e0) AS z, round(coalesce(t.slope_percent, 0e0), 6) + 0.0 AS slope FROM nd LEFT JOIN t ON t.dem_id = nd.site_id AND t."row" = CAST(trunc(nd.y / 10) AS INT) AND t.col = CAST(trunc(nd.x / 10) AS INT)""")
def _(spark, sf_dir):
    return roads.node_rows(nodes(spark, sf_dir), derive(dem(spark, sf_dir), CELL), CELL).select("site_id", "id", "z", "slope")


@query("r15_road_network")
def _(spark, sf_dir):
    """Roads of every site from its first node to its assets; sites without a raster are flat."""
    own = roads.node_rows(nodes(spark, sf_dir), derive(dem(spark, sf_dir), CELL), CELL)
    gates = entrances(spark, sf_dir).join(own.select("site_id", F.col("id").alias("source"), "x", "y"), ["site_id", "source"]).select("site_id", "x", "y")
    return roads.site_network(own, gates, assets(spark, sf_dir), 25.0, 12.0)
