"""Queries over geometries, assets, zones, layouts and roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwright.functions import geometry as G
from plotwright.operators import block_search, earthwork, graph, layout, roads, rules, spatial
from plotwright.operators.stencil import terrain as derive
from plotwright.tables import written

from .fixtures import CELL, dem, dem_sql, r, rounded, table, terrain_sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


SPAN = 200.0


def assets(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select((k % 5).alias("site_id"), k.alias("id"), (k % 4).alias("type"), (k * 37 % 200 * 1.0).alias("x"), (k * 53 % 200 * 1.0).alias("y"), (20 + k % 7 * 2.0).alias("width"), (18 + k % 5 * 1.0).alias("length"), (k % 4 * 90.0).alias("rotation"), (k % 9 * 1.0).alias("spacing"))
    return layout.placed(rows)


ASSETS = """ab AS (SELECT s_suppkey % 5 AS site_id, s_suppkey AS id, s_suppkey % 4 AS type, s_suppkey * 37 % 200 * 1e0 AS x, s_suppkey * 53 % 200 * 1e0 AS y, 20 + s_suppkey % 7 * 2e0 AS width, 18 + s_suppkey % 5 * 1e0 AS length, s_suppkey % 4 * 90e0 AS rotation, s_suppkey % 9 * 1e0 AS spacing FROM supplier),
a AS (SELECT *, x - ex AS x0, x + ex AS x1, y - ey AS y0, y + ey AS y1 FROM (SELECT *, CASE WHEN type % 2 = 1 THEN length ELSE width END / 2 AS ex, CASE WHEN type % 2 = 1 THEN width ELSE length END / 2 AS ey FROM ab))"""


def zones(spark, sf_dir):
    k = F.col("n_nationkey")
    x, y, s = k * 31 % 160 * 1.0, k * 17 % 160 * 1.0, 20 + k % 15 * 1.0
    return table(spark, sf_dir, "nation").select((k % 5).cast("long").alias("site_id"), k.alias("id"), G.box(x, y, x + s, y + s).alias("ring"), F.when(k % 3 == 0, "high").otherwise("low").alias("severity"))


ZONES = """z AS (SELECT CAST(n_nationkey % 5 AS BIGINT) AS site_id, n_nationkey AS id, n_nationkey * 31 % 160 * 1e0 AS x0, n_nationkey * 17 % 160 * 1e0 AS y0, n_nationkey * 31 % 160 + 20 + n_nationkey % 15 * 1e0 AS x1, n_nationkey * 17 % 160 + 20 + n_nationkey % 15 * 1e0 AS y1, CASE WHEN n_nationkey % 3 = 0 THEN 'high' ELSE 'low' END AS severity FROM nation)"""


def sites(spark, sf_dir):
    return assets(spark, sf_dir).select("site_id").distinct().withColumn("parts", F.array(G.box(F.lit(0.0), F.lit(0.0), F.lit(SPAN), F.lit(SPAN))))


@query("c22_footprints", f"WITH {ASSETS} SELECT site_id, id, {r('x0', 'y0', 'x1', 'y1')}, round(width * length, 6) + 0.0 AS area FROM a")
def _(spark, sf_dir):
    b = G.bounds(F.col("ring"))
    return assets(spark, sf_dir).select("site_id", "id", b["min_x"].alias("x0"), b["min_y"].alias("y0"), b["max_x"].alias("x1"), b["max_y"].alias("y1"), G.area(F.array("ring")).alias("area"))


RINGS = "WITH g AS (SELECT c_custkey AS id, c_custkey * 7 % 300 - 150 + 0.25e0 AS x, c_custkey * 11 % 140 - 70 + 0.5e0 AS y, 0.01e0 + c_custkey % 7 * 0.001e0 AS w, 0.02e0 + c_custkey % 5 * 0.001e0 AS h FROM customer)"


def rings(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w, h = k * 7 % 300 - 150 + 0.25, k * 11 % 140 - 70 + 0.5, 0.01 + k % 7 * 0.001, 0.02 + k % 5 * 0.001
    return table(spark, sf_dir, "customer").select(k.alias("id"), G.box(x, y, x + w, y + h).alias("ring"))


@query("h05_boundary_metrics", f"""{RINGS}, m AS (SELECT id, w * h * pow((cos(radians(y + h / 2)) * 111320e0 + 110574e0) / 2, 2) AS area_sqm, 2 * w * cos(radians(y + h / 2)) * 111320e0 + 2 * h * 110574e0 AS perimeter_m, x + w / 2 AS cx, y + h / 2 AS cy FROM g)
SELECT id, round(area_sqm, 0) + 0.0 AS area_sqm, round(area_sqm * 0.000247105e0, 2) + 0.0 AS acres, round(perimeter_m, 3) + 0.0 AS perimeter_m, round(perimeter_m * 3.28084e0, 2) + 0.0 AS perimeter_ft, round(cx, 5) + 0.0 AS cx, round(cy, 5) + 0.0 AS cy, CAST(4 AS INT) AS vertices FROM m""")
def _(spark, sf_dir):
    ring = F.col("ring")
    c, a, p = G.centroid(ring), G.area_sqm(ring), G.perimeter_m(ring)
    return rings(spark, sf_dir).select("id", F.round(a, 0).alias("area_sqm"), F.round(a * 0.000247105, 2).alias("acres"), F.round(p, 3).alias("perimeter_m"), F.round(p * 3.28084, 2).alias("perimeter_ft"), F.round(c["x"], 5).alias("cx"), F.round(c["y"], 5).alias("cy"), (F.size(ring) - 1).alias("vertices"))


@query("f16_parcel_metrics", f"""{RINGS}, m AS (SELECT id % 10 AS owner, w * h * pow((cos(radians(y + h / 2)) * 111320e0 + 110574e0) / 2, 2) AS a, x, y, w, h FROM g)
SELECT owner, count(*) AS n_parts, round(sum(a), 0) + 0.0 AS area_sqm, round(min(x), 6) + 0.0 AS min_x, round(max(x + w), 6) + 0.0 AS max_x, round(sum((x + w / 2) * a) / sum(a), 4) + 0.0 AS cx FROM m GROUP BY owner""")
def _(spark, sf_dir):
    ring = F.col("ring")
    rows = rings(spark, sf_dir).select((F.col("id") % 10).alias("owner"), G.area_sqm(ring).alias("a"), G.bounds(ring).alias("b"), G.centroid(ring)["x"].alias("cx"))
    return rows.groupBy("owner").agg(F.count("*").alias("n_parts"), F.round(F.sum("a"), 0).alias("area_sqm"), F.min("b.min_x").alias("min_x"), F.max("b.max_x").alias("max_x"), F.round(F.sum(F.col("cx") * F.col("a")) / F.sum("a"), 4).alias("cx"))


@query("h06_ring_checks", """WITH k AS (SELECT CAST(c_custkey AS INT) AS id, c_custkey % 5 AS kind, c_custkey % 200 + CASE c_custkey % 5 WHEN 2 THEN 1 ELSE 2 END AS far_x, c_custkey % 97 + CASE c_custkey % 5 WHEN 2 THEN 1 ELSE 2 END AS far_y FROM customer)
SELECT id, concat_ws(';', CASE kind WHEN 1 THEN 'unclosed ring' WHEN 2 THEN 'fewer than three corners' WHEN 3 THEN 'edges cross' END, CASE WHEN kind = 4 OR far_x > 180 OR far_y > 90 THEN 'coordinates out of range' END) AS issues FROM k""")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    p = lambda x, y: G.point(k % 200 * 1.0 + x, k % 97 * 1.0 + y)
    good = G.closed([p(0, 0), p(2, 0), p(2, 2), p(0, 2)])
    ring = (
        F.when(k % 5 == 0, good).when(k % 5 == 1, F.slice(good, 1, 4)).when(k % 5 == 2, F.array(p(0, 0), p(1, 1), p(0, 0))).when(k % 5 == 3, G.closed([p(0, 0), p(2, 2), p(2, 0), p(0, 2)]))
        .otherwise(G.closed([p(0, 0), G.point(F.lit(200.0), k % 97 * 1.0), p(2, 2)]))
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(G.issues(ring), ";").alias("issues"))


@query("h07_ring_repair", "SELECT c_custkey AS id, (2e0 + c_custkey % 7) * (1e0 + c_custkey % 5) AS area, CAST(5 AS INT) AS points FROM customer")
def _(spark, sf_dir):
    """Rings with a repeated corner and no closing point, or of the wrong turn."""
    k = F.col("c_custkey")
    w, h = 2.0 + k % 7, 1.0 + k % 5
    p = lambda x, y: G.point(k * 1.0 + x, k * 1.0 + y)
    zero = F.lit(0.0)
    ring = F.when(k % 2 == 0, F.array(p(zero, zero), p(zero, zero), p(w, zero), p(w, h), p(zero, h))).otherwise(G.closed([p(zero, zero), p(zero, h), p(w, h), p(w, zero)]))
    fixed = G.repaired(ring)
    return table(spark, sf_dir, "customer").select(k.alias("id"), G.signed_area(fixed).alias("area"), F.size(fixed).alias("points"))


@query("h09_point_in_polygon", """WITH p AS (SELECT c_custkey AS id, c_custkey * 7 % 211 / 10e0 AS x, c_custkey * 13 % 211 / 10e0 + 0.05e0 AS y FROM customer)
SELECT id, ((x < 20.02e0 AND y < 8.02e0) OR (x < 8.02e0 AND y < 20.02e0)) AND NOT (x > 2.02e0 AND x < 5.02e0 AND y > 2.02e0 AND y < 5.02e0) AS inside FROM p""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    c = lambda *xy: G.closed([G.point(F.lit(x), F.lit(y)) for x, y in xy])
    shell = c((-1.0, -1.0), (20.02, -1.0), (20.02, 8.02), (8.02, 8.02), (8.02, 20.02), (-1.0, 20.02))
    hole = c((2.02, 2.02), (5.02, 2.02), (5.02, 5.02), (2.02, 5.02))
    return table(spark, sf_dir, "customer").select(k.alias("id"), G.contains(F.array(shell, hole), k * 7 % 211 / 10.0, k * 13 % 211 / 10.0 + 0.05).alias("inside"))


@query("h12_boundary_distance", f"""WITH {ASSETS}, p AS (SELECT site_id, id, sqrt(pow(greatest(x0 - 100e0, 100e0 - x1, 0e0), 2) + pow(greatest(y0 - 90e0, 90e0 - y1, 0e0), 2)) AS d, least(abs(100e0 - x0), abs(100e0 - x1), abs(90e0 - y0), abs(90e0 - y1)) AS i FROM a)
SELECT site_id, id, round(CASE WHEN d > 0 THEN d ELSE i END, 6) + 0.0 AS distance FROM p""")
def _(spark, sf_dir):
    return assets(spark, sf_dir).select("site_id", "id", G.line_distance(F.lit(100.0), F.lit(90.0), F.col("ring")).alias("distance"))


@query("h13_line_measures", "SELECT CAST(c_custkey AS INT) AS id, CAST(c_custkey AS INT) + 5e0 AS length, least(CAST(c_custkey AS INT) / 2e0 + 2.5e0, 3e0) AS mx, greatest(CAST(c_custkey AS INT) / 2e0 - 0.5e0, 0e0) AS my FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int") * 1.0
    line = F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(3.0), F.lit(0.0)), G.point(F.lit(3.0), k + 2.0))
    m = G.point_at(line, 0.5)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"), G.length(line).alias("length"), m["x"].alias("mx"), m["y"].alias("my"))


@query("h15_wkt_round_trip", f"WITH {ASSETS} SELECT site_id, id, 'POLYGON' AS kind, CAST(5 AS INT) AS points, round(width * length, 6) + 0.0 AS area FROM a")
def _(spark, sf_dir):
    g = G.from_wkt(G.to_wkt(F.array("ring")))
    return assets(spark, sf_dir).withColumn("g", g).select("site_id", "id", "g.kind", F.size(F.col("g.parts")[0]).alias("points"), G.area(F.col("g.parts")).alias("area"))


@query("h01_kml_coordinates", "SELECT CAST(c_custkey AS INT) AS id, CAST((c_custkey % 190 <= 180)::INT + (c_custkey % 190 + 1 <= 180)::INT + (c_custkey % 4 <> 3 AND c_custkey % 190 <= 180)::INT AS INT) AS n_points FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    x = k % 190
    text = F.concat(x, F.lit(",1,0\n "), x + 1, F.lit(",2 "), F.when(k % 4 == 3, "200,5").otherwise(F.concat(x, F.lit(",3.5,9"))))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.size(F.array_compact(G.kml_coordinates(text))).alias("n_points"))


@query("k03_buffered_area", f"WITH {ASSETS} SELECT site_id, id, round(width * length + 2 * (width + length) * 5e0 + pi() * 25e0, 6) + 0.0 AS area FROM a")
def _(spark, sf_dir):
    return assets(spark, sf_dir).select("site_id", "id", G.buffered_area(F.col("ring"), 5.0).alias("area"))


OVERLAPS = f"""{ASSETS}, ov AS (SELECT p.site_id, p.id AS a_id, q.id AS b_id, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS area FROM a p JOIN a q ON p.site_id = q.site_id AND p.id < q.id WHERE least(p.x1, q.x1) - greatest(p.x0, q.x0) > 1e-9 AND least(p.y1, q.y1) - greatest(p.y0, q.y0) > 1e-9)"""


@query("j05_asset_overlaps", f"WITH {OVERLAPS} SELECT site_id, a_id, b_id, {r('area')} FROM ov")
def _(spark, sf_dir):
    return spatial.overlaps(assets(spark, sf_dir))


@query("j05_asset_spacing", f"""WITH {ASSETS}, d AS (SELECT p.site_id, p.id AS a_id, q.id AS b_id, p.spacing, sqrt(pow(greatest(p.x0 - q.x1, q.x0 - p.x1, 0e0), 2) + pow(greatest(p.y0 - q.y1, q.y0 - p.y1, 0e0), 2)) AS distance FROM a p JOIN a q ON p.site_id = q.site_id AND p.id < q.id)
SELECT site_id, a_id, b_id, {r('distance')} FROM d WHERE distance <= spacing AND NOT (distance = 0 AND spacing = 0 AND false)""")
def _(spark, sf_dir):
    return spatial.crowded(assets(spark, sf_dir))


@query("j06_spacing_rules", f"""WITH {ASSETS}, ru(f, t, m) AS (VALUES (0, 1, 5e0), (2, 1, 7e0), (3, 3, 9e0)), p AS (SELECT p.site_id, p.id AS a_id, q.id AS b_id, coalesce(x.m, y.m, 0e0) AS metres, sqrt(pow(greatest(p.x0 - q.x1, q.x0 - p.x1, 0e0), 2) + pow(greatest(p.y0 - q.y1, q.y0 - p.y1, 0e0), 2)) AS distance
 FROM a p JOIN a q ON p.site_id = q.site_id AND p.id < q.id LEFT JOIN ru x ON x.f = p.type AND x.t = q.type LEFT JOIN ru y ON y.f = q.type AND y.t = p.type) SELECT site_id, a_id, b_id, metres, {r('distance')} FROM p WHERE distance < metres""")
def _(spark, sf_dir):
    ru = spark.createDataFrame([(0, 1, 5.0), (2, 1, 7.0), (3, 3, 9.0)], "from_type long, to_type long, metres double")
    return spatial.rule_spacing(assets(spark, sf_dir), ru)


ON = "oz AS (SELECT a.site_id, a.id AS asset_id, z.id AS zone_id, (least(a.x1, z.x1) - greatest(a.x0, z.x0)) * (least(a.y1, z.y1) - greatest(a.y0, z.y0)) AS area, z.severity FROM a JOIN z ON a.site_id = z.site_id WHERE a.x1 > z.x0 AND z.x1 > a.x0 AND a.y1 > z.y0 AND z.y1 > a.y0)"


@query("j07_assets_on_zones", f"WITH {ASSETS}, {ZONES}, {ON} SELECT site_id, asset_id, zone_id, {r('area')} FROM oz WHERE area > 0.1")
def _(spark, sf_dir):
    return spatial.on_zones(assets(spark, sf_dir), zones(spark, sf_dir))


OUT = "ou AS (SELECT site_id, id FROM a WHERE x0 < -1e-9 OR y0 < -1e-9 OR x1 > 200.000000001e0 OR y1 > 200.000000001e0)"


@query("j08_assets_outside", f"WITH {ASSETS}, {OUT} SELECT site_id, id FROM ou")
def _(spark, sf_dir):
    return spatial.outside(assets(spark, sf_dir), sites(spark, sf_dir))


@query("k14_breaches", f"""WITH {OVERLAPS}, {ZONES}, {ON}, {OUT} SELECT site_id, a_id AS asset_id, b_id AS other, 'overlap' AS kind, 'error' AS severity FROM ov UNION ALL SELECT site_id, id, -1, 'boundary', 'error' FROM ou UNION ALL SELECT site_id, asset_id, zone_id, 'exclusion', CASE WHEN severity = 'high' THEN 'error' ELSE 'warning' END FROM oz WHERE area > 0.1""")
def _(spark, sf_dir):
    return rules.breaches(assets(spark, sf_dir), sites(spark, sf_dir), zones(spark, sf_dir)).withColumn("other", F.coalesce("other", F.lit(-1)))


def site_cells(spark, sf_dir):
    return dem(spark, sf_dir)


SHAPES = "sh AS (SELECT * FROM a WHERE site_id < 4)"
ZONAL = f"""{dem_sql()}, {ASSETS}, zo AS (SELECT d.dem_id, a.id AS shape_id, d."row", d.col, d.z FROM dem d JOIN a ON a.site_id = d.dem_id AND (d.col + 0.5e0) * 10 > a.x0 AND (d.col + 0.5e0) * 10 < a.x1 AND (d."row" + 0.5e0) * 10 > a.y0 AND (d."row" + 0.5e0) * 10 < a.y1)"""


def nudged(spark, sf_dir):
    """Assets moved off the cells' middles, so that no middle lies on an edge."""
    return layout.placed(assets(spark, sf_dir).drop("ring").withColumns({"x": F.col("x") + 0.3, "y": F.col("y") + 0.3}))


ZONAL = ZONAL.replace("> a.x0 ", "> a.x0 + 0.3e0 ").replace("< a.x1 ", "< a.x1 + 0.3e0 ").replace("> a.y0 ", "> a.y0 + 0.3e0 ").replace("< a.y1)", "< a.y1 + 0.3e0)")


@query("j04_cells_under_assets", f'WITH {ZONAL} SELECT dem_id, shape_id, "row", col, {r("z")} FROM zo')
def _(spark, sf_dir):
    return spatial.zonal(dem(spark, sf_dir), nudged(spark, sf_dir), CELL).select("dem_id", "shape_id", "row", "col", "z")


@query("f09_zonal_statistics", f"WITH {ZONAL}, x AS (SELECT dem_id, shape_id, count(*) AS n_cells, avg(z) AS mean_z, var_pop(z) AS var_z, median(z) AS median_z FROM zo GROUP BY ALL) SELECT dem_id, shape_id, n_cells, {r('mean_z', 'var_z', 'median_z')} FROM x")
def _(spark, sf_dir):
    return spatial.zonal_statistics(dem(spark, sf_dir), nudged(spark, sf_dir), CELL)


@query("l14_pad_earthwork", f"""WITH {ZONAL}, m AS (SELECT *, z - median(z) OVER (PARTITION BY dem_id, shape_id) AS d FROM zo), x AS (SELECT dem_id, shape_id, coalesce(sum(d) FILTER (d > 0), 0) * 100e0 * 1.30795e0 AS cut, coalesce(-sum(d) FILTER (d < 0), 0) * 100e0 * 1.30795e0 AS fill FROM m GROUP BY ALL), y AS (SELECT *, 15e0 * cut + 12e0 * fill AS cost FROM x)
SELECT dem_id, shape_id, {r('cut', 'fill', 'cost')} FROM y""")
def _(spark, sf_dir):
    pads = earthwork.pad_volumes(dem(spark, sf_dir), nudged(spark, sf_dir), CELL)
    return pads.withColumn("cost", 15.0 * F.col("cut") + 12.0 * F.col("fill"))



@query("j17_sample_raster", f'WITH {dem_sql()}, {ASSETS} SELECT a.id, a.site_id AS dem_id, d.z FROM a LEFT JOIN dem d ON d.dem_id = a.site_id AND d."row" = CAST(trunc(a.y / 10) AS INT) AND d.col = CAST(trunc(a.x / 10) AS INT)')
def _(spark, sf_dir):
    points = assets(spark, sf_dir).select(F.col("site_id").alias("dem_id"), "id", "x", "y")
    return spatial.sample(dem(spark, sf_dir), points, CELL).select("id", "dem_id", "z")


@query("j11_nearest_road", f"""WITH s AS (SELECT s_suppkey AS site_id, s_suppkey * 37 % 200 * 1e0 AS x, s_suppkey * 53 % 200 * 1e0 AS y FROM supplier), ro AS (SELECT s.*, n_nationkey AS seq, n_nationkey * 8e0 AS ry FROM s JOIN nation ON s.site_id % 5 = n_nationkey % 5 AND s.site_id % 10 < 9),
d AS (SELECT site_id, seq, greatest(20e0, least(x, 180e0)) AS nx, ry, sqrt(pow(x - greatest(20e0, least(x, 180e0)), 2) + pow(y - ry, 2)) AS dd FROM ro), b AS (SELECT site_id, min({{'d': dd, 'seq': seq, 'x': nx, 'y': ry}}) AS o FROM d GROUP BY site_id)
SELECT s.site_id, coalesce(o.x, x) AS entry_x, coalesce(o.y, y) AS entry_y, round(o.d, 6) + 0.0 AS distance, coalesce(o.seq, -1) AS road FROM s LEFT JOIN b ON s.site_id = b.site_id""")
def _(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    at = table(spark, sf_dir, "supplier").select(k.alias("site_id"), (k * 37 % 200 * 1.0).alias("x"), (k * 53 % 200 * 1.0).alias("y"))
    lines = table(spark, sf_dir, "nation").select((n % 5).alias("m"), n.alias("seq"), F.array(G.point(F.lit(20.0), n * 8.0), G.point(F.lit(180.0), n * 8.0)).alias("line"))
    ro = at.where("site_id % 10 < 9").select("site_id", (F.col("site_id") % 5).alias("m")).join(lines, "m").drop("m")
    return spatial.nearest_road(at, ro).withColumn("road", F.coalesce("road", F.lit(-1)))


#: Sites of sixty-four nodes; a node's height and slope are those of its part, flat where there is none.
NODES = """nd AS (SELECT site_id, CAST(r * 100000 + c AS BIGINT) AS id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, c * 25e0 AS x, r * 25e0 AS y FROM (SELECT DISTINCT p_partkey // 64 AS site_id FROM part), range(8) a(r), range(8) b(c))"""


def site_boxes(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.expr("p_partkey div 64").alias("site_id")).distinct()
    return own.withColumns({"min_x": F.lit(0.0), "min_y": F.lit(0.0), "max_x": F.lit(SPAN), "max_y": F.lit(SPAN)})


def nodes(spark, sf_dir):
    return roads.grid_nodes(site_boxes(spark, sf_dir), 25.0)


@query("r01_grid_nodes", f"""WITH {NODES}, {ZONES} SELECT site_id, id, "row", col, x, y FROM nd WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.site_id = nd.site_id AND nd.x + 0.01e0 > z.x0 AND nd.x + 0.01e0 < z.x1 AND nd.y + 0.01e0 > z.y0 AND nd.y + 0.01e0 < z.y1)""")
def _(spark, sf_dir):
    moved = nodes(spark, sf_dir).withColumns({"x": F.col("x") + 0.01, "y": F.col("y") + 0.01})
    return roads.free_nodes(moved, zones(spark, sf_dir)).withColumns({"x": F.col("x") - 0.01, "y": F.col("y") - 0.01})


@query("j13_nearest_node", f"""WITH {NODES}, {ASSETS}, d AS (SELECT a.site_id, a.id AS point_id, min({{'d': sqrt(pow(a.x - nd.x, 2) + pow(a.y - nd.y, 2)), 'n': nd.id}}) AS o FROM a JOIN nd ON a.site_id = nd.site_id GROUP BY ALL) SELECT site_id, point_id, round(o.d, 6) + 0.0 AS distance, o.n AS node_id FROM d""")
def _(spark, sf_dir):
    return spatial.nearest_node(assets(spark, sf_dir).select("site_id", "id", "x", "y"), nodes(spark, sf_dir), 10.0)


@query("j14_nodes_within", f"WITH {NODES}, {ASSETS}, d AS (SELECT a.site_id, a.id AS point_id, nd.id AS node_id, sqrt(pow(a.x - nd.x, 2) + pow(a.y - nd.y, 2)) AS distance FROM a JOIN nd ON a.site_id = nd.site_id) SELECT site_id, point_id, node_id, {r('distance')} FROM d WHERE distance <= 50")
def _(spark, sf_dir):
    return spatial.within_radius(assets(spark, sf_dir).select("site_id", "id", "x", "y"), nodes(spark, sf_dir), 50.0)


ADJ = f"""{NODES}, aj AS (SELECT p.site_id, p.id AS src, q.id AS dst FROM nd p JOIN nd q ON p.site_id = q.site_id AND p.id < q.id AND abs(p."row" - q."row") <= 1 AND abs(p.col - q.col) <= 1)"""


@query("j15_grid_adjacency", f"WITH {ADJ} SELECT site_id, src, dst FROM aj")
def _(spark, sf_dir):
    return spatial.grid_adjacency(nodes(spark, sf_dir))


def surveyed(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 0.1).alias("z"), (F.col("p_size") * 7 % 30 * 1.0).alias("slope"))
    met = nodes(spark, sf_dir).withColumn("k", F.col("site_id") * 64 + F.col("row") * 8 + F.col("col")).join(part, "k", "left").drop("k")
    return met.withColumns({"z": F.coalesce("z", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0))})


SURVEYED = f"""{ADJ}, sv AS (SELECT nd.*, coalesce(p_size * 0.1e0, 0e0) AS z, coalesce(p_size * 7 % 30 * 1e0, 0e0) AS slope FROM nd LEFT JOIN part ON p_partkey = site_id * 64 + "row" * 8 + col),
eg AS (SELECT aj.site_id, src, dst, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS length, q.z - p.z AS rise, (p.slope + q.slope) / 2 AS sl FROM aj JOIN sv p ON p.site_id = aj.site_id AND p.id = src JOIN sv q ON q.site_id = aj.site_id AND q.id = dst),
ew AS (SELECT *, abs(rise) / length * 100 AS grade, 0.3e0 * length + 0.4e0 * length * CASE WHEN sl < 8 THEN 0.5e0 WHEN sl < 15 THEN 1.5e0 WHEN sl < 25 THEN 3e0 ELSE 10e0 END + 0.3e0 * (abs(rise) * 6e0 * length * 0.01e0) AS weight FROM eg)"""


@query("r02_edge_weights", f"WITH {SURVEYED} SELECT site_id, src, dst, {r('length', 'rise', 'grade', 'weight')} FROM ew")
def _(spark, sf_dir):
    return roads.edges(surveyed(spark, sf_dir))


@query("d11_grade_filter", f"WITH {SURVEYED} SELECT site_id, src, dst, {r('grade')} FROM ew WHERE grade <= 12")
def _(spark, sf_dir):
    return roads.edges(surveyed(spark, sf_dir), 12.0).select("site_id", "src", "dst", "grade")


@query("r14_degrees", f"WITH {ADJ} SELECT site_id, node, count(*) AS degree FROM (SELECT site_id, src AS node FROM aj UNION ALL SELECT site_id, dst FROM aj) GROUP BY ALL")
def _(spark, sf_dir):
    return graph.degrees(spatial.grid_adjacency(nodes(spark, sf_dir)))


@query("f20_graph_statistics", f"WITH {ADJ}, e AS (SELECT site_id, count(*) AS n_edges FROM aj GROUP BY site_id), n AS (SELECT site_id, count(*) AS n_nodes FROM nd GROUP BY site_id) SELECT n.site_id, n_nodes, CAST(1 AS BIGINT) AS n_components, n_edges, true AS connected, round(2e0 * n_edges / n_nodes, 6) + 0.0 AS mean_degree FROM n JOIN e ON n.site_id = e.site_id")
def _(spark, sf_dir):
    own = nodes(spark, sf_dir)
    return graph.statistics(own.select("site_id", F.col("id").alias("node")), spatial.grid_adjacency(own))


def entrances(spark, sf_dir):
    return nodes(spark, sf_dir).where("row = 0 and col = 0").select("site_id", F.col("id").alias("source"))


@query("r04_least_cost_paths", f"""WITH RECURSIVE {SURVEYED}, ar AS (SELECT site_id, src AS u, dst AS v, weight FROM ew UNION ALL SELECT site_id, dst, src, weight FROM ew),
bf(site_id, node, dist, k) AS (SELECT site_id, CAST(0 AS BIGINT), 0e0, 0 FROM (SELECT DISTINCT site_id FROM nd) UNION ALL (SELECT site_id, node, min(dist) AS dist, max(k) + 1 AS k FROM (SELECT ar.site_id, ar.v AS node, bf.dist + ar.weight AS dist, bf.k FROM bf JOIN ar ON bf.site_id = ar.site_id AND bf.node = ar.u WHERE bf.k < 40 UNION ALL SELECT site_id, node, dist, k FROM bf WHERE k < 40) GROUP BY site_id, node))
SELECT site_id, node, round(min(dist), 6) + 0.0 AS dist FROM bf GROUP BY ALL""")
def _(spark, sf_dir):
    return graph.least_costs(roads.edges(surveyed(spark, sf_dir)), entrances(spark, sf_dir), block=block_search.grid_block).select("site_id", "node", "dist")


def terminals(spark, sf_dir):
    return nodes(spark, sf_dir).where("(row * 3 + col * 5 + site_id) % 13 = 0 or id = 0").select("site_id", F.col("id").alias("node"))


def network(spark, sf_dir):
    return roads.terminal_network(roads.edges(surveyed(spark, sf_dir), 12.0), terminals(spark, sf_dir), block=block_search.grid_block)


@query("r07_terminal_tree")
def _(spark, sf_dir):
    """The tree of least path length between the terminals, over edges that the grade allows."""
    return network(spark, sf_dir).tree.select("site_id", "src", "dst", F.col("length").alias("weight"))


#: Least lengths between terminals, and the sum of those edges whose ends no chain of shorter ones joins.
TREES = f"""{SURVEYED}, ar AS (SELECT site_id, src AS u, dst AS v, length FROM ew WHERE grade <= 12 UNION ALL SELECT site_id, dst, src, length FROM ew WHERE grade <= 12),
tm AS (SELECT site_id, id AS node FROM nd WHERE ("row" * 3 + col * 5 + site_id) % 13 = 0 OR id = 0),
bf(site_id, source, node, dist, k) AS (SELECT site_id, node, node, 0e0, 0 FROM tm UNION ALL (SELECT site_id, source, node, min(dist) AS dist, max(k) + 1 AS k FROM (SELECT bf.site_id, source, ar.v AS node, bf.dist + ar.length AS dist, bf.k FROM bf JOIN ar ON bf.site_id = ar.site_id AND bf.node = ar.u WHERE bf.k < 40 UNION ALL SELECT site_id, source, node, dist, k FROM bf WHERE k < 40) GROUP BY site_id, source, node)),
pr AS (SELECT bf.site_id, source AS a, bf.node AS b, round(min(dist), 6) AS l FROM bf JOIN tm ON tm.site_id = bf.site_id AND tm.node = bf.node WHERE source < bf.node GROUP BY ALL),
pe AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY l, a, b) AS o FROM pr),
jn(site_id, o, a, b, cur) AS (SELECT site_id, o, a, b, a FROM pe UNION SELECT jn.site_id, jn.o, jn.a, jn.b, CASE WHEN pe.a = jn.cur THEN pe.b ELSE pe.a END FROM jn JOIN pe ON pe.site_id = jn.site_id AND pe.o < jn.o AND (pe.a = jn.cur OR pe.b = jn.cur)),
tr AS (SELECT site_id, count(*) AS n_links, sum(l) AS length FROM pe WHERE NOT EXISTS (SELECT 1 FROM jn WHERE jn.site_id = pe.site_id AND jn.o = pe.o AND jn.cur = pe.b) GROUP BY site_id)"""


@query("r07_tree_status", f"WITH RECURSIVE {TREES} SELECT site_id, n_terminals, coalesce(n_links, 0) AS n_links, coalesce(n_links, 0) = n_terminals - 1 AS connected, round(coalesce(length, 0), 3) + 0.0 AS length FROM (SELECT site_id, count(*) AS n_terminals FROM tm GROUP BY site_id) LEFT JOIN tr USING (site_id)")
def _(spark, sf_dir):
    """Whether roads join all terminals of each site, and how long its tree is."""
    found = network(spark, sf_dir)
    whole = found.tree.groupBy("site_id").agg(F.sum("length").alias("length"))
    return found.status().join(whole, "site_id", "left").withColumn("length", F.round(F.coalesce("length", F.lit(0.0)), 3) + 0.0)


@query("r06_terminal_paths")
def _(spark, sf_dir):
    """Measures of the ways that the tree follows."""
    points = network(spark, sf_dir).paths().join(surveyed(spark, sf_dir).select("site_id", F.col("id").alias("node"), "x", "y", "z"), ["site_id", "node"])
    return roads.path_measures(points.withColumn("path_id", F.concat_ws("-", "src", "dst")))


@query("r08_star_roads", f"WITH {ASSETS} SELECT site_id, id, round(sqrt(x * x + y * y), 6) + 0.0 AS length FROM a")
def _(spark, sf_dir):
    own = assets(spark, sf_dir)
    return roads.star(own.select("site_id").distinct().withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), own)


SEGMENTS = f"""{SURVEYED}, sg AS (SELECT *, CASE WHEN src = 0 THEN 'primary' WHEN (src + dst) % 10 > 5 THEN 'secondary' ELSE 'access' END AS class, CASE WHEN src = 0 THEN 7.3e0 WHEN (src + dst) % 10 > 5 THEN 5.5e0 ELSE 3.7e0 END AS width FROM ew)"""


def segments(spark, sf_dir):
    return roads.with_width(roads.edges(surveyed(spark, sf_dir)).withColumn("class", roads.road_class(F.col("src") == 0, (F.col("src") + F.col("dst")) % 10)))


@query("r09_road_classes", f"WITH {SEGMENTS} SELECT site_id, src, dst, class, width FROM sg")
def _(spark, sf_dir):
    return segments(spark, sf_dir).select("site_id", "src", "dst", "class", "width")


@query("r11_junctions", f"""WITH {SEGMENTS}, j AS (SELECT site_id, node, count(*) AS n, 1.5e0 * max(width) AS radius FROM (SELECT site_id, src AS node, width FROM sg UNION ALL SELECT site_id, dst, width FROM sg) GROUP BY ALL HAVING count(*) >= 3)
SELECT site_id, node, n, {r('radius')}, CASE n WHEN 3 THEN 'T-junction' WHEN 4 THEN 'cross' ELSE n || '-way' END AS kind FROM j""")
def _(spark, sf_dir):
    return roads.junctions(segments(spark, sf_dir))


@query("r13_road_areas", f"WITH {SEGMENTS}, x AS (SELECT site_id, src, dst, length * width AS area, length * (width + 3e0) AS area_with_shoulders FROM sg) SELECT site_id, src, dst, {r('area', 'area_with_shoulders')} FROM x")
def _(spark, sf_dir):
    return roads.areas(segments(spark, sf_dir), 1.5).select("site_id", "src", "dst", "area", "area_with_shoulders")


@query("f19_network_statistics", f"WITH {SEGMENTS}, x AS (SELECT site_id, class, count(*) AS n, sum(length) AS length, sum(length * width) AS area, max(grade) AS max_grade, avg(grade) AS mean_grade FROM sg GROUP BY GROUPING SETS ((site_id, class), (site_id))) SELECT site_id, class, n, {r('length', 'area', 'max_grade', 'mean_grade')} FROM x")
def _(spark, sf_dir):
    return roads.network_statistics(segments(spark, sf_dir))


@query("r12_shared_points", "WITH p AS (SELECT s_suppkey % 5 AS site_id, s_suppkey * 3 % 17 / 8e0 AS x FROM supplier UNION ALL SELECT s_suppkey % 5, s_suppkey * 5 % 17 / 8e0 FROM supplier) SELECT site_id, round(x, 8) AS x, 1e0 AS y, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select((k % 5).alias("site_id"), F.array(G.point(k * 3 % 17 / 8.0, F.lit(1.0)), G.point(k * 5 % 17 / 8.0, F.lit(1.0))).alias("line"))
    return spatial.shared_points(lines)


#: Sites of twelve assets, twelve layouts each: every third one in rows with room between, the others anyhow.
LAYOUTS = f"""{ASSETS}, so AS (SELECT id // 12 AS site_id, id, type, CAST(s AS INT) AS solution_id, CASE WHEN s % 3 = 0 THEN 24 + id % 4 * 48 + s * 0.5e0 ELSE (x + s * 13) % 200 * 1e0 END AS x, CASE WHEN s % 3 = 0 THEN 25 + id % 12 // 4 * 60 + s * 0.25e0 ELSE (y + s * 29) % 200 * 1e0 END AS y, width, length, rotation, spacing, ex, ey FROM a, range(12) rg(s)),
sb AS (SELECT *, x - ex AS x0, x + ex AS x1, y - ey AS y0, y + ey AS y1 FROM so)"""


def layouts(spark, sf_dir):
    rows = assets(spark, sf_dir).drop("ring").withColumn("solution_id", F.explode(F.sequence(F.lit(0), F.lit(11))))
    s, k, apart = F.col("solution_id"), F.col("id"), F.col("solution_id") % 3 == 0
    x = F.when(apart, 24 + k % 4 * 48 + s * 0.5).otherwise((F.col("x") + s * 13) % 200)
    y = F.when(apart, 25 + F.floor(k % 12 / 4) * 60 + s * 0.25).otherwise((F.col("y") + s * 29) % 200)
    return layout.placed(rows.withColumns({"site_id": F.floor(k / 12), "x": x * 1.0, "y": y * 1.0}))


OBJECTIVES = f"""{LAYOUTS}, aw AS (SELECT *, sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2)) AS away FROM sb WINDOW w AS (PARTITION BY site_id, solution_id)),
ob AS (SELECT site_id, solution_id, count(*) AS n_assets, sum(width * length) AS area, 100e0 * (1 - least(avg(away) / 200e0, 1e0)) AS accessibility, 100e0 * greatest(0e0, 1 - sum(sqrt(x * x + y * y)) / 5000e0) AS road_length, 100e0 * least(sum(width * length) / ((max(x1) - min(x0)) * (max(y1) - min(y0))), 1e0) AS compactness FROM aw GROUP BY ALL)"""


@query("n05_objectives", f"WITH {OBJECTIVES} SELECT site_id, solution_id, n_assets, {r('area', 'accessibility', 'road_length', 'compactness')} FROM ob")
def _(spark, sf_dir):
    return layout.objectives(layouts(spark, sf_dir), (0.0, 0.0), 5000.0)


VIOLATIONS = f"""{OBJECTIVES}, {ZONES}, vp AS (SELECT p.site_id, p.solution_id, least(p.x1, q.x1) - greatest(p.x0, q.x0) > 1e-9 AND least(p.y1, q.y1) - greatest(p.y0, q.y0) > 1e-9 AS met, sqrt(pow(greatest(p.x0 - q.x1, q.x0 - p.x1, 0e0), 2) + pow(greatest(p.y0 - q.y1, q.y0 - p.y1, 0e0), 2)) <= p.spacing AS close FROM sb p JOIN sb q ON p.site_id = q.site_id AND p.solution_id = q.solution_id AND p.id < q.id),
 vi AS (SELECT site_id, solution_id FROM vp WHERE met UNION ALL SELECT site_id, solution_id FROM vp WHERE close
 UNION ALL SELECT site_id, solution_id FROM sb WHERE x0 < 4.999e0 OR y0 < 4.999e0 OR x1 > 195.001e0 OR y1 > 195.001e0 UNION ALL SELECT sb.site_id, solution_id FROM sb JOIN z ON sb.site_id % 5 = z.site_id WHERE (least(sb.x1, z.x1) - greatest(sb.x0, z.x0)) * (least(sb.y1, z.y1) - greatest(sb.y0, z.y0)) > 0.1 AND sb.x1 > z.x0 AND z.x1 > sb.x0 AND sb.y1 > z.y0 AND z.y1 > sb.y0
 UNION ALL SELECT site_id, solution_id FROM ob WHERE area * 100 / 12000 > 40), vc AS (SELECT site_id, solution_id, count(*) AS n_violations FROM vi GROUP BY ALL)"""


@query("n03_violations", f"WITH {VIOLATIONS} SELECT site_id, solution_id, n_violations FROM vc")
def n03(spark, sf_dir):
    own = layouts(spark, sf_dir)
    every = own.select("site_id").distinct()
    buildable = every.withColumn("parts", F.array(G.box(*[F.lit(v) for v in (5.0 - 1e-6, 5.0 - 1e-6, SPAN - 5.0 + 1e-6, SPAN - 5.0 + 1e-6)])))
    gone = zones(spark, sf_dir).withColumnRenamed("site_id", "k")
    return layout.violations(own, buildable, every.withColumn("k", F.col("site_id") % 5).join(F.broadcast(gone), "k").drop("k"), 12_000.0)


TERRAIN = """zt AS (SELECT sb.site_id, sb.solution_id, sb.id, var_pop(t.z) AS v, avg(t.slope_percent) AS s FROM t JOIN sb ON sb.site_id % 4 = t.dem_id AND (t.col + 0.5e0) * 10 > x0 + 0.3e0 AND (t.col + 0.5e0) * 10 < x1 + 0.3e0 AND (t."row" + 0.5e0) * 10 > y0 + 0.3e0 AND (t."row" + 0.5e0) * 10 < y1 + 0.3e0 GROUP BY ALL),
te AS (SELECT site_id, solution_id, 100e0 * greatest(0e0, 1 - avg(v) / 4e0) AS cut_fill, greatest(0e0, 1 - avg(s) / 25e0) * 60e0 + greatest(0e0, 1 - var_pop(s) / 50e0) * 40e0 AS slope_variance FROM zt GROUP BY ALL)"""
FITNESS = f"""{terrain_sql().removeprefix("WITH ")}, {VIOLATIONS}, {TERRAIN}, fi AS (SELECT ob.*, coalesce(n_violations, 0) AS n_violations, CASE WHEN n_violations > 0 THEN -10000e0 * pow(n_violations, 1.5) ELSE 0.3e0 * coalesce(cut_fill, 0) + 0.25e0 * accessibility + 0.2e0 * road_length + 0.15e0 * compactness + 0.1e0 * coalesce(slope_variance, 0) END AS fitness
 FROM ob LEFT JOIN vc ON ob.site_id = vc.site_id AND ob.solution_id = vc.solution_id LEFT JOIN te ON ob.site_id = te.site_id AND ob.solution_id = te.solution_id)"""


@query("n04_terrain_objectives", f"{terrain_sql()}, {LAYOUTS}, {TERRAIN} SELECT site_id, solution_id, {r('cut_fill', 'slope_variance')} FROM te")
def n04(spark, sf_dir):
    moved = layout.placed(layouts(spark, sf_dir).drop("ring").withColumns({"x": F.col("x") + 0.3, "y": F.col("y") + 0.3, "raster": F.col("site_id") % 4}))
    return layout.terrain_objectives(moved, derive(dem(spark, sf_dir), CELL), CELL, "raster")


def scored(spark, sf_dir):
    """Every layout's objectives, breaches and fitness, written once for all that rank them."""
    key = ["site_id", "solution_id"]
    found = layout.objectives(layouts(spark, sf_dir), (0.0, 0.0), 5000.0).join(n03(spark, sf_dir).hint("merge"), key, "left").join(n04(spark, sf_dir).hint("merge"), key, "left")
    found = found.withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    return written(found.withColumn("fitness", layout.fitness({k: F.col(k) for k in layout.WEIGHTS}, F.col("n_violations"))), "scored")


@query("n09_fitness", f"WITH {FITNESS} SELECT site_id, solution_id, n_violations, {r('fitness')} FROM fi")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("site_id", "solution_id", "n_violations", "fitness")


@query("n10_alternatives", f"""WITH {FITNESS}, be AS (SELECT site_id, arg_max(solution_id, (fitness, -solution_id)) AS solution_id FROM fi GROUP BY site_id), di AS (SELECT p.site_id, p.solution_id, least(avg(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) + abs(p.rotation - q.rotation) / 10) / 100, 1e0) AS diversity FROM sb p JOIN be ON be.site_id = p.site_id JOIN sb q ON q.site_id = p.site_id AND q.id = p.id AND q.solution_id = be.solution_id GROUP BY ALL),
mx AS (SELECT fi.site_id, fi.solution_id, row_number() OVER (PARTITION BY fi.site_id ORDER BY 0.7e0 * fitness + 0.3e0 * diversity * 100 DESC, fi.solution_id) AS place FROM fi JOIN di ON fi.site_id = di.site_id AND fi.solution_id = di.solution_id WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.site_id = fi.site_id AND be.solution_id = fi.solution_id))
SELECT site_id, solution_id, CAST(0 AS INT) AS place FROM be UNION ALL SELECT site_id, solution_id, place FROM mx WHERE place <= 3""")
def _(spark, sf_dir):
    return layout.alternatives(scored(spark, sf_dir), layouts(spark, sf_dir), 3)


@query("n12_elite", f"WITH {FITNESS}, p AS (SELECT site_id, solution_id, row_number() OVER (PARTITION BY site_id ORDER BY fitness DESC, solution_id) AS place, count(*) OVER (PARTITION BY site_id) AS n FROM fi) SELECT site_id, solution_id, place FROM p WHERE place <= ceil(n * 0.2e0)")
def _(spark, sf_dir):
    return layout.elite(scored(spark, sf_dir), 0.2).select("site_id", "solution_id", "place")


@query("n13_coverage", f"WITH {OBJECTIVES}, x AS (SELECT site_id, solution_id, area, area * 100 / 40000e0 AS percent FROM ob) SELECT site_id, solution_id, {r('area', 'percent')} FROM x")
def _(spark, sf_dir):
    return layout.objectives(layouts(spark, sf_dir), (0.0, 0.0)).select("site_id", "solution_id", "area", (F.col("area") * 100.0 / (SPAN * SPAN)).alias("percent"))


DRAWN = "CAST('0x' || substr(md5('42|' || site_id || '|' || solution_id || '|' || id || '|{k}'), 1, 8) AS BIGINT) / 4294967296e0"


@query("n02_candidates", f"""WITH {ASSETS}, c AS (SELECT site_id, id, width, length, CAST(s AS INT) AS solution_id FROM a, range(10) rg(s)), x AS (SELECT site_id, id, width, length, solution_id, {DRAWN.format(k=1)} * 200e0 AS x, {DRAWN.format(k=2)} * 200e0 AS y, floor({DRAWN.format(k=3)} * 4) * 90e0 AS rotation FROM c)
SELECT site_id, id, width, length, solution_id, {r('x', 'y', 'rotation')} FROM x""")
def _(spark, sf_dir):
    return layout.candidates(assets(spark, sf_dir).select("site_id", "id", "width", "length"), 10, SPAN)


@query("n12_tournament", f"""WITH {FITNESS}, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY md5('42|' || solution_id), solution_id) // 4 AS "group" FROM fi) SELECT site_id, "group", arg_max(solution_id, (fitness, -solution_id)) AS solution_id FROM p GROUP BY ALL""")
def _(spark, sf_dir):
    return layout.tournament(scored(spark, sf_dir), 4)


@query("n01_asset_rows", """WITH c AS (SELECT CAST(CAST(c_custkey AS INT) % 5 AS INT) AS site_id, c_name || CASE WHEN CAST(c_custkey AS INT) % 2 = 0 THEN '' ELSE 'x' END AS n, CASE WHEN CAST(c_custkey AS INT) % 2 = 0 THEN 'parking' ELSE 'building' END AS type, CAST(c_custkey AS INT) % 4 AS q, 50e0 + CAST(c_custkey AS INT) AS w, 40e0 AS l, CAST(c_custkey AS INT) AS k FROM customer)
SELECT site_id, type || '_' || i AS asset_id, type, round(w * 0.3048e0, 6) + 0.0 AS width, round(l * 0.3048e0, 6) + 0.0 AS length, CASE WHEN type = 'parking' THEN greatest(1, CAST(floor(w * 0.3048e0 * l * 0.3048e0 / 25) AS INT)) ELSE 0 END AS spaces FROM c, range(3) t(i) WHERE i < q""")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    configs = table(spark, sf_dir, "customer").select((k % 5).alias("site_id"), F.when(k % 2 == 0, "parking").otherwise("building").alias("type"), (k % 4).alias("quantity"), (50.0 + k).alias("width_ft"), F.lit(40.0).alias("length_ft"))
    return layout.expanded(configs.where("quantity > 0")).withColumn("spaces", F.coalesce("spaces", F.lit(0)))


@query("k04_setback_rows", """WITH f AS (SELECT CAST(c_custkey AS INT) AS id, list_element(['property', 'road', 'water', 'utility', 'building'], CAST(c_custkey AS INT) % 5 + 1) AS kind, list_element(['front', 'major', 'river', 'gas_line', 'x', 'side', 'local', 'lake', 'y', 'z'], CAST(c_custkey AS INT) % 10 + 1) AS subkind FROM customer)
SELECT id, kind, subkind, CASE kind WHEN 'property' THEN CASE subkind WHEN 'front' THEN 7.62e0 ELSE 4.57e0 END WHEN 'road' THEN CASE subkind WHEN 'major' THEN 30.48e0 ELSE 15.24e0 END WHEN 'water' THEN CASE subkind WHEN 'river' THEN 45.72e0 ELSE 30.48e0 END WHEN 'utility' THEN 9.14e0 ELSE 3e0 END AS distance_m, 'blocking' AS severity, CASE WHEN kind = 'water' THEN 'critical' ELSE 'high' END AS priority FROM f""")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), k % n + 1)
    return rules.setback_rows(table(spark, sf_dir, "customer").select(k.alias("id"), pick(("property", "road", "water", "utility", "building"), 5).alias("kind"), pick(("front", "major", "river", "gas_line", "x", "side", "local", "lake", "y", "z"), 10).alias("subkind")))


@query("k08_standard_setbacks", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 3e0 ELSE 10e0 END AS distance_m, 'blocking' AS severity, 'high' AS priority FROM customer")
def _(spark, sf_dir):
    """Features of kinds that have no table of their own, or of none, keep the standard distance."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "fence").when(k % 3 == 1, "building").alias("kind"), F.lit("major").alias("subkind"))
    return rules.setback_rows(rows).select("id", "distance_m", "severity", "priority")


STAGES = f"""{dem_sql()}, ce AS (SELECT *, (col + 0.5e0) * 10 AS cx, ("row" + 0.5e0) * 10 AS cy FROM dem),
st AS (SELECT *, cx < 92 AND cy < 151 AS in_site, least(cx + 1, 92 - cx, cy + 1, 151 - cy) >= 12 AND cx < 92 AND cy < 151 AS off_setback, cx > 11 AND cx < 81 AND cy > 21 AND cy < 141 AS in_zone, NOT (cx > 31 AND cx < 52 AND cy > 31 AND cy < 73) AS not_excluded FROM ce)"""


@query("k12_stage_areas", f"""WITH {STAGES}, x AS (SELECT dem_id, count(*) FILTER (in_site) * 100e0 AS after_in_site, count(*) FILTER (in_site AND off_setback) * 100e0 AS after_off_setback, count(*) FILTER (in_site AND off_setback AND in_zone) * 100e0 AS after_in_zone, count(*) FILTER (in_site AND off_setback AND in_zone AND not_excluded) * 100e0 AS after_not_excluded FROM st GROUP BY dem_id) SELECT *, 'there is room' AS hint FROM x""")
def _(spark, sf_dir):
    return rules.stage_areas(staged(spark, sf_dir), CELL)


@query("k11_buildable_cells", f'WITH {STAGES} SELECT dem_id, "row", col FROM st WHERE in_site AND off_setback AND in_zone AND not_excluded')
def _(spark, sf_dir):
    return staged(spark, sf_dir).where("in_site and off_setback and in_zone and not_excluded").select("dem_id", "row", "col")


def staged(spark, sf_dir):
    cells = dem(spark, sf_dir)
    own = cells.select(F.col("dem_id").alias("site_id")).distinct()
    ring = lambda x0, y0, x1, y1: G.box(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))
    zone = own.select("site_id", F.lit(1).alias("id"), ring(11.0, 21.0, 81.0, 141.0).alias("ring"))
    gone = own.select("site_id", F.lit(2).alias("id"), ring(31.0, 31.0, 52.0, 73.0).alias("ring"))
    return rules.stages(cells, ring(-1.0, -1.0, 92.0, 151.0), 12.0, zone, gone, CELL)


@query("k17_constraint_rules", """SELECT o_orderkey AS id, array_to_string([v for v in [CASE WHEN o_orderkey % 4 = 0 AND o_totalprice > 200000 THEN 'setback over a kilometre' END, CASE WHEN o_orderkey % 4 = 1 AND o_orderstatus = 'F' THEN 'exclusion without a reason' END, CASE WHEN o_orderkey % 4 = 1 AND o_orderstatus <> 'O' THEN 'exclusion does not block' END, CASE WHEN o_orderkey % 4 = 2 AND o_orderstatus = 'F' THEN 'regulation without a reference' END,
 CASE WHEN o_orderkey % 4 = 2 AND o_orderstatus = 'P' THEN 'regulation of low severity' END, CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 500 > 365 THEN 'not verified for a year' END, CASE WHEN o_orderkey % 4 = 3 AND o_orderpriority = '1-URGENT' THEN 'user rule marked critical' END] if v IS NOT NULL], ';') AS issues FROM orders""")
def _(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("setback", "exclusion", "regulatory", "user")]), (k % 4).cast("int") + 1)
    text = F.when(s == "F", F.when(k % 8 < 4, " ")).otherwise("given")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), kind.alias("kind"), (F.col("o_totalprice") / 200.0).alias("distance_m"), text.alias("reason"), text.alias("reference"), F.when(s == "O", "blocking").when(s == "P", "low").otherwise("warning").alias("severity"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("low").alias("priority"), (k % 500).alias("verified_days"))
    return rows.select("id", F.array_join(rules.constraint_rules(rows), ";").alias("issues"))


@query("t06_cell_set_algebra", f"""WITH {dem_sql()}, p AS (SELECT dem_id, "row", col FROM dem WHERE z > 5), q AS (SELECT dem_id, "row", col FROM dem WHERE col < 5) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM p UNION SELECT * FROM q) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM q) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q)""")
def _(spark, sf_dir):
    cells = dem(spark, sf_dir)
    p, q = (cells.where(c).select("dem_id", "row", "col") for c in ("z > 5", "col < 5"))
    rows = [(name, df) for name, df in (("union", p.union(q).distinct()), ("intersection", p.intersect(q)), ("difference", p.exceptAll(q)))]
    counted = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, df in rows]
    return counted[0].union(counted[1]).union(counted[2])
