"""Further queries over files, features, coordinates and catalogues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotwright.functions import crs
from plotwright.functions import features as P
from plotwright.functions import geometry as G
from plotwright.operators import observations as O
from plotwright.operators import roads, spatial
from plotwright.sources import features as S
from plotwright.sources import kml
from plotwright.tables import shared_dir

from .features import CLASSES, FLOOD, POINTS, TAGS, floods, points, ways
from .files import kml_files
from .fixtures import CELL, dem, dem_sql, r, rounded, table
from .sites import ASSETS, SEGMENTS, assets, segments

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


@query("c09_geometry_transform", f"""{POINTS}, q AS (SELECT id, unnest([lon, lon + 0.01e0, lon + 0.01e0, lon]) AS lon, unnest([lat, lat, lat + 0.01e0, lat]) AS lat FROM p), m AS (SELECT id, radians(lon) * 6378137e0 AS x, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS y FROM q) SELECT id, round(min(x), 2) + 0.0 AS min_x, round(max(x), 2) + 0.0 AS max_x, round(min(y), 2) + 0.0 AS min_y, round(max(y), 2) + 0.0 AS max_y FROM m GROUP BY id""")
def _(spark, sf_dir):
    """Rings moved corner by corner to web Mercator."""
    x, y = F.col("lon"), F.col("lat")
    ring = G.closed([G.point(x, y), G.point(x + 0.01, y), G.point(x + 0.01, y + 0.01)])
    moved = F.transform(ring, lambda p: G.point(*crs.web_mercator(p["x"], p["y"])))
    b = G.bounds(moved)
    return points(spark, sf_dir).select("id", *[F.round(b[c], 2).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("c14_unit_conversion", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'feet' ELSE 'meters' END AS unit, round(p_size * CASE WHEN p_partkey % 2 = 0 THEN 0.3048e0 ELSE 1 END, 6) + 0.0 AS metres FROM part")
def _(spark, sf_dir):
    unit = P.unit_of_file(F.when(F.col("p_partkey") % 2 == 0, "dem_FT.asc").otherwise("dem_meter.asc"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), unit.alias("unit"), P.metres(F.col("p_size").cast("string"), unit).alias("metres"))


@query("c25_box_measures", f"""{POINTS}, b AS (SELECT id % 20 AS site_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM p GROUP BY 1), x AS (SELECT site_id, e - w AS width, n - s AS height, (w + e) / 2 AS cx, (s + n) / 2 AS cy, (e - w) * (n - s) AS area FROM b) SELECT site_id, {r('width', 'height', 'cx', 'cy', 'area')} FROM x""")
def _(spark, sf_dir):
    box = points(spark, sf_dir).groupBy((F.col("id") % 20).alias("site_id")).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return box.selectExpr("site_id", "e - w AS width", "n - s AS height", "(w + e) / 2 AS cx", "(s + n) / 2 AS cy", "(e - w) * (n - s) AS area")


@query("c27_crs_of_files", "SELECT CAST(c_custkey AS INT) AS id, CASE CAST(c_custkey AS INT) % 4 WHEN 0 THEN 4326 WHEN 1 THEN 32633 WHEN 2 THEN 4326 ELSE -1 END AS epsg FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int") % 4
    name = F.when(k == 0, "a.KMZ").when(k == 3, "a.txt").otherwise("a.geojson")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.coalesce(crs.by_suffix(name, F.when(k == 1, "urn:ogc:def:crs:EPSG::32633")), F.lit(-1)).alias("epsg"))


@query("d06_placemark_filters", "SELECT 'site' || s_suppkey || '.kml' AS path, CAST(1 AS BIGINT) AS n_polygons, CAST(1 AS BIGINT) AS n_points, CAST(1 AS BIGINT) AS n_boundaries FROM supplier WHERE s_suppkey % 10 <> 9")
def _(spark, sf_dir):
    found = kml.placemarks(kml_files(spark, sf_dir)).where("seq >= 0")
    contour = P.any_of(F.concat_ws(" ", "name", "description"), P.CONTOUR_WORDS)
    return found.groupBy("path").agg(F.count_if(F.col("kind") == "Polygon").alias("n_polygons"), F.count_if(F.col("kind") == "Point").alias("n_points"), F.count_if((F.col("kind") == "Polygon") & ~contour).alias("n_boundaries"))


@query("d08_boundary_folders", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf_dir):
    folders = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Layers"), F.lit("Site Boundaries"))).otherwise(F.array(F.lit("Layers"), F.lit("Roads")))
    return table(spark, sf_dir, "part").where(P.any_of(F.array_join(folders, " "), P.BOUNDARY_FOLDERS)).select(F.col("p_partkey").alias("id"))


@query("d09_boundary_keys", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 2")
def _(spark, sf_dir):
    props = F.create_map(F.when(F.col("p_partkey") % 4 == 2, "APN").otherwise("owner"), F.col("p_name"))
    keyed = F.arrays_overlap(F.transform(F.map_keys(props), F.lower), F.array(*[F.lit(k) for k in P.BOUNDARY_KEYS]))
    return table(spark, sf_dir, "part").where(keyed).select(F.col("p_partkey").alias("id"))


@query("d12_terrain_nodes", "WITH n AS (SELECT p_partkey AS id, p_size * 3 AS slope FROM part) SELECT id FROM n WHERE slope <= 100")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size") * 3 <= 100).select(F.col("p_partkey").alias("id"))


@query("f17_placemark_counts", "SELECT count(*) * 2 AS total, count(*) * 2 AS with_geometry, CAST(0 AS BIGINT) AS contours FROM supplier WHERE s_suppkey % 10 <> 9")
def _(spark, sf_dir):
    found = kml.placemarks(kml_files(spark, sf_dir)).where("seq >= 0")
    return found.agg(F.count("*").alias("total"), F.count("kind").alias("with_geometry"), F.count_if(P.any_of(F.concat_ws(" ", "name", "description"), P.CONTOUR_WORDS)).alias("contours"))


@query("h18_ring_of_way", "SELECT CAST(c_custkey AS INT) AS id, CAST(CASE WHEN CAST(c_custkey AS INT) % 3 = 0 THEN 0 ELSE 4 END AS INT) AS points, CASE WHEN CAST(c_custkey AS INT) % 3 = 0 THEN 0e0 ELSE 2e0 END AS area FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    p = lambda x, y: G.point(k * 1.0 + x, F.lit(y))
    line = F.when(k % 3 == 0, F.array(p(0.0, 0.0), p(2.0, 0.0))).when(k % 3 == 1, F.array(p(0.0, 0.0), p(2.0, 0.0), p(2.0, 2.0))).otherwise(F.array(p(0.0, 0.0), p(2.0, 0.0), p(2.0, 2.0), p(0.0, 0.0)))
    ring = F.when(F.size(line) < 3, None).when(line[0] == F.element_at(line, -1), line).otherwise(F.concat(line, F.slice(line, 1, 1)))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.coalesce(F.size(F.when(F.size(line) >= 3, ring)), F.lit(0)).alias("points"), F.coalesce(G.area(F.array(ring)), F.lit(0.0)).alias("area")).withColumn("points", F.greatest("points", F.lit(0)))


@query("k10_existing_conditions", f"WITH {TAGS} SELECT id % 7 AS site_id, {CLASSES} AS class, count(*) AS n, max(CASE m WHEN 0 THEN 3.0e0 WHEN 1 THEN 30.48e0 WHEN 2 THEN 15.24e0 WHEN 3 THEN 15.24e0 WHEN 4 THEN 30.48e0 WHEN 5 THEN 15.24e0 WHEN 6 THEN 9.14e0 WHEN 7 THEN 45.72e0 WHEN 8 THEN 30.48e0 END) AS widest FROM ways WHERE m < 9 GROUP BY ALL")
def _(spark, sf_dir):
    """Per site the features that ask for a setback, by class, and the widest of these."""
    found = O.with_setbacks(ways(spark, sf_dir)).where("class is not null")
    return found.groupBy((F.col("id") % 7).alias("site_id"), "class").agg(F.count("*").alias("n"), F.max("setback_m").alias("widest"))


@query("k20_display_rings", f"{POINTS}, z AS (SELECT *, CAST(trunc((lon + 180e0) / 6e0) AS INT) + 1 AS zone FROM p) SELECT id, CAST(4 AS INT) AS points, {r('lon', 'lat')} FROM z")
def _(spark, sf_dir):
    """Rings in UTM given back as corners in degrees, without the closing point; the first corner is told."""
    zone, north = F.col("zone"), F.col("lat") >= 0
    p = points(spark, sf_dir).withColumn("zone", ((F.col("lon") + 180.0) / 6.0).cast("int") + 1)
    e, n = crs.to_utm(F.col("lon"), F.col("lat"), zone, north)
    rows = p.withColumns({"e": e, "n": n}).withColumn("ring", G.box(F.col("e"), F.col("n"), F.col("e") + 50.0, F.col("n") + 50.0))
    corner = F.col("ring")[0]
    lon, lat = crs.from_utm(corner["x"], corner["y"], zone, north)
    return rows.select("id", F.size(F.slice("ring", 1, F.size("ring") - 1)).alias("points"), lon.alias("lon"), lat.alias("lat"))


@query("l01_elevation_at_points", f'WITH {dem_sql()}, p AS (SELECT s_suppkey AS id, s_suppkey % 4 AS dem_id, s_suppkey * 3 % 90 * 1e0 AS x, s_suppkey * 7 % 45 * 1e0 AS y FROM supplier) SELECT p.id, p.dem_id, d.z FROM p LEFT JOIN dem d ON d.dem_id = p.dem_id AND d."row" = CAST(trunc(y / 10) AS INT) AND d.col = CAST(trunc(x / 10) AS INT)')
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    at = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 4).alias("dem_id"), (k * 3 % 90 * 1.0).alias("x"), (k * 7 % 45 * 1.0).alias("y"))
    return spatial.sample(dem(spark, sf_dir), at, CELL).select("id", "dem_id", "z")


@query("p07_flood_rows", f"WITH {FLOOD} SELECT location, count(*) AS n, count(*) FILTER (code LIKE '%FLOODWAY%') AS n_floodway, count(*) FILTER (zone IN ('V', 'VE')) AS n_coastal FROM fz GROUP BY location")
def _(spark, sf_dir):
    zone = P.flood_zone(F.col("code"))
    return floods(spark, sf_dir).groupBy("location").agg(F.count("*").alias("n"), F.count_if(F.upper("code").contains("FLOODWAY")).alias("n_floodway"), F.count_if(zone.isin("V", "VE")).alias("n_coastal"))


@query("p08_rings_to_polygons", "SELECT CAST(c_custkey AS INT) AS id, (CAST(c_custkey AS INT) + 4) * 4e0 - 1e0 AS area, CAST(1 AS INT) AS holes FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    text = F.concat(F.lit('{"features":[{"geometry":{"rings":[[[0,0],['), k + 4, F.lit(",0],["), k + 4, F.lit(",4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}}]}"))
    found = S.flood_features(table(spark, sf_dir, "customer").select(k.alias("path"), text.alias("value")))
    parts = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return found.select(F.col("path").alias("id"), G.area(parts).alias("area"), (F.size(parts) - 1).alias("holes"))


@query("p12_answer_errors", "SELECT event_type AS type, count(*) FILTER (event_id % 4 <> 1) AS n_valid, count(*) FILTER (event_id % 4 = 1) AS n_errors FROM events GROUP BY 1")
def _(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 1, '{"error":{"message":"no data"}}').otherwise(F.concat(F.lit('{"value":"'), "value", F.lit('"}')))
    error = F.coalesce(F.get_json_object(text, "$.error.message"), F.get_json_object(text, "$.message"), F.get_json_object(text, "$.detail"))
    valid = F.get_json_object(text, "$.value").try_cast("double").isNotNull() & error.isNull()
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count_if(valid).alias("n_valid"), F.count_if(error.isNotNull()).alias("n_errors"))


@query("p13_metadata_subset", "SELECT c_custkey AS id, CAST(2 AS INT) AS n_kept, c_mktsegment AS units FROM customer")
def _(spark, sf_dir):
    known = ("value", "resolution", "units", "data_source", "datum", "x", "y", "message", "raster_id", "date")
    values = F.create_map(F.lit("units"), F.col("c_mktsegment"), F.lit("date"), F.lit("2020"), F.lit("internal"), F.col("c_name"))
    kept = F.map_filter(values, lambda k, v: k.isin(*known))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.size(kept).alias("n_kept"), kept["units"].alias("units"))


@query("q08_kml_checks", "SELECT 'site' || s_suppkey || '.kml' AS path, CASE WHEN s_suppkey % 10 = 9 THEN 'not well-formed' ELSE '' END AS issue FROM supplier")
def _(spark, sf_dir):
    found = kml.placemarks(kml_files(spark, sf_dir))
    return found.groupBy("path").agg(F.coalesce(F.max(F.split("error", ":")[0]), F.lit("")).alias("issue"))


@query("q11_model_ranges", f"{POINTS} SELECT count(*) FILTER (NOT (lon BETWEEN -100 AND 100)) AS bad_lon, count(*) FILTER (NOT (lat BETWEEN -60 AND 60)) AS bad_lat, count(*) AS n FROM p")
def _(spark, sf_dir):
    return points(spark, sf_dir).agg(F.count_if(~F.col("lon").between(-100.0, 100.0)).alias("bad_lon"), F.count_if(~F.col("lat").between(-60.0, 60.0)).alias("bad_lat"), F.count("*").alias("n"))


@query("r17_segment_surfaces", f"WITH {SEGMENTS}, x AS (SELECT site_id, class, sum(length * width) AS surface, max(length) AS longest FROM sg GROUP BY ALL) SELECT site_id, class, {r('surface', 'longest')} FROM x")
def _(spark, sf_dir):
    return roads.areas(segments(spark, sf_dir), 0.0).groupBy("site_id", "class").agg(F.sum("area").alias("surface"), F.max("length").alias("longest"))


@query("t03_boundary_job", "SELECT 'site' || s_suppkey || '.kml' AS path, CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END AS n_boundaries, CASE WHEN s_suppkey % 10 = 9 THEN 'error' WHEN s_suppkey % 90 > 80 THEN 'small' ELSE 'ok' END AS status FROM supplier")
def _(spark, sf_dir):
    """Files with their boundaries, an error where none can be read and a warning for small ones."""
    found = kml.placemarks(kml_files(spark, sf_dir))
    ring = F.array_compact(G.kml_coordinates(F.col("coordinates")[0]))
    east = F.array_max(F.transform(ring, lambda p: p["x"]))
    rows = found.select("path", (F.col("kind") == "Polygon").alias("is_polygon"), F.when(F.col("kind") == "Polygon", east).alias("east"), (F.col("seq") < 0).alias("failed"))
    return rows.groupBy("path").agg(F.count_if("is_polygon").cast("int").alias("n_boundaries"), F.when(F.bool_or("failed"), "error").when(F.max("east") > 84.0, "small").otherwise("ok").alias("status"))


@query("a15_upload_catalogue", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 7")
def _(spark, sf_dir):
    """Sidecar documents written as JSON and listed; those of bad names are skipped."""
    path = f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.when(k % 10 == 7, "../x").otherwise(F.concat(F.lit("u"), k)).alias("name")).write.json(path)
    return spark.read.schema("id long, status string, name string").json(path).where(~F.col("name").rlike(r"[/\\]|\.\.")).select("id", "status")


@query("a16_tile_catalogue", f"{POINTS}, t AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS south, CAST(floor(lon) AS INT) AS west FROM p) SELECT south, west FROM t WHERE south BETWEEN 0 AND 30")
def _(spark, sf_dir):
    boxes = points(spark, sf_dir).select("id", F.col("lon").alias("min_x"), F.col("lon").alias("max_x"), F.col("lat").alias("min_y"), F.col("lat").alias("max_y"))
    return O.tiles_of(boxes).where("south between 0 and 30").select("south", "west").distinct()


@query("b03_asset_features", f"WITH {ASSETS} SELECT id, site_id, 'Polygon' AS kind, CAST(type AS VARCHAR) AS type FROM a")
def _(spark, sf_dir):
    value = S.feature(S.geojson_geometry("Polygon", F.array("ring")), F.struct("id", "site_id", F.col("type").cast("string").alias("type")))
    got = lambda p: F.get_json_object("value", p)
    return assets(spark, sf_dir).select(value.alias("value")).select(got("$.properties.id").cast("long").alias("id"), got("$.properties.site_id").cast("long").alias("site_id"), got("$.geometry.type").alias("kind"), got("$.properties.type").alias("type"))


@query("b05_raster_sink", f'WITH {dem_sql()} SELECT dem_id, count(*) AS n, {r("mean")} FROM (SELECT dem_id, avg(z) AS mean FROM dem GROUP BY dem_id) JOIN dem USING (dem_id) GROUP BY dem_id, mean')
def _(spark, sf_dir):
    """A surface written by raster and read back."""
    path = f"{shared_dir(spark)}/surface-{uuid.uuid4().hex}"
    dem(spark, sf_dir).repartition("dem_id").write.partitionBy("dem_id").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("dem_id").cast("long").alias("dem_id")).agg(F.count("*").alias("n"), F.avg("z").alias("mean"))


@query("b09_export_layers", f"WITH {ASSETS} SELECT site_id, 'assets' AS layer, count(*) AS n FROM a WHERE id % 6 <> 5 GROUP BY site_id UNION ALL SELECT site_id, 'roads', count(*) FROM a WHERE id % 4 <> 3 GROUP BY site_id")
def _(spark, sf_dir):
    """Footprints and road lines as layer rows; assets without a polygon and lines of one point are dropped."""
    own = assets(spark, sf_dir)
    shapes = own.withColumn("ring", F.when(F.col("id") % 6 != 5, F.col("ring"))).where("ring is not null").select("site_id", F.lit("assets").alias("layer"))
    line = F.when(F.col("id") % 4 == 3, F.array(G.point("x", "y"))).otherwise(F.array(G.point("x", "y"), G.point(F.lit(0.0), F.lit(0.0))))
    lines = own.withColumn("line", line).where(F.size("line") >= 2).select("site_id", F.lit("roads").alias("layer"))
    return shapes.unionByName(lines).groupBy("site_id", "layer").agg(F.count("*").alias("n"))


@query("k13_position_valid", f"WITH {ASSETS} SELECT id, x0 >= -1 AND y0 >= -1 AND x1 <= 150 AND y1 <= 170 AS is_valid FROM a")
def _(spark, sf_dir):
    own = assets(spark, sf_dir)
    area = own.select("site_id").distinct().withColumn("parts", F.array(G.box(F.lit(-1.0), F.lit(-1.0), F.lit(150.0), F.lit(170.0))))
    bad = spatial.outside(own, area).select("site_id", "id", F.lit(True).alias("bad"))
    return own.join(bad, ["site_id", "id"], "left").select("id", F.col("bad").isNull().alias("is_valid"))


