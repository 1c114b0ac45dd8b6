"""Queries over files and streams that Spark makes from the given tables, and report tables."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from plotwright import streaming
from plotwright.functions import features as P
from plotwright.functions import geometry as G
from plotwright.operators import earthwork, raster
from plotwright.sources import asciigrid, features as S
from plotwright.sources import grids, kml
from plotwright.tables import shared_dir

from .fixtures import CELL, dem, dem_sql, gaps_sql, r, rounded, table, with_gaps
from .sites import ASSETS, SEGMENTS, assets, segments
from .zones import VOLUMES, site_volumes

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


@query("a01_ascii_grids", f'WITH {dem_sql()}, {gaps_sql()} SELECT dem_id, "row", col, {r("z")} FROM gaps')
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/grids-{uuid.uuid4().hex}"
    grids.write(with_gaps(dem(spark, sf_dir)), path, CELL)
    return grids.scan(spark, path)[0].withColumn("dem_id", F.col("dem_id").cast("long"))


@query("a01_grid_headers", f'WITH {dem_sql()} SELECT dem_id, max(col) + 1 AS width, max("row") + 1 AS height, 10e0 AS cell, 0e0 AS min_x, 0e0 AS min_y, -9999e0 AS nodata, \'\' AS issues FROM dem GROUP BY dem_id')
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/grids-{uuid.uuid4().hex}"
    grids.write(dem(spark, sf_dir), path, CELL)
    return grids.scan(spark, path)[1].withColumns({"dem_id": F.col("dem_id").cast("long"), "issues": F.array_join("issues", ";")})


@query("a03_indexed_window", f'WITH {dem_sql()}, {gaps_sql()} SELECT dem_id, "row", col, {r("z")} FROM gaps WHERE "row" BETWEEN 2 AND 6 AND col BETWEEN 3 AND 7')
def _(spark, sf_dir):
    """Grid files read through their line index; the window's filters reach the reader."""
    path = f"{shared_dir(spark)}/grids-{uuid.uuid4().hex}"
    grids.write(with_gaps(dem(spark, sf_dir)), path, CELL)
    cells = asciigrid.load(spark, path, asciigrid.line_index(spark, path, f"{path}-lines", 4096))
    return cells.where(F.col("row").between(2, 6) & F.col("col").between(3, 7)).withColumn("dem_id", F.col("dem_id").cast("long"))


def kml_files(spark, sf_dir):
    """A KML document a supplier: a parcel with a hole in a folder, a point, and for some a fault."""
    k = F.col("s_suppkey")
    ring = lambda a, b: F.concat(*[x for p in ((a, a), (b, a), (b, b), (a, b), (a, a)) for x in (k % 90 + p[0], F.lit(","), k % 45 + p[1], F.lit(",0 "))])
    part = lambda side, body: F.concat(F.lit(f"<{side}><LinearRing><coordinates>"), body, F.lit(f"</coordinates></LinearRing></{side}>"))
    parcel = F.concat(F.lit('<Folder><name>Site parcels</name><Placemark id="p"><name>Property Boundary</name><ExtendedData><Data name="APN"><value>'), k, F.lit("</value></Data></ExtendedData><Polygon>"), part("outerBoundaryIs", ring(F.lit(0.0), 3.0 + k % 5)), part("innerBoundaryIs", ring(1.0, 2.0)), F.lit("</Polygon></Placemark></Folder>"))
    spot = F.concat(F.lit("<Placemark><name>"), "s_name", F.lit("</name><Point><coordinates>"), k % 90, F.lit(","), k % 45, F.lit("</coordinates></Point></Placemark>"))
    end = F.when(k % 10 == 9, "<oops>").otherwise("")
    body = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), parcel, spot, end, F.lit("</Document></kml>"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("site"), k, F.lit(".kml")).alias("path"), body.cast("binary").alias("content"))


@query("a05_kml_placemarks", """SELECT 'site' || s_suppkey || '.kml' AS path, 'Polygon' AS kind, 'Property Boundary' AS name, CAST(2 AS INT) AS n_rings, '' || s_suppkey AS apn, 'Site parcels' AS folder, false AS failed FROM supplier WHERE s_suppkey % 10 <> 9
UNION ALL SELECT 'site' || s_suppkey || '.kml', 'Point', s_name, 1, '', '', false FROM supplier WHERE s_suppkey % 10 <> 9 UNION ALL SELECT 'site' || s_suppkey || '.kml', '', '', 0, '', '', true FROM supplier WHERE s_suppkey % 10 = 9""")
def _(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit(""))
    return kml.placemarks(kml_files(spark, sf_dir)).select("path", blank("kind").alias("kind"), blank("name").alias("name"), F.coalesce(F.size("coordinates"), F.lit(0)).alias("n_rings"), blank(F.try_element_at("properties", F.lit("APN"))).alias("apn"), blank(F.array_join("folders", "/")).alias("folder"), (F.col("seq") < 0).alias("failed"))


@query("h02_kml_polygons", "SELECT 'site' || s_suppkey || '.kml' AS path, pow(3 + s_suppkey % 5, 2) - 1e0 AS area FROM supplier WHERE s_suppkey % 10 <> 9")
def _(spark, sf_dir):
    found = kml.placemarks(kml_files(spark, sf_dir)).where("kind = 'Polygon'")
    return found.select("path", G.area(F.transform("coordinates", lambda c: F.array_compact(G.kml_coordinates(c)))).alias("area"))


@query("t02_boundary_strategies", "SELECT 'site' || s_suppkey || '.kml' AS path, 'name' AS strategy, 'Property Boundary' AS name FROM supplier WHERE s_suppkey % 10 <> 9")
def _(spark, sf_dir):
    return boundaries(kml_files(spark, sf_dir))


def cascade_files(spark, sf_dir):
    """Files whose boundary only the name, a key, the folder or the size tells; the others hold a smaller polygon that no rule names."""
    k = F.col("s_suppkey")
    polygon = lambda name, side, data="": F.concat(F.lit("<Placemark><name>"), name, F.lit("</name>"), F.lit(data), F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 "), side, F.lit(",0 "), side, F.lit(","), side, F.lit(" 0,"), side, F.lit(" 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    key = f'<ExtendedData><Data name="{sorted(P.BOUNDARY_KEYS)[0].upper()}"><value>7</value></Data></ExtendedData>'
    folder = F.concat(F.lit("<Folder><name>The parcels</name>"), polygon(F.lit("lot"), k % 9 + 1), F.lit("</Folder>"))
    told = F.when(k % 4 == 0, polygon(F.lit("Property Boundary"), k % 9 + 1)).when(k % 4 == 1, polygon(F.lit("lot"), k % 9 + 1, key)).when(k % 4 == 2, folder).otherwise(polygon(F.lit("wide"), k % 9 + 20))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("site"), k, F.lit(".kml")).alias("path"), F.concat(F.lit("<kml><Document>"), polygon(F.lit("shed"), F.lit(12)), told, F.lit("</Document></kml>")).cast("binary").alias("content"))


@query("t02_boundary_cascade", """SELECT 'site' || s_suppkey || '.kml' AS path, list_element(['name', 'key', 'folder', 'largest'], s_suppkey % 4 + 1) AS strategy, list_element(['Property Boundary', 'lot', 'lot', 'wide'], s_suppkey % 4 + 1) AS name, pow(CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey % 9 + 20 ELSE s_suppkey % 9 + 1 END, 2) AS area FROM supplier""")
def _(spark, sf_dir):
    return boundaries(cascade_files(spark, sf_dir), "area")


def boundaries(files, *more):
    """Of each file the placemarks that the first strategy with any match finds: name, key, folder, else the largest polygon."""
    found = kml.placemarks(files).where("kind = 'Polygon'")
    keyed = F.exists(F.map_keys("properties"), lambda k: F.lower(k).isin(*P.BOUNDARY_KEYS))
    rank = F.when(P.any_of(F.col("name"), P.BOUNDARY_NAMES), 0).when(keyed, 1).when(P.any_of(F.array_join("folders", " "), P.BOUNDARY_FOLDERS), 2).otherwise(3)
    ranked = found.withColumns({"rank": rank, "area": G.area(F.transform("coordinates", lambda c: F.array_compact(G.kml_coordinates(c))))})
    best = ranked.groupBy("path").agg(F.min("rank").alias("first"), F.max("area").alias("largest"))
    kept = ranked.join(best, "path").where("rank = first and (rank < 3 or area = largest)")
    return kept.select("path", F.element_at(F.array(F.lit("name"), F.lit("key"), F.lit("folder"), F.lit("largest")), F.col("rank") + 1).alias("strategy"), "name", *more)


def kmz_files(spark, sf_dir):
    def pack(frames):
        for pdf in frames:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                n, held = int(p[4:-4]), io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("files/icon.png", b"png")
                    if n % 7:
                        z.writestr("other.kml", b"<kml/>")
                        z.writestr("in/doc.kml", bytes(c))
                out.append(held.getvalue() if n % 11 else b"broken")
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    return kml_files(spark, sf_dir).mapInPandas(pack, "path string, content binary")


@query("a08_kmz_placemarks", "SELECT 'site' || s_suppkey || '.kml' AS path, count(*) AS n FROM supplier, range(2) WHERE s_suppkey % 10 <> 9 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 GROUP BY 1")
def _(spark, sf_dir):
    return kml.placemarks(kml.documents(kmz_files(spark, sf_dir))).where("seq >= 0").groupBy("path").agg(F.count("*").alias("n"))


@query("a09_archive_listing", "SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'corrupt' ELSE k END AS kind, count(*) AS n FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 11 = 0 THEN ['x'] WHEN s_suppkey % 7 = 0 THEN ['image'] ELSE ['image', 'kml', 'kml'] END) AS k FROM supplier) GROUP BY 1")
def _(spark, sf_dir):
    return kml.archive_entries(kmz_files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("q09_archive_checks", "SELECT 'site' || s_suppkey || '.kml' AS path, CASE WHEN s_suppkey % 11 = 0 THEN 'corrupt archive' WHEN s_suppkey % 7 = 0 THEN 'no KML' ELSE 'several KML files' END AS issues FROM supplier")
def _(spark, sf_dir):
    return kml.archive_checks(kmz_files(spark, sf_dir)).select("path", F.array_join("issues", ";").alias("issues"))


def geojson_files(spark, sf_dir):
    k = F.col("s_suppkey")
    ring = F.concat(F.lit("[[0,0],["), k + 1, F.lit(",0],["), k + 1, F.lit(",2],[0,2],[0,0]]"))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]}"))
    of = lambda g: F.concat(F.lit('{"type":"Feature","properties":{"n":"1"},"geometry":'), g, F.lit("}"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), of(polygon), F.lit(","), of(multi), F.lit("]}"))
    return table(spark, sf_dir, "supplier").select(k.alias("path"), F.when(k % 3 == 0, whole).when(k % 3 == 1, of(polygon)).otherwise(F.when(k % 2 == 0, polygon).otherwise(multi)).alias("value"))


@query("a10_geojson_polygons", "SELECT s_suppkey AS path, count(*) AS n, sum((s_suppkey + 1) * 2e0) AS area FROM supplier, range(3) t(i) WHERE i < CASE WHEN s_suppkey % 3 = 0 THEN 3 WHEN s_suppkey % 3 = 1 OR s_suppkey % 2 = 0 THEN 1 ELSE 0 END GROUP BY 1")
def _(spark, sf_dir):
    return S.geojson_polygons(geojson_files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"), F.sum(G.area(F.col("parts"))).alias("area"))


@query("a11_map_elements", "SELECT 'node' AS type, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS refs FROM supplier UNION ALL SELECT 'way', count(*), CAST(sum(s_suppkey + 1000) AS BIGINT), CAST(sum(2) AS BIGINT) FROM supplier")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    value = F.concat(F.lit('{"elements":[{"type":"node","id":'), k, F.lit(',"lon":1.5,"lat":2.5},{"type":"way","id":'), k + 1000, F.lit(',"nodes":['), k, F.lit(","), k, F.lit('],"tags":{"highway":"track"}}]}'))
    return S.elements(table(spark, sf_dir, "supplier").select(value.alias("value"))).groupBy("type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.coalesce(F.size("nodes"), F.lit(0))).alias("refs"))


@query("a12_flood_features", "SELECT s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'AE' ELSE 'X' END AS zone, CAST(s_suppkey AS DOUBLE) AS bfe, 4e0 AS area FROM supplier")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    value = F.concat(F.lit('{"features":[{"attributes":{"FLD_ZONE":"'), F.when(k % 2 == 0, "ae").otherwise("x"), F.lit('","STATIC_BFE":"+'), k, F.lit('"},"geometry":{"rings":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}}]}'))
    found = S.flood_features(table(spark, sf_dir, "supplier").select(k.alias("path"), value.alias("value")))
    ring = F.transform(F.col("rings")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return found.select("path", P.flood_zone(F.col("FLD_ZONE")).alias("zone"), P.number(F.col("STATIC_BFE")).alias("bfe"), G.area(F.array(ring)).alias("area"))


@query("a13_elevation_answers", "SELECT user_id AS query_id, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS n_answered FROM events GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("ordinal"), F.concat(F.lit('{"value":"'), "value", F.lit('"}')).alias("value"))
    return S.elevation_answers(rows.drop("value"), rows.where("ordinal % 3 <> 0")).groupBy("query_id").agg(F.count("*").alias("n"), F.count("z").alias("n_answered"))


@query("a14_project_documents", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS budget FROM customer")
def _(spark, sf_dir):
    """Project documents written as JSON lines and scanned with their schema."""
    path = f"{shared_dir(spark)}/projects-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("site"), F.col("c_acctbal").alias("budget")).write.json(path)
    return spark.read.schema("id long, site struct<name:string,segment:string>, budget double").json(path).select("id", "site.name", "site.segment", "budget")


@query("b01_geojson_collections", f"""WITH {ASSETS} SELECT site_id, count(*) AS n_features, 'urn:ogc:def:crs:EPSG::32610' AS crs FROM a GROUP BY site_id""")
def _(spark, sf_dir):
    f = S.feature(S.geojson_geometry("Polygon", F.array("ring")), F.struct("id", F.lit("assets").alias("layer")))
    whole = S.collections(assets(spark, sf_dir).select("site_id", F.lit("assets").alias("layer"), F.col("id").alias("seq"), f.alias("feature")), 32610)
    features = F.from_json("value", S.GEOJSON)["features"]
    return whole.select("site_id", F.size(features).cast("long").alias("n_features"), F.get_json_object("value", "$.crs.properties.name").alias("crs"))


@query("b02_geojson_round_trip", f"WITH {ASSETS} SELECT id, round(width * length, 6) + 0.0 AS area FROM a")
def _(spark, sf_dir):
    texts = assets(spark, sf_dir).select(F.col("id").alias("path"), S.feature(S.geojson_geometry("Polygon", F.array("ring")), F.struct("site_id")).alias("value"))
    return S.geojson_polygons(texts).select(F.col("path").alias("id"), G.area(F.col("parts")).alias("area"))


@query("q13_upload_checks", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'extension' WHEN 1 THEN 'type' WHEN 2 THEN 'leading bytes' WHEN 3 THEN 'name' ELSE '' END AS issue FROM supplier")
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "a.exe").when(k % 5 == 3, "../a.kml").otherwise("a.kmz")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("name"), F.when(k % 5 == 2, "none").otherwise("PK\x03\x04x").cast("binary").alias("content"), F.when(k % 5 == 1, "text/plain").otherwise("application/zip").alias("mime"))
    return rows.select("id", F.coalesce(S.upload_issues(rows), F.lit("")).alias("issue"))


# --- streams


def events(spark, sf_dir):
    return streaming.source(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status"), "value")


@query("s01_fresh_observations", "SELECT DISTINCT user_id AS key FROM events")
def _(spark, sf_dir):
    """Keys seen, each once: with one batch of input the time to live does not run out."""
    return streaming.run(streaming.fresh(events(spark, sf_dir), "30 days"), "fresh").select("key")


def in_batches(spark, sf_dir):
    own = streaming.in_batches(spark, table(spark, sf_dir, "events"), "ts", 3)
    return own.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status"), "value")


@query("s01_fresh_again", """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts FROM events), f(key, ts) AS (SELECT key, min(ts) FROM e GROUP BY key UNION ALL (SELECT f.key, min(e.ts) AS ts FROM f JOIN e ON e.key = f.key AND e.ts >= f.ts + INTERVAL 2 DAY GROUP BY f.key, f.ts)),
g AS (SELECT f.key, f.ts, min(e.id) AS id FROM f JOIN e ON e.key = f.key AND e.ts = f.ts GROUP BY ALL) SELECT key, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM g""")
def _(spark, sf_dir):
    """Observations of three batches that find none of their key younger than two days."""
    with streaming.keyed_state(spark):
        found = streaming.run(streaming.fresh_again(in_batches(spark, sf_dir), "2 days"), "again")
    return found.select("key", "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("s04_live_state", """WITH e AS (SELECT user_id AS key, event_id AS id, ts, event_type AS status, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
c AS (SELECT *, sum(CASE WHEN ts > p + INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, id) AS visit FROM e),
l AS (SELECT key, max(visit) AS visit FROM c GROUP BY key)
SELECT c.key, arg_max(status, (ts, id)) AS status, round(max(value), 6) + 0.0 AS most, count(*) AS n FROM c JOIN l ON l.key = c.key AND l.visit = c.visit GROUP BY c.key""")
def _(spark, sf_dir):
    """The latest state of each key since it was last idle for two days, over three batches."""
    with streaming.keyed_state(spark):
        found = streaming.run(streaming.live_state(in_batches(spark, sf_dir), "2 days"), "live", "update")
    last = F.max_by(F.struct("status", "most", "n"), "batch").alias("o")
    return found.groupBy("key").agg(last).select("key", "o.*")


ZONE_BOXES = "z AS (SELECT n_nationkey % 5 AS site_id, n_nationkey AS id, n_nationkey * 31 % 160 * 1e0 AS x0, n_nationkey * 17 % 160 * 1e0 AS y0 FROM nation)"


@query("s02_checked_moves", f"WITH {ZONE_BOXES}, m AS (SELECT event_id AS id, user_id % 5 AS site_id, event_id * 7 % 200 * 1e0 AS x, event_id * 11 % 200 * 1e0 AS y FROM events) SELECT m.id, coalesce(z.id, -1) AS zone_id, z.id IS NULL AS is_valid FROM m LEFT JOIN z ON m.site_id = z.site_id AND x BETWEEN x0 AND x0 + 30 AND y BETWEEN y0 AND y0 + 30")
def _(spark, sf_dir):
    n = F.col("n_nationkey")
    zones = table(spark, sf_dir, "nation").select((n % 5).alias("site_id"), n.alias("id"), (n * 31 % 160 * 1.0).alias("x0"), (n * 17 % 160 * 1.0).alias("y0"), (n * 31 % 160 + 30.0).alias("x1"), (n * 17 % 160 + 30.0).alias("y1"))
    moves = events(spark, sf_dir).select("id", (F.col("key") % 5).alias("site_id"), (F.col("id") * 7 % 200 * 1.0).alias("x"), (F.col("id") * 11 % 200 * 1.0).alias("y"))
    return streaming.run(streaming.checked_moves(moves, zones), "moves").select("id", F.coalesce("zone_id", F.lit(-1)).alias("zone_id"), "is_valid")


@query("s03_status_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS status, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def _(spark, sf_dir):
    """Windows that the watermark has closed."""
    found = streaming.run(streaming.status_counts(events(spark, sf_dir)), "status")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "status", "n")


@query("s04_latest_state", "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS status, max(value) AS most FROM events GROUP BY 1")
def _(spark, sf_dir):
    return streaming.run(streaming.latest_state(events(spark, sf_dir)), "state", "complete")


# --- report tables


@query("v01_executive_metrics", f"""{VOLUMES}, m AS (SELECT dem_id, count(*) AS n_cells, avg(z) AS mean_z FROM dem GROUP BY dem_id), j AS (SELECT m.dem_id, n_cells * 100e0 / 4046.86e0 AS acres, mean_z, cut_cy, fill_cy, net_cy FROM m JOIN v ON m.dem_id = v.dem_id)
SELECT dem_id, metric, round(amount, 6) + 0.0 AS amount FROM (UNPIVOT j ON acres, mean_z, cut_cy, fill_cy, net_cy INTO NAME metric VALUE amount)""")
def _(spark, sf_dir):
    cells = dem(spark, sf_dir).groupBy("dem_id").agg((F.count("*") * CELL * CELL / raster.ACRE).alias("acres"), F.avg("z").alias("mean_z"))
    met = cells.join(site_volumes(spark, sf_dir), "dem_id")
    return met.unpivot("dem_id", ["acres", "mean_z", "cut_cy", "fill_cy", "net_cy"], "metric", "amount")


@query("v02_volume_table", f"{VOLUMES}, x AS (SELECT dem_id, cut_cy, cut_cy / 1.30795e0 AS cut_m3, fill_cy, fill_cy / 1.30795e0 AS fill_m3 FROM v) SELECT dem_id, {r('cut_cy', 'cut_m3', 'fill_cy', 'fill_m3')} FROM x")
def _(spark, sf_dir):
    return site_volumes(spark, sf_dir).select("dem_id", "cut_cy", (F.col("cut_cy") / 1.30795).alias("cut_m3"), "fill_cy", (F.col("fill_cy") / 1.30795).alias("fill_m3"))


@query("v03_road_table", f"WITH {SEGMENTS}, x AS (SELECT site_id, class, count(*) AS n, sum(length) AS length_m, sum(length) * 3.28084e0 AS length_ft FROM sg GROUP BY ALL) SELECT site_id, class, n, {r('length_m', 'length_ft')} FROM x")
def _(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("site_id", "class").agg(F.count("*").alias("n"), F.sum("length").alias("length_m"), (F.sum("length") * earthwork.FEET).alias("length_ft"))


@query("v05_asset_inventory", f"WITH {ASSETS}, x AS (SELECT site_id, type, count(*) AS n, sum(width * length) / 4046.86e0 AS acres FROM a GROUP BY ALL) SELECT site_id, type, n, {r('acres')} FROM x")
def _(spark, sf_dir):
    return assets(spark, sf_dir).groupBy("site_id", "type").agg(F.count("*").alias("n"), (F.sum(F.col("width") * F.col("length")) / raster.ACRE).alias("acres"))


@query("v06_site_overview", f"WITH {dem_sql()}, x AS (SELECT dem_id, count(*) * 100e0 / 4046.86e0 AS acres, min(z) AS low, max(z) AS high, avg(z) AS mean FROM dem GROUP BY dem_id) SELECT dem_id, {r('acres', 'low', 'high', 'mean')} FROM x")
def _(spark, sf_dir):
    return dem(spark, sf_dir).groupBy("dem_id").agg((F.count("*") * CELL * CELL / raster.ACRE).alias("acres"), F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"))
