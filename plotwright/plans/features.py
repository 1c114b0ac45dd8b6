"""Queries over points, tags, texts and observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotwright.functions import crs
from plotwright.functions import features as P
from plotwright.operators import observations as O

from .fixtures import r, rounded, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7 % 360 - 180 + 0.25).alias("lon"), (k * 11 % 160 - 78 + 0.5).alias("lat"))


POINTS = "WITH p AS (SELECT c_custkey AS id, c_custkey * 7 % 360 - 180 + 0.25e0 AS lon, c_custkey * 11 % 160 - 78 + 0.5e0 AS lat FROM customer)"
ZONE = """z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END
 WHEN CAST(trunc((lon + 180e0) / 6e0) AS INT) + 1 > 60 THEN 1 ELSE CAST(trunc((lon + 180e0) / 6e0) AS INT) + 1 END AS zone FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)"""


def zoned(spark, sf_dir):
    return points(spark, sf_dir).withColumn("zone", crs.utm_zone(F.col("lon"), F.col("lat"))).where("zone is not null").withColumn("north", F.col("lat") >= 0)


@query("c01_utm_zone", f"{POINTS}, {ZONE} SELECT id, zone, lat >= 0 AS north FROM z")
def _(spark, sf_dir):
    return zoned(spark, sf_dir).select("id", "zone", "north")


@query("c02_utm_epsg", f"{POINTS}, {ZONE} SELECT id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg, 'WGS 84 / UTM zone ' || zone || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS name FROM z")
def _(spark, sf_dir):
    return zoned(spark, sf_dir).select("id", crs.utm_epsg(F.col("zone"), F.col("north")).alias("epsg"), crs.utm_name(F.col("zone"), F.col("north")).alias("name"))


@query("c03_zone_bounds", f"{POINTS}, {ZONE} SELECT DISTINCT zone, (zone - 1) * 6e0 - 180e0 AS west, zone * 6e0 - 180e0 AS east, zone * 6e0 - 183e0 AS middle FROM z")
def _(spark, sf_dir):
    west, east = crs.zone_bounds(F.col("zone"))
    return zoned(spark, sf_dir).select("zone", west.alias("west"), east.alias("east"), crs.central_meridian(F.col("zone")).alias("middle")).distinct()


@query("c04_scale_factor", f"{POINTS}, {ZONE}, s AS (SELECT id, 0.9996e0 * (1e0 + pow(radians(lon - (zone * 6e0 - 183e0)), 2) * pow(cos(radians(lat)), 2) / 2e0) AS scale FROM z) SELECT id, {r('scale')} FROM s")
def _(spark, sf_dir):
    return zoned(spark, sf_dir).select("id", crs.scale_factor(F.col("lon"), F.col("lat"), F.col("zone")).alias("scale"))


@query("c05_band_letter", f"{POINTS}, {ZONE} SELECT id, CASE WHEN lat BETWEEN -80 AND 84 THEN CASE WHEN lat >= 72 THEN 'X' ELSE substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80e0) / 8e0) AS INT) + 1, 1) END END AS band FROM z")
def _(spark, sf_dir):
    return zoned(spark, sf_dir).select("id", crs.band_letter(F.col("lat")).alias("band"))


_SUM_X = " + ".join(f"{a!r} * cos({2 * k}e0 * xi) * sinh({2 * k}e0 * eta)" for k, a in enumerate(crs.ALPHA, 1)).replace("e-", "e-")
_SUM_Y = " + ".join(f"{a!r} * sin({2 * k}e0 * xi) * cosh({2 * k}e0 * eta)" for k, a in enumerate(crs.ALPHA, 1))


@query("c06_to_utm", f"""{POINTS}, {ZONE}, a AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6e0 - 183e0)) AS lam FROM z), b AS (SELECT *, sinh(atanh(sin(phi)) - {crs._E!r} * atanh({crs._E!r} * sin(phi))) AS t FROM a),
c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1e0 + t * t)) AS eta FROM b),
d AS (SELECT id, 500000e0 + 0.9996e0 * {crs._RADIUS!r} * (eta + {_SUM_X}) AS east, CASE WHEN lat >= 0 THEN 0e0 ELSE 10000000e0 END + 0.9996e0 * {crs._RADIUS!r} * (xi + {_SUM_Y}) AS north FROM c)
SELECT id, round(east, 3) + 0.0 AS east, round(north, 3) + 0.0 AS north FROM d""")
def _(spark, sf_dir):
    e, n = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("north"))
    return zoned(spark, sf_dir).select("id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query("c07_utm_round_trip", f"{POINTS}, {ZONE} SELECT id, {r('lon', 'lat')} FROM z")
def _(spark, sf_dir):
    """There and back: the longitudes and latitudes that went in."""
    e, n = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("north"))
    lon, lat = crs.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("north"))
    return zoned(spark, sf_dir).withColumns({"e": e, "n": n}).select("id", lon.alias("lon"), lat.alias("lat"))


@query("c08_web_mercator", f"{POINTS}, m AS (SELECT id, radians(lon) * 6378137e0 AS x, ln(tan(pi() / 4 + radians(lat) / 2e0)) * 6378137e0 AS y FROM p) SELECT id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM m")
def _(spark, sf_dir):
    x, y = crs.web_mercator(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("c10_bounds_transform", f"""{POINTS}, b AS (SELECT id % 20 AS site_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM p GROUP BY 1)
SELECT site_id, round(radians(w) * 6378137e0, 3) + 0.0 AS min_x, round(radians(e) * 6378137e0, 3) + 0.0 AS max_x, round(ln(tan(pi() / 4 + radians(s) / 2e0)) * 6378137e0, 3) + 0.0 AS min_y, round(ln(tan(pi() / 4 + radians(n) / 2e0)) * 6378137e0, 3) + 0.0 AS max_y FROM b""")
def _(spark, sf_dir):
    box = points(spark, sf_dir).groupBy((F.col("id") % 20).alias("site_id")).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    corners = [crs.web_mercator(F.col(x), F.col(y)) for x in "we" for y in "sn"]
    pick = lambda f, k: F.round(f(*[c[k] for c in corners]), 3)
    return box.select("site_id", pick(F.least, 0).alias("min_x"), pick(F.greatest, 0).alias("max_x"), pick(F.least, 1).alias("min_y"), pick(F.greatest, 1).alias("max_y"))


@query("c11_round_trip_accuracy", f"{POINTS}, {ZONE} SELECT id, true AS accurate FROM z")
def _(spark, sf_dir):
    e, n = crs.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("north"))
    lon, lat = crs.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("north"))
    error = F.sqrt(F.pow(lon - F.col("lon"), 2) + F.pow(lat - F.col("lat"), 2)) * 111_319.9
    return zoned(spark, sf_dir).withColumns({"e": e, "n": n}).select("id", (error <= 0.001).alias("accurate"))


@query("c12_crs_names", """SELECT CAST(c_custkey AS INT) AS id, CASE CAST(c_custkey AS INT) % 5 WHEN 4 THEN 0 ELSE 32600 + CAST(c_custkey AS INT) END AS epsg FROM customer""")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    n = 32600 + k
    name = F.when(k % 5 == 0, F.concat(F.lit("EPSG:"), n)).when(k % 5 == 1, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), n)).when(k % 5 == 2, F.concat(F.lit("http://www.opengis.net/def/crs/EPSG/0/"), n)).when(k % 5 == 3, n.cast("string")).otherwise("local grid")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.coalesce(crs.parse_name(name), F.lit(0)).alias("epsg"))


@query("c20_haversine", f"{POINTS}, q AS (SELECT *, lag(lon) OVER (ORDER BY id) AS lon0, lag(lat) OVER (ORDER BY id) AS lat0 FROM p), h AS (SELECT id, pow(sin(radians(lat - lat0) / 2e0), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2e0), 2) AS a FROM q WHERE lon0 IS NOT NULL) SELECT id, round(20902231e0 * 2e0 * atan2(sqrt(a), sqrt(1e0 - a)), 2) + 0.0 AS feet FROM h")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    before = p.select((F.col("id") + 1).alias("id"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    return p.join(before, "id").select("id", F.round(crs.haversine_feet(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), 2).alias("feet"))


@query("c21_pixel_of_point", f"{POINTS} SELECT id, CAST(trunc((lon + 180e0) / 0.7e0) AS INT) AS col, CAST(trunc((90e0 - lat) / 0.7e0) AS INT) AS \"row\" FROM p")
def _(spark, sf_dir):
    return points(spark, sf_dir).select("id", ((F.col("lon") + 180.0) / 0.7).cast("int").alias("col"), ((90.0 - F.col("lat")) / 0.7).cast("int").alias("row"))


@query("d04_points_in_box", f"{POINTS} SELECT id FROM p WHERE lon BETWEEN -60.75e0 AND 40.25e0 AND lat BETWEEN -20.5e0 AND 33.5e0")
def _(spark, sf_dir):
    return points(spark, sf_dir).where(F.col("lon").between(-60.75, 40.25) & F.col("lat").between(-20.5, 33.5)).select("id")


@query("e19_tiles_for_box", f"{POINTS}, b AS (SELECT id, lon, lat FROM p), t AS (SELECT id, unnest(range(CAST(floor(lat) AS INT), CAST(floor(lat + 1.25e0) AS INT) + 1)) AS a, lon FROM b), u AS (SELECT id, a, unnest(range(CAST(floor(lon) AS INT), CAST(floor(lon + 0.5e0) AS INT) + 1)) AS o FROM t) SELECT id, printf('dem_%s%02d_%s%03d.tif', CASE WHEN a >= 0 THEN 'n' ELSE 's' END, abs(a), CASE WHEN o >= 0 THEN 'e' ELSE 'w' END, abs(o)) AS tile FROM u")
def _(spark, sf_dir):
    boxes = points(spark, sf_dir).select("id", F.col("lon").alias("min_x"), (F.col("lon") + 0.5).alias("max_x"), F.col("lat").alias("min_y"), (F.col("lat") + 1.25).alias("max_y"))
    return O.tiles_of(boxes).select("id", "tile")


TAGS = """ways AS (SELECT o_orderkey AS id, o_orderkey % 10 AS m, CASE o_orderkey % 10 WHEN 0 THEN MAP {'building': 'yes'} WHEN 1 THEN MAP {'highway': 'trunk_link'} WHEN 2 THEN MAP {'highway': 'residential'} WHEN 3 THEN MAP {'highway': 'footway'} WHEN 4 THEN MAP {'power': 'line', 'voltage': '12000; 220000'}
 WHEN 5 THEN MAP {'power': 'line', 'voltage': 'x,9000'} WHEN 6 THEN MAP {'man_made': 'pipeline', 'substance': 'Natural_Gas'} WHEN 7 THEN MAP {'waterway': 'river'} WHEN 8 THEN MAP {'natural': 'water', 'water': 'lake'} ELSE MAP {'leisure': 'park'} END AS tags FROM orders)"""


def ways(spark, sf_dir):
    k = F.col("o_orderkey")
    kinds = [{"building": "yes"}, {"highway": "trunk_link"}, {"highway": "residential"}, {"highway": "footway"}, {"power": "line", "voltage": "12000; 220000"}, {"power": "line", "voltage": "x,9000"}, {"man_made": "pipeline", "substance": "Natural_Gas"}, {"waterway": "river"}, {"natural": "water", "water": "lake"}, {"leisure": "park"}]
    tags = F.array(*[F.create_map(*[F.lit(x) for p in t.items() for x in p]) for t in kinds])
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.element_at(tags, (k % 10).cast("int") + 1).alias("tags"))


CLASSES = "CASE WHEN m = 0 THEN 'building' WHEN m <= 3 THEN 'road' WHEN m <= 6 THEN 'utility' WHEN m <= 8 THEN 'water' END"


@query("p01_feature_class", f"WITH {TAGS} SELECT id, {CLASSES} AS class FROM ways")
def _(spark, sf_dir):
    return ways(spark, sf_dir).select("id", P.feature_class(F.col("tags")).alias("class"))


@query("p02_utility_class", f"WITH {TAGS} SELECT id, CASE m WHEN 4 THEN 'high_voltage' WHEN 5 THEN 'power_line' WHEN 6 THEN 'gas_line' ELSE 'default' END AS class FROM ways")
def _(spark, sf_dir):
    return ways(spark, sf_dir).select("id", P.utility_class(F.col("tags")).alias("class"))


@query("p03_water_class", f"WITH {TAGS} SELECT id, CASE m WHEN 7 THEN 'river' WHEN 8 THEN 'lake' END AS class FROM ways WHERE m IN (7, 8)")
def _(spark, sf_dir):
    return ways(spark, sf_dir).where(P.feature_class(F.col("tags")) == "water").select("id", P.water_class(F.col("tags")).alias("class"))


@query("j02_feature_setbacks", f"WITH {TAGS} SELECT {CLASSES} AS class, CASE m WHEN 0 THEN 3.0e0 WHEN 1 THEN 30.48e0 WHEN 2 THEN 15.24e0 WHEN 3 THEN 15.24e0 WHEN 4 THEN 30.48e0 WHEN 5 THEN 15.24e0 WHEN 6 THEN 9.14e0 WHEN 7 THEN 45.72e0 WHEN 8 THEN 30.48e0 END AS setback_m, count(*) AS n FROM ways WHERE m < 9 GROUP BY ALL")
def _(spark, sf_dir):
    return O.with_setbacks(ways(spark, sf_dir)).where("class is not null").groupBy("class", "setback_m").agg(F.count("*").alias("n"))


@query("j01_way_coordinates", """WITH n AS (SELECT s_suppkey AS id, s_suppkey * 0.5e0 AS x, s_suppkey * 0.25e0 AS y FROM supplier), w AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_suppkey + l_linenumber * 20 AS ref FROM lineitem),
j AS (SELECT way_id, pos, ref, x, y FROM w JOIN n ON w.ref = n.id) SELECT way_id, string_agg(x || ' ' || y, ',' ORDER BY pos, ref) AS line FROM j GROUP BY way_id HAVING count(*) >= 2""")
def _(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 0.5).alias("x"), (F.col("s_suppkey") * 0.25).alias("y"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") + F.col("l_linenumber") * 20).alias("ref"))
    return O.way_lines(refs, nodes).select("way_id", F.array_join(F.transform("line", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("line"))


FLOOD = """fl AS (SELECT l_suppkey AS location, l_orderkey AS id, l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 've ' WHEN 2 THEN 'X PROTECTED BY LEVEE' WHEN 3 THEN 'AE' WHEN 4 THEN 'FLOODWAY AREA' WHEN 5 THEN 'A99' WHEN 6 THEN 'OPEN WATER' ELSE 'Z9' END AS code, l_quantity AS bfe FROM lineitem),
fz AS (SELECT *, CASE seq WHEN 1 THEN 'VE' WHEN 2 THEN 'X_PROTECTED' WHEN 3 THEN 'AE' WHEN 4 THEN 'AE' WHEN 5 THEN 'A99' WHEN 6 THEN 'OPEN_WATER' ELSE 'UNKNOWN' END AS zone, CASE seq WHEN 1 THEN 0 WHEN 2 THEN 8 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 7 WHEN 6 THEN 13 ELSE 14 END AS risk FROM fl)"""


def floods(spark, sf_dir):
    n = F.col("l_linenumber")
    code = F.when(n == 1, "ve ").when(n == 2, "X PROTECTED BY LEVEE").when(n == 3, "AE").when(n == 4, "FLOODWAY AREA").when(n == 5, "A99").when(n == 6, "OPEN WATER").otherwise("Z9")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("location"), F.col("l_orderkey").alias("id"), n.alias("seq"), code.alias("code"), F.col("l_quantity").alias("bfe"))


@query("p04_flood_zone", f"WITH {FLOOD} SELECT zone, count(*) AS n FROM fz GROUP BY zone")
def _(spark, sf_dir):
    return floods(spark, sf_dir).groupBy(P.flood_zone(F.col("code")).alias("zone")).agg(F.count("*").alias("n"))


@query("d05_high_risk_zones", f"WITH {FLOOD} SELECT location, count(*) AS n FROM fz WHERE zone IN ('A', 'AE', 'AH', 'AO', 'AR', 'A99', 'V', 'VE') GROUP BY location")
def _(spark, sf_dir):
    return floods(spark, sf_dir).where(P.high_risk(P.flood_zone(F.col("code")))).groupBy("location").agg(F.count("*").alias("n"))


@query("f14_flood_summary", f"WITH {FLOOD} SELECT location, count(*) AS n_zones, arg_min(zone, risk) AS highest, bool_or(zone IN ('A', 'AE', 'AH', 'AO', 'AR', 'A99', 'V', 'VE')) AS in_hazard_area, max(bfe) AS max_bfe FROM fz GROUP BY location")
def _(spark, sf_dir):
    return O.flood_summary(floods(spark, sf_dir)).select("location", "n_zones", "highest", "in_hazard_area", "max_bfe")


@query("f15_flood_zone_counts", f"WITH {FLOOD} SELECT location, zone, count(*) AS n, max(bfe) AS max_bfe FROM fz GROUP BY ALL")
def _(spark, sf_dir):
    return floods(spark, sf_dir).groupBy("location", P.flood_zone(F.col("code")).alias("zone")).agg(F.count("*").alias("n"), F.max("bfe").alias("max_bfe"))


@query("k19_flood_constraints", f"""WITH {FLOOD}, s AS (SELECT location, bool_or(zone IN ('A', 'AE', 'AH', 'AO', 'AR', 'A99', 'V', 'VE')) AS sfha, arg_min(zone, id * 10 + seq) FILTER (zone IN ('A', 'AE', 'AH', 'AO', 'AR', 'A99', 'V', 'VE')) AS first_zone FROM fz GROUP BY location)
SELECT location, first_zone AS zone, CASE WHEN first_zone IN ('V', 'VE', 'AE', 'AH', 'AO') THEN 'high' ELSE 'medium' END AS severity FROM s WHERE sfha""")
def _(spark, sf_dir):
    return O.flood_constraints(floods(spark, sf_dir).withColumn("seq", F.col("id") * 10 + F.col("seq")))


@query("p05_flood_dates", """SELECT l_orderkey AS id, l_linenumber AS n, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS c FROM lineitem GROUP BY ALL""")
def _(spark, sf_dir):
    ts, n = F.col("l_shipdate").cast("timestamp"), F.col("l_linenumber")
    text = F.when(n % 4 == 0, F.unix_millis(ts).cast("string")).when(n % 4 == 1, F.date_format(ts, "yyyy-MM-dd")).when(n % 4 == 2, F.date_format(ts, "MM/dd/yyyy")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), n.alias("n"), F.date_format(P.flood_date(text), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("c"))


@query("p06_flood_numbers", """WITH x AS (SELECT l_linenumber, l_orderkey, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE l_quantity END AS v FROM lineitem) SELECT l_linenumber AS n, count(*) AS rows, count(v) AS parsed, sum(v) AS total FROM x GROUP BY l_linenumber""")
def _(spark, sf_dir):
    n = F.col("l_linenumber")
    text = F.when(n == 1, "N/A").when(n == 2, " - ").when(n == 3, F.concat(F.lit("+ "), F.col("l_quantity"))).otherwise(F.concat(F.col("l_quantity"), F.lit(" ")))
    v = P.number(text)
    return table(spark, sf_dir, "lineitem").groupBy(n.alias("n")).agg(F.count("*").alias("rows"), F.count(v).alias("parsed"), F.sum(v).alias("total"))


@query("p09_elevation_source", """SELECT event_id % 8 AS k, list_element(['3DEP_1M', '3DEP_1_3', '3DEP_1ARC', '3DEP_1ARC', 'NED', 'SRTM', '3DEP_1_3', '3DEP_1ARC'], CAST(event_id % 8 AS INT) + 1) AS source, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, sf_dir):
    k = F.col("event_id") % 8
    names = F.array(*[F.lit(x) for x in ("3DEP 1-meter", "1/3 arc-second", "1 arc-second", "USGS 3DEP", "NED", "SRTM v3", None, None)])
    res = F.when(k == 6, 0.2)
    return table(spark, sf_dir, "events").groupBy(k.alias("k"), P.elevation_source(F.element_at(names, k.cast("int") + 1), res).alias("source")).agg(F.count("*").alias("n"))


@query("p10_datum", """SELECT event_id % 5 AS k, list_element(['NAVD88', 'NGVD29', 'WGS84', 'NGVD29', 'NAVD88'], CAST(event_id % 5 AS INT) + 1) AS datum, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, sf_dir):
    k = F.col("event_id") % 5
    d, v = F.when(k == 0, "navd 88").when(k == 1, "NGVD29").when(k == 2, "WGS 84"), F.when(k == 3, "ngvd29")
    return table(spark, sf_dir, "events").groupBy(k.alias("k"), P.datum(d, v).alias("datum")).agg(F.count("*").alias("n"))


@query("p11_elevation_values", """SELECT event_id AS id, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) * CASE WHEN event_id % 2 = 0 THEN 0.3048e0 ELSE 1 END, 6) + 0.0 AS metres FROM events""")
def _(spark, sf_dir):
    unit = F.when(F.col("event_id") % 2 == 0, "Feet").otherwise("Meters")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), P.metres(F.get_json_object("props", "$.k"), unit).alias("metres"))


@query("p14_elevation_in_text", """SELECT p_partkey AS id, CAST(CASE p_partkey % 6 WHEN 5 THEN NULL ELSE p_size END AS DOUBLE) AS elevation FROM part""")
def _(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("Elevation: "), n)).when(k == 1, F.concat(n, F.lit(" meters"))).when(k == 2, F.concat(n, F.lit("' line"))).when(k == 3, F.concat(n, F.lit(" contour"))).when(k == 4, n.cast("string")).otherwise("ridge")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.elevation_in(text).alias("elevation"))


@query("p15_address_and_parcel", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_custkey || ' Oak Street' END AS address, c_mktsegment AS parcel FROM customer""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    props = F.when(k % 2 == 0, F.create_map(F.lit("Owner"), F.lit("x"), F.lit("Site_Address"), F.col("c_name"), F.lit("APN"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("LOT_NUMBER"), F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), P.address_in(props, F.concat(F.lit("at "), k, F.lit(" Oak Street, north side"))).alias("address"), P.parcel_in(props).alias("parcel"))


_HIDE = "text"
for _p in P.SENSITIVE:
    _o = "gi" if _p.startswith("(?i)") else "g"
    _q = _p.removeprefix("(?i)").replace("'", "''")
    _HIDE = f"regexp_replace({_HIDE}, '{_q}', '{P.HIDDEN}', '{_o}')"


@query("p16_redaction", f"SELECT doc_id, sha256({_HIDE}) AS text_sha256 FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(P.redacted(F.col("text")).cast("binary"), 256).alias("text_sha256"))


@query("p17_titles", "SELECT DISTINCT lower(p_type) AS raw, upper(p_type[1]) || lower(p_type[2:]) || ' Zone' AS title FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.lower("p_type").alias("raw"), P.title(F.concat(F.lower("p_type"), F.lit("_zone"))).alias("title")).distinct()


@query("p18_cache_key", f"{POINTS} SELECT id, sha256(printf('%.8f,%.8f', lon, lat)) AS key FROM p")
def _(spark, sf_dir):
    return points(spark, sf_dir).select("id", P.cache_key(F.col("lon"), F.col("lat")).alias("key"))


@query("d07_boundary_names", "SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Lot ' || p_size ELSE '' END), 'property|parcel|boundary|site|lot\\s*line|lot\\s*\\d+')")
def _(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" Lot "), "p_size")).otherwise(""))
    return table(spark, sf_dir, "part").where(P.any_of(name, P.BOUNDARY_NAMES)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("d10_contours", "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 1")
def _(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 4 == 1, "Topo line"))
    return table(spark, sf_dir, "part").where(P.any_of(text, P.CONTOUR_WORDS)).select(F.col("p_partkey").alias("id"))


EVENTS = "ob AS (SELECT user_id AS key, event_id AS id, ts, event_type AS status, value FROM events)"


def observed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status"), "value")


@query("f12_batch_statistics", f"WITH {EVENTS}, x AS (SELECT key, count(value) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, max(value) - min(value) AS span FROM ob GROUP BY key) SELECT key, n, {r('low', 'high', 'mean', 'span')} FROM x")
def _(spark, sf_dir):
    return O.batch_statistics(observed(spark, sf_dir))


@query("f13_batch_status", f"WITH {EVENTS} SELECT key, count(*) FILTER (status <> 'error') AS n_good, count(*) FILTER (status = 'error') AS n_failed, CASE WHEN count(*) FILTER (status = 'error') = 0 THEN 'SUCCESS' WHEN count(*) FILTER (status <> 'error') = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM ob GROUP BY key")
def _(spark, sf_dir):
    return O.batch_status(observed(spark, sf_dir), F.col("status") == "error")


@query("f24_cache_statistics", f"WITH {EVENTS} SELECT count(DISTINCT key) AS entries, count(*) FILTER (status = 'view') AS hits, count(*) FILTER (status = 'error') AS misses, round(count(*) FILTER (status = 'view') * 1e0 / count(*) FILTER (status IN ('view', 'error')), 6) + 0.0 AS hit_rate FROM ob")
def _(spark, sf_dir):
    s = F.col("status")
    hits, misses = F.count_if(s == "view"), F.count_if(s == "error")
    return observed(spark, sf_dir).agg(F.countDistinct("key").alias("entries"), hits.alias("hits"), misses.alias("misses"), (hits / (hits + misses)).alias("hit_rate"))


NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("t07_latest_within_ttl", f"WITH {EVENTS} SELECT key, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM ob WHERE ts >= {NOW} - INTERVAL 10 DAY GROUP BY key")
def _(spark, sf_dir):
    return O.latest(observed(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"), "10 days").select("key", "id", "ts")


@query("t08_evict_oldest", f"WITH {EVENTS}, e AS (SELECT key, max(ts) AS ts FROM ob GROUP BY key), n AS (SELECT *, row_number() OVER (ORDER BY ts, key) AS k FROM e) SELECT key FROM n WHERE (SELECT count(*) FROM e) >= 100 AND k <= 10")
def _(spark, sf_dir):
    return O.evicted(observed(spark, sf_dir).groupBy("key").agg(F.max("ts").alias("ts")), 100).select("key")


@query("t09_idle_tiles", f"WITH {EVENTS} SELECT key, max(ts) AS last FROM ob GROUP BY key HAVING max(ts) < {NOW} - INTERVAL 36 HOUR")
def _(spark, sf_dir):
    return observed(spark, sf_dir).groupBy("key").agg(F.max("ts").alias("last")).where(F.col("last") < F.lit("2024-01-31 00:00:00").cast("timestamp") - F.expr("INTERVAL 36 HOURS"))


@query("d13_retention", f"WITH {EVENTS} SELECT id FROM ob WHERE ts < {NOW} - INTERVAL 7 DAY AND status IN ('purchase', 'error') AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def _(spark, sf_dir):
    keep = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return O.expired(observed(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"), "7 days", ("purchase", "error"), keep).select("id")


@query("d14_job_queue", f"WITH {EVENTS} SELECT status, count(*) AS n, min(ts) AS oldest FROM ob WHERE status IN ('view', 'click') GROUP BY status")
def _(spark, sf_dir):
    return observed(spark, sf_dir).where(F.col("status").isin("view", "click")).groupBy("status").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("f21_constraints_by_type", "SELECT o_orderpriority AS type, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS severity FROM orders GROUP BY o_orderpriority")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"), F.min_by("o_orderstatus", "o_orderkey").alias("severity"))


@query("f22_assets_by_type", "SELECT s_suppkey % 4 AS type, count(*) AS n FROM supplier GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 4).alias("type")).agg(F.count("*").alias("n"))


@query("f23_cost_shares", """WITH c AS (SELECT l_suppkey % 5 AS site_id, 'item ' || l_partkey % 60 AS item, sum(CASE WHEN l_partkey % 60 < 4 THEN 20 ELSE 1 END * l_quantity) AS cost FROM lineitem GROUP BY ALL), s AS (SELECT site_id, CASE WHEN cost / sum(cost) OVER (PARTITION BY site_id) < 0.03e0 THEN 'Other' ELSE item END AS item, cost FROM c) SELECT site_id, item, sum(cost) AS cost FROM s GROUP BY ALL""")
def _(spark, sf_dir):
    weight = F.when(F.col("l_partkey") % 60 < 4, 20).otherwise(1)
    items = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("site_id"), F.concat(F.lit("item "), F.col("l_partkey") % 60).alias("item")).agg(F.sum(weight * F.col("l_quantity")).alias("cost"))
    return O.with_other(items, 0.03)


@query("f18_latest_first", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(w.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("place"), F.count("*").over(w).alias("n"))


@query("t04_top_constraints", "WITH t AS (SELECT o_orderpriority AS type, o_orderkey AS id, o_totalprice AS area, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) - 10 AS more FROM orders) SELECT * FROM t WHERE place <= 10")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("area"))
    return O.top(rows, "type", ["area desc", "id"], 10)


@query("v04_cost_rollup", "SELECT o_orderstatus AS site, o_orderpriority AS category, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("site"), F.col("o_orderpriority").alias("category")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("b07_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 9")
def _(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return O.upsert(old, old.where("id % 4 = 0").withColumn("status", F.lit("new")), ["id"], old.where("id % 10 = 9").select("id"))
