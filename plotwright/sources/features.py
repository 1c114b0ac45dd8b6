"""Feature files in JSON: GeoJSON polygons, map elements, flood features, elevation answers, uploads; and GeoJSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"
GEOJSON = "struct<type:string,features:array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>,geometry:struct<type:string,coordinates:string>,coordinates:string>"
ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>>>>"
FLOODS = "struct<features:array<struct<attributes:struct<FLD_ZONE:string,STATIC_BFE:string,DEPTH:string,EFF_DATE:string,SOURCE_CIT:string,FLOODWAY:string>,geometry:struct<rings:array<array<array<double>>>>>>>"


def geojson_polygons(texts: DataFrame) -> DataFrame:
    """path, part, parts (rings of points) of GeoJSON texts (path, value): collections give polygons and the parts of
    multipolygons, features and bare geometries polygons only; the first part is the boundary."""
    j = texts.select("path", F.from_json("value", GEOJSON).alias("j"))
    single = F.coalesce(F.col("j.geometry"), F.struct(F.col("j.type").alias("type"), F.col("j.coordinates").alias("coordinates")))
    every = F.when(F.col("j.type") == "FeatureCollection", F.transform("j.features", lambda f: f["geometry"])).otherwise(F.array(single))
    g = j.select("path", (F.col("j.type") == "FeatureCollection").alias("whole"), F.posexplode(every).alias("n", "g"))
    polygons = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", RINGS))).when((F.col("g.type") == "MultiPolygon") & F.col("whole"), F.from_json("g.coordinates", f"array<{RINGS}>"))
    found = g.select("path", "n", F.posexplode(polygons).alias("m", "rings"))
    return found.select("path", "n", "m", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("parts"))


def elements(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.from_json("value", ELEMENTS)["elements"]).alias("e")).select("e.*")


def flood_features(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.posexplode(F.from_json("value", FLOODS)["features"]).alias("seq", "f")).select("path", "seq", "f.attributes.*", F.col("f.geometry.rings").alias("rings"))


def elevation_answers(points: DataFrame, answers: DataFrame) -> DataFrame:
    """Every point (query_id, ordinal) with its answer's value; short batches are filled with nulls."""
    value = F.get_json_object("value", "$.value").try_cast("double")
    return points.join(answers.select("query_id", "ordinal", value.alias("z"), F.get_json_object("value", "$.message").alias("message")), ["query_id", "ordinal"], "left")


def geojson_geometry(kind: str, parts: Column) -> Column:
    """A geometry as a JSON string: of parts, the first is a point's or line's."""
    pair = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, pair)
    coordinates = {"Point": lambda: pair(parts[0][0]), "LineString": lambda: ring(parts[0]), "Polygon": lambda: F.transform(parts, ring)}[kind]()
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def feature(geometry: Column, properties: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def collections(features: DataFrame, epsg: int) -> DataFrame:
    """One collection a site of its features (site_id, layer, seq, feature), layers in their fixed order."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("boundary", "buildable_zones", "constraints", "assets", "roads")]), F.col("layer"))
    whole = features.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "seq", "feature"))).alias("f"))
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{epsg}"}}}},"features":['
    return whole.select("site_id", F.concat(F.lit(head), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("value"))


def upload_issues(uploads: DataFrame) -> Column:
    """The first fault of an upload (name, content, mime): extension, then type, then size, then leading bytes, then name."""
    end = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    return F.coalesce(
        F.when(~end.isin("kml", "kmz", "geojson", "json", "tif", "tiff"), "extension"), F.when((end == "kmz") & ~F.col("mime").isin("application/vnd.google-earth.kmz", "application/zip"), "type"),
        F.when(F.octet_length("content") > 50 << 20, "size"), F.when((end == "kmz") & (head != "504B0304"), "leading bytes"), F.when(F.col("name").rlike(r"[/\\]|\.\."), "name"),
    )
