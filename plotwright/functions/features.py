"""Parsing of map, flood and elevation features, names and free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags, classes, distances in metres, zones in order of risk, patterns.
ROAD_CLASS = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "primary", "trunk_link": "primary", "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary",
    "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential", "unclassified": "residential", "living_street": "residential", "service": "service", "track": "service",
}
ROAD_TYPE = {"motorway": "major", "primary": "major", "secondary": "collector", "tertiary": "collector", "residential": "local", "service": "driveway", "other": "local"}
ROAD_SETBACK = {"major": 30.48, "collector": 22.86, "local": 15.24, "driveway": 7.62}
WATER_SETBACK = {"stream": 30.48, "river": 45.72, "pond": 15.24, "lake": 30.48, "wetland": 15.24}
UTILITY_SETBACK = {"power_line": 15.24, "high_voltage": 30.48, "pipeline": 12.19, "gas_line": 9.14, "default": 9.14}
PROPERTY_SETBACK = {"default": 7.62, "front": 7.62, "side": 4.57, "rear": 6.10}
BUILDING_SETBACK = 3.0
FLOOD_CODES = ("A", "AE", "AH", "AO", "AR", "A99", "V", "VE", "B", "C", "X", "D")
FLOOD_RISK = ("VE", "V", "AE", "AH", "AO", "A", "AR", "A99", "X_PROTECTED", "B", "C", "X", "D", "OPEN_WATER", "UNKNOWN")
HIGH_RISK = ("A", "AE", "AH", "AO", "AR", "A99", "V", "VE")
BOUNDARY_NAMES = (r"property\s*boundary", r"property\s*line", r"parcel\s*boundary", r"parcel\s*line", r"site\s*boundary", "boundary", "parcel", "property", "site", r"lot\s*line", r"lot\s*boundary", r"lot\s*\d+")
BOUNDARY_FOLDERS = ("boundar(?:y|ies)", "parcel", "property", "site", "lot")
BOUNDARY_KEYS = ("boundary", "parcel", "property", "apn", "parcel_id", "lot")
CONTOUR_WORDS = ("contour", "elevation", "topo", "topographic", "isoline", "isohypse")
ELEVATIONS = (r"elevation[:\s]+(\d+\.?\d*)", r"(\d+\.?\d*)\s*(?:m|meter|metre)s?", r"(\d+\.?\d*)\s*(?:ft|foot|feet|')", r"(\d+\.?\d*)\s*contour", r"^(\d+\.?\d*)$")
STREET = r"(?i)\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|way|court|ct|boulevard|blvd)"
SENSITIVE = tuple(rf"(?i){word}[\"']?\s*[:=]\s*[\"']?([^\"'\s,}}]+)" for word in ("password", "api[_-]?key", "secret", "token", "auth")) + (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b")
SENSITIVE_KEYS = ("password", "api_key", "secret", "token", "access_token", "refresh_token", "private_key", "credit_card", "ssn", "auth", "authorization")
HIDDEN = "***REDACTED***"


def lookup(key: Column, values: dict, otherwise=None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def feature_class(tags: Column) -> Column:
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    return (
        F.when(tag("building").isNotNull(), "building").when(tag("highway").isNotNull(), "road").when((tag("power") == "line") | (tag("man_made") == "pipeline"), "utility")
        .when(tag("natural").isin("water", "wetland") | tag("waterway").isNotNull(), "water")
    )


def utility_class(tags: Column) -> Column:
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    volts = F.split(F.coalesce(tag("voltage"), F.lit("")), "[;,]")
    high = F.exists(volts, lambda v: F.coalesce(F.trim(v).try_cast("long") >= 100_000, F.lit(False)))
    gas = F.lower(tag("substance")).isin("gas", "natural_gas")
    return F.when(tag("power") == "line", F.when(high, "high_voltage").otherwise("power_line")).when(tag("man_made") == "pipeline", F.when(gas, "gas_line").otherwise("pipeline")).otherwise("default")


def water_class(tags: Column) -> Column:
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    return (
        F.when(tag("natural") == "wetland", "wetland").when(tag("waterway").isin("stream", "creek", "ditch", "drain"), "stream").when(tag("waterway") == "river", "river")
        .when(tag("water").isin("lake", "reservoir"), "lake").otherwise("pond")
    )


def road_class(highway: Column) -> Column:
    return lookup(highway, ROAD_CLASS, "other")


def flood_zone(code: Column) -> Column:
    clean = F.upper(F.trim(code))
    sub = F.when(clean.contains("PROTECTED") | clean.contains("LEVEE"), "X_PROTECTED").otherwise("X")
    return (
        F.when(clean.isin(*FLOOD_CODES), clean).when(clean == "AREA NOT INCLUDED", "X").when(clean == "OPEN WATER", "OPEN_WATER").when(clean.contains("FLOODWAY"), "AE")
        .when(clean.startswith("X "), sub).otherwise("UNKNOWN")
    )


def risk_rank(zone: Column) -> Column:
    return lookup(zone, {z: i for i, z in enumerate(FLOOD_RISK)}, len(FLOOD_RISK))


def high_risk(zone: Column) -> Column:
    return zone.isin(*HIGH_RISK)


def number(text: Column) -> Column:
    """A number with plus signs and spaces dropped; placeholders and other text are null."""
    return F.regexp_replace(F.trim(text), "[+ ]", "").try_cast("double")


def first_number(*texts: Column) -> Column:
    """The first of the numbers that is not zero, else null."""
    return F.coalesce(*[F.nullif(number(t), F.lit(0.0)) for t in texts])


def flood_date(text: Column) -> Column:
    """Milliseconds since 1970, or one of three date formats."""
    millis = F.when(text.rlike(r"^\d+$"), F.timestamp_millis(text.try_cast("long")))
    return F.coalesce(millis, *[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss")])


def elevation_source(source: Column, resolution: Column) -> Column:
    s = F.lower(source)
    has = lambda *words: reduce(lambda a, b: a | b, [s.contains(w) for w in words])
    named = (
        F.when(has("1-meter", "1 meter"), "3DEP_1M").when(has("1/3", "0.33"), "3DEP_1_3").when(has("1 arc", "1-arc"), "3DEP_1ARC").when(has("2 arc", "2-arc"), "3DEP_2ARC")
        .when(has("3dep"), "3DEP_1ARC").when(has("ned"), "NED").when(has("srtm"), "SRTM")
    )
    measured = F.when(resolution < 0.01, "3DEP_1M").when(resolution <= 0.33, "3DEP_1_3").when(resolution <= 1.0, "3DEP_1ARC").when(resolution <= 2.0, "3DEP_2ARC").when(resolution.isNotNull(), "NED")
    return F.coalesce(named, measured, F.lit("3DEP_1ARC"))


def datum(text: Column, vertical: Column) -> Column:
    t, v = F.upper(text), F.upper(vertical)
    first = F.when(t.contains("NAVD88") | t.contains("NAVD 88"), "NAVD88").when(t.contains("NGVD29") | t.contains("NGVD 29"), "NGVD29").when(t.contains("WGS84") | t.contains("WGS 84"), "WGS84").when(t.contains("MSL"), "MSL")
    return F.coalesce(first, F.when(v.contains("NAVD88"), "NAVD88").when(v.contains("NGVD29"), "NGVD29"), F.lit("NAVD88"))


def metres(value: Column, unit: Column) -> Column:
    """A parsed height, feet turned to metres."""
    v = value.try_cast("double")
    return F.when(F.lower(unit).isin("feet", "foot", "ft"), v * 0.3048).otherwise(v)


def unit_of_file(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("feet") | n.contains("_ft"), "feet").when(n.contains("meter") | n.contains("_m"), "meters").otherwise("meters")


def elevation_in(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")).try_cast("double") for p in ELEVATIONS])


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def address_in(properties: Column, description: Column) -> Column:
    """The last property whose key speaks of an address or location, else what looks like one in the description."""
    keyed = F.filter(F.map_entries(properties), lambda e: F.lower(e["key"]).contains("address") | F.lower(e["key"]).contains("location"))
    return F.coalesce(F.try_element_at(keyed, F.lit(-1))["value"], F.nullif(F.regexp_extract(description, STREET, 0), F.lit("")))


def parcel_in(properties: Column) -> Column:
    """The last property (not of an address) whose key speaks of a parcel or lot number."""
    def wanted(e: Column) -> Column:
        k = F.lower(e["key"])
        return ~(k.contains("address") | k.contains("location")) & k.rlike("apn|parcel|lot_number")

    return F.try_element_at(F.filter(F.map_entries(properties), wanted), F.lit(-1))["value"]


def redacted(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, HIDDEN.replace("$", r"\$")), SENSITIVE, text)


def redacted_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), HIDDEN).otherwise(redacted(v)))


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def cache_key(*numbers: Column) -> Column:
    """SHA-256 of numbers with eight decimals."""
    return F.sha2(F.format_string(",".join(["%.8f"] * len(numbers)), *numbers).cast("binary"), 256)
