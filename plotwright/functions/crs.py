"""Coordinate reference systems: UTM zones, transverse Mercator, web Mercator, names."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid, the UTM scale, latitude bands.
A, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
BANDS = "CDEFGHJKLMNPQRSTUVWXX"

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _series(rows: list[list[float]]) -> list[float]:
    """Sums over powers of the third flattening; row k starts at power k."""
    return [sum(c * _N ** (k + i) for i, c in enumerate(row)) for k, row in enumerate(rows, 1)]


#: Kruger's series to order 6 (published coefficients).
ALPHA = _series([
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
])
BETA = _series([
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
])


def in_range(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def utm_zone(lon: Column, lat: Column) -> Column:
    """The zone with the Norwegian and Svalbard exceptions; null out of range."""
    plain = ((lon + 180.0) / 6.0).cast("int") + 1
    svalbard = F.when(lon < 0, None).when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).when(lon < 42, 37)
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    zone = F.when(norway, 32).otherwise(F.coalesce(F.when((lat >= 72) & (lat < 84), svalbard), F.when(plain > 60, 1).otherwise(plain)))
    return F.when(in_range(lon, lat), zone)


def utm_epsg(zone: Column, north: Column) -> Column:
    return F.when(north, 32600).otherwise(32700) + zone


def utm_name(zone: Column, north: Column) -> Column:
    return F.concat(F.lit("WGS 84 / UTM zone "), zone, F.when(north, "N").otherwise("S"))


def central_meridian(zone: Column) -> Column:
    return (zone - 1) * 6.0 - 180.0 + 3.0


def zone_bounds(zone: Column) -> tuple[Column, Column]:
    return (zone - 1) * 6.0 - 180.0, zone * 6.0 - 180.0


def band_letter(lat: Column) -> Column:
    """The latitude band; null outside 80 degrees south to 84 north."""
    letters = F.array(*[F.lit(c) for c in BANDS])
    index = F.floor((lat + 80.0) / 8.0).cast("int")
    return F.when(lat.between(-80.0, 84.0), F.when(lat >= 72, "X").otherwise(F.get(letters, index)))


def scale_factor(lon: Column, lat: Column, zone: Column) -> Column:
    east = F.radians(lon - central_meridian(zone))
    return SCALE * (1.0 + east * east * F.pow(F.cos(F.radians(lat)), 2) / 2.0)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2.0)) * A


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2.0 * F.atan(F.exp(y / A)) - math.pi / 2)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x = eta + _sum([a * F.cos(2.0 * k * xi) * F.sinh(2.0 * k * eta) for k, a in enumerate(ALPHA, 1)])
    y = xi + _sum([a * F.sin(2.0 * k * xi) * F.cosh(2.0 * k * eta) for k, a in enumerate(ALPHA, 1)])
    return FALSE_EAST + SCALE * _RADIUS * x, F.when(north, 0.0).otherwise(FALSE_NORTH) + SCALE * _RADIUS * y


def from_utm(east: Column, northing: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude; the latitude by Newton steps from the conformal one."""
    xi = (northing - F.when(north, 0.0).otherwise(FALSE_NORTH)) / (SCALE * _RADIUS)
    eta = (east - FALSE_EAST) / (SCALE * _RADIUS)
    x = xi - _sum([b * F.sin(2.0 * k * xi) * F.cosh(2.0 * k * eta) for k, b in enumerate(BETA, 1)])
    y = eta - _sum([b * F.cos(2.0 * k * xi) * F.sinh(2.0 * k * eta) for k, b in enumerate(BETA, 1)])
    target = F.sin(x) / F.sqrt(F.pow(F.sinh(y), 2) + F.pow(F.cos(x), 2))

    def newton(tau: Column, _: Column) -> Column:
        root = F.sqrt(1.0 + tau * tau)
        sigma = F.sinh(_E * F.atanh(_E * tau / root))
        at = tau * F.sqrt(1.0 + sigma * sigma) - sigma * root
        return tau + (target - at) / F.sqrt(1.0 + at * at) * (1.0 + (1.0 - _E * _E) * tau * tau) / ((1.0 - _E * _E) * root)

    tau = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), target, newton)
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(F.atan(tau))


def parse_name(name: Column) -> Column:
    """The EPSG number in EPSG:n, a URN, an OGC address, or bare digits; null of others."""
    found = [F.regexp_extract(name, p, 1) for p in (r"(?i)EPSG[:\s]*(\d+)", r"(?i)EPSG::(\d+)", r"(?i)epsg/\d+/(\d+)", r"^\s*(\d+)\s*$")]
    return F.coalesce(*[F.try_to_number(F.nullif(f, F.lit("")), F.lit("999999999")) for f in found]).cast("int")


def by_suffix(path: Column, geojson_name: Column) -> Column:
    """The EPSG number of a file: 4326 of KML and KMZ, what a GeoJSON names (4326 if nothing), null of others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("kml", "kmz"), 4326).when(suffix.isin("geojson", "json"), F.coalesce(parse_name(geojson_name), F.lit(4326)))


def by_content(content: Column) -> Column:
    """The EPSG number that a document names in itself, GeoJSON by its crs member and KML by an srs or crs element; 4326 if it names none, null if it is neither."""
    named = F.nullif(F.regexp_extract(content, r"<(?:\w+:)?(?:srs|crs)>\s*([^<]+?)\s*</", 1), F.lit(""))
    geojson = F.coalesce(parse_name(F.get_json_object(content, "$.crs.properties.name")), F.lit(4326))
    return F.when(F.ltrim(content).startswith("{"), geojson).when(F.ltrim(content).startswith("<"), F.coalesce(parse_name(named), F.lit(4326)))


def transformed(x: Column, y: Column, z: Column, source: Column, target: Column) -> Column:
    """x, y, z as it is, and a description, of a point in another system: 4326, 3857 or a UTM zone; null of others."""
    zone, north = lambda e: e % 100, lambda e: F.floor(e / 100) == 326
    utm = lambda e: F.floor(e / 100).isin(326, 327) & zone(e).between(1, 60)
    mx, my = from_web_mercator(x, y)
    ux, uy = from_utm(x, y, zone(source), north(source))
    lon = F.when(source == 4326, x).when(source == 3857, mx).when(utm(source), ux)
    lat = F.when(source == 4326, y).when(source == 3857, my).when(utm(source), uy)

    def out(p: Column) -> Column:
        wx, wy = web_mercator(p["lon"], p["lat"])
        tx, ty = to_utm(p["lon"], p["lat"], zone(target), north(target))
        known = p["lon"].isNotNull() & ((target == 4326) | (target == 3857) | utm(target))
        return F.when(known, F.struct(
            F.when(target == 4326, p["lon"]).when(target == 3857, wx).otherwise(tx).alias("x"), F.when(target == 4326, p["lat"]).when(target == 3857, wy).otherwise(ty).alias("y"),
            z.alias("z"), F.concat(F.lit("EPSG:"), source, F.lit(" to EPSG:"), target).alias("description"),
        ))

    return F.transform(F.array(F.struct(lon.alias("lon"), lat.alias("lat"))), out)[0]


def haversine_feet(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2.0), 2)
    return 20902231.0 * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))
