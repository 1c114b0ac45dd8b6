"""Setbacks, buildable area by cells, breaches, and business rules of constraints and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions import features as P
from plotwright.functions import geometry as G
from plotwright.tables import written

from . import spatial


def near(ring: Column, x: Column, y: Column, distance: float) -> Column:
    """Whether a point lies in a ring grown by a distance."""
    return G.in_ring(x, y, ring) | (G.line_distance(x, y, ring) <= distance)


def well_inside(ring: Column, x: Column, y: Column, distance: Column | float) -> Column:
    """Whether a point lies in a ring shrunk by a distance."""
    return G.in_ring(x, y, ring) & (G.line_distance(x, y, ring) >= distance)


def setback_rows(features: DataFrame) -> DataFrame:
    """features (kind, subkind) with distance_m, severity and priority by the kind's table, its default where the subkind is unknown."""
    k, s = F.col("kind"), F.col("subkind")
    metres = (
        F.when(k == "property", P.lookup(s, P.PROPERTY_SETBACK, 7.62)).when(k == "road", P.lookup(s, P.ROAD_SETBACK, 15.24)).when(k == "water", P.lookup(s, P.WATER_SETBACK, 15.24))
        .when(k == "utility", P.lookup(s, P.UTILITY_SETBACK, 9.14)).when(k == "building", P.BUILDING_SETBACK).otherwise(10.0)
    )
    return features.withColumns({"distance_m": metres, "severity": F.lit("blocking"), "priority": F.when(k == "water", "critical").otherwise("high")})


def stages(cells: DataFrame, site_ring: Column, setback: float, zones: DataFrame, exclusions: DataFrame, cell: float) -> DataFrame:
    """Cells with one flag a stage of the buildable area: in_site, off_setback, in_zone, not_excluded.

    zones and exclusions: site_id, id, ring. Each covers cells by a zonal join; nothing is merged into one shape.
    """
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    key = ["dem_id", "row", "col"]
    covered = lambda shapes, name: spatial.zonal(cells.select(*key), shapes, cell).select(*key).distinct().withColumn(name, F.lit(True))
    met = cells.join(covered(zones, "in_zone"), key, "left").join(covered(exclusions, "excluded"), key, "left")
    return met.withColumns({"in_site": G.in_ring(x, y, site_ring), "off_setback": well_inside(site_ring, x, y, setback), "in_zone": F.coalesce("in_zone", F.lit(False)), "not_excluded": F.col("excluded").isNull()}).drop("excluded")


def stage_areas(staged: DataFrame, cell: float) -> DataFrame:
    """Per raster the area left after each stage, and a hint at the first stage that leaves none."""
    left, columns = F.lit(True), {}
    for name in ("in_site", "off_setback", "in_zone", "not_excluded"):
        left = left & F.col(name)
        columns[name] = F.count_if(left) * cell * cell
    found = staged.groupBy("dem_id").agg(*[c.alias(f"after_{n}") for n, c in columns.items()])
    hint = (
        F.when(F.col("after_in_site") == 0, "the site has no area").when(F.col("after_off_setback") == 0, "setbacks take the whole site").when(F.col("after_in_zone") == 0, "no buildable zone beyond the setbacks")
        .when(F.col("after_not_excluded") == 0, "exclusions take all buildable zones").otherwise("there is room")
    )
    return found.withColumn("hint", hint)


def breaches(assets: DataFrame, sites: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows site_id, asset_id, other, kind, severity: overlaps, assets outside, assets on zones (a zone's severity high is an error)."""
    over = spatial.overlaps(assets).select("site_id", F.col("a_id").alias("asset_id"), F.col("b_id").alias("other"), F.lit("overlap").alias("kind"), F.lit("error").alias("severity"))
    out = spatial.outside(assets, sites).select("site_id", F.col("id").alias("asset_id"), F.lit(None).cast("long").alias("other"), F.lit("boundary").alias("kind"), F.lit("error").alias("severity"))
    level = zones.select("site_id", F.col("id").alias("zone_id"), F.when(F.col("severity") == "high", "error").otherwise("warning").alias("severity"))
    on = spatial.on_zones(assets, zones).join(level, ["site_id", "zone_id"]).select("site_id", "asset_id", F.col("zone_id").cast("long").alias("other"), F.lit("exclusion").alias("kind"), "severity")
    return over.unionByName(out).unionByName(on)


def constraint_rules(c: DataFrame) -> Column:
    """What speaks against a constraint row (kind, distance_m, reason, severity, reference, priority, verified_days)."""
    k = F.col("kind")
    blank = lambda col: F.coalesce(F.trim(F.col(col)) == "", F.lit(True))
    return F.array_compact(F.array(
        F.when((k == "setback") & (F.col("distance_m") > 1000.0), "setback over a kilometre"), F.when((k == "exclusion") & blank("reason"), "exclusion without a reason"),
        F.when((k == "exclusion") & (F.col("severity") != "blocking"), "exclusion does not block"), F.when((k == "regulatory") & blank("reference"), "regulation without a reference"),
        F.when((k == "regulatory") & (F.col("severity") == "low"), "regulation of low severity"), F.when((k == "regulatory") & (F.col("verified_days") > 365), "not verified for a year"),
        F.when((k == "user") & (F.col("priority") == "critical"), "user rule marked critical"),
    ))


def expiry_rules(permanent: Column, expires: Column, today: Column) -> Column:
    return F.array_compact(F.array(F.when(permanent & expires.isNotNull(), "permanent but expires"), F.when(~permanent & expires.isNull(), "temporary but does not expire"), F.when(expires < today, "expired")))


def asset_rules(a: DataFrame) -> Column:
    """What speaks against an asset row (type, slope_limit, height, storeys, width, length, spaces, accessible)."""
    t, size = F.col("type"), F.col("width") * F.col("length")
    return F.array_compact(F.array(
        F.when((t == "building") & (F.col("slope_limit") > 15.0), "building on steep ground"), F.when((t == "building") & (F.col("height") < 2.5 * F.col("storeys")), "storeys lower than 2.5 m"),
        F.when(F.least("width", "length") < 3.0, "too narrow"), F.when((t == "parking") & (size < 25.0 * F.col("spaces")), "under 25 square metres a space"),
        F.when((t == "parking") & (F.col("accessible") < 0.04 * F.col("spaces")), "too few accessible spaces"),
    ))


def buffer_union(cells: DataFrame, shapes: DataFrame, distance: float, cell: float) -> DataFrame:
    """Per raster the area, in cells, of the union of its shapes (site_id, id, ring) grown by a distance."""
    b = G.bounds(F.col("ring"))
    low, high = (lambda c: F.floor((b[c] - distance) / cell)), (lambda c: F.floor((b[c] + distance) / cell))
    at = shapes.select(F.col("site_id").alias("dem_id"), "ring", F.explode(F.sequence(low("min_y").cast("int"), high("max_y").cast("int"))).alias("row"), low("min_x").alias("c0"), high("max_x").alias("c1"))
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    met = cells.join(at, ["dem_id", "row"]).where(F.col("col").between(F.col("c0"), F.col("c1")) & near(F.col("ring"), x, y, distance))
    return met.select("dem_id", "row", "col").distinct().groupBy("dem_id").agg((F.count("*") * cell * cell).alias("area"))


def checked_moves(moves: DataFrame, assets: DataFrame, sites: DataFrame, zones: DataFrame) -> DataFrame:
    """moves (assets in their new places) with the number of errors against the other assets, their site and its zones.

    Equal rings are one kind, and the assets of a kind are counted, not listed; an asset's own old place is no error.
    """
    key = ["site_id", "ring"]
    old, new = spatial.known_kinds(assets, "ring"), spatial.known_kinds(moves, "ring")
    met = spatial.pairs(new, old).where(spatial.common_area() > 1e-9).groupBy("site_id", F.col("a_id").alias("kind")).agg(F.sum("b_n").alias("n"))
    met = written(met, "met")
    all_ = moves.select("id", *key).join(new.select(*key, F.col("id").alias("kind")).hint("merge"), key).join(met.hint("merge"), ["site_id", "kind"]).select("site_id", "id", "n")
    side = lambda df, p: spatial.known(df).select("site_id", "id", *[F.col(c).alias(f"{p}_{c}") for c in ("ring", "upright", "plain")])
    itself = side(moves, "a").join(side(assets, "b").hint("merge"), ["site_id", "id"]).where(spatial.common_area() > 1e-9).select("site_id", "id", F.lit(-1).cast("long").alias("n"))
    severe = zones.where("severity = 'high'")
    others = spatial.outside(moves, sites).unionByName(spatial.on_zones(moves, severe).select("site_id", F.col("asset_id").alias("id")))
    others = written(others, "others")
    rows = all_.unionByName(itself).unionByName(others.select("site_id", "id", F.lit(1).cast("long").alias("n")))
    n = rows.groupBy("site_id", "id").agg(F.sum("n").alias("n_errors"))
    return moves.join(n.hint("merge"), ["site_id", "id"], "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0))).withColumn("is_valid", F.col("n_errors") == 0)
