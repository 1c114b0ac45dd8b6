"""Observation logs, feature tables and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions import features as P
from plotwright.functions import geometry as G

from . import spatial


def tiles_of(boxes: DataFrame) -> DataFrame:
    """boxes (id, min_x, min_y, max_x, max_y) with the one-degree tiles that they meet."""
    span = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int")))
    at = boxes.withColumn("south", span("min_y", "max_y")).withColumn("west", span("min_x", "max_x"))
    name = F.format_string("dem_%s%02d_%s%03d.tif", F.when(F.col("south") >= 0, "n").otherwise("s"), F.abs("south"), F.when(F.col("west") >= 0, "e").otherwise("w"), F.abs("west"))
    return at.withColumn("tile", name)


def with_setbacks(features: DataFrame) -> DataFrame:
    """features (tags) with class and setback_m, the distance that their kind asks for."""
    t = F.col("tags")
    kind = P.feature_class(t)
    road = P.lookup(P.lookup(P.road_class(F.try_element_at(t, F.lit("highway"))), P.ROAD_TYPE), P.ROAD_SETBACK)
    metres = (
        F.when(kind == "building", P.BUILDING_SETBACK).when(kind == "road", road).when(kind == "utility", P.lookup(P.utility_class(t), P.UTILITY_SETBACK)).when(kind == "water", P.lookup(P.water_class(t), P.WATER_SETBACK))
    )
    return features.withColumns({"class": kind, "setback_m": metres})


def way_lines(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and line (x, y in order) of refs (way_id, pos, ref) and nodes (id, x, y); unknown nodes are dropped, ways of one left too."""
    met = refs.join(nodes, refs["ref"] == nodes["id"]).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "x", "y"))).alias("n"))
    return met.where(F.size("n") >= 2).select("way_id", F.transform("n", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def flood_on_sites(zones: DataFrame, sites: DataFrame, least_area: float = 1.0) -> DataFrame:
    """High-risk flood zones (site_id, id, code, convex ring) that share more than an area with their site (site_id, ring), and how much."""
    risky = zones.withColumn("zone", P.flood_zone(F.col("code"))).where(P.high_risk(F.col("zone"))).select("site_id", "id", "zone", "ring")
    met = spatial.pairs(risky, sites.withColumn("id", F.col("site_id")).select("site_id", "id", "ring")).withColumn("area", G.clip_area(F.col("a_ring"), F.col("b_ring")))
    return met.where(F.col("area") > least_area).select("site_id", F.col("a_id").alias("id"), F.col("a_zone").alias("zone"), "area")


def flood_summary(features: DataFrame) -> DataFrame:
    """Per location: zones, the one of highest risk, whether any is a hazard area (then insurance is asked for), highest base flood elevation."""
    zoned = features.withColumn("zone", P.flood_zone(F.col("code")))
    hazard = F.bool_or(P.high_risk(F.col("zone")))
    return zoned.groupBy("location").agg(F.count("*").alias("n_zones"), F.min_by("zone", P.risk_rank(F.col("zone"))).alias("highest"), hazard.alias("in_hazard_area"), hazard.alias("insurance_required"), F.max("bfe").alias("max_bfe"), F.array_sort(F.collect_set("zone")).alias("zones"))


def flood_constraints(features: DataFrame) -> DataFrame:
    """One row a location in a hazard area: its first high-risk zone and the severity of that."""
    risky = features.withColumn("zone", P.flood_zone(F.col("code"))).where(P.high_risk(F.col("zone")))
    first = risky.groupBy("location").agg(F.min_by("zone", "seq").alias("zone"))
    return first.withColumn("severity", F.when(F.col("zone").isin("V", "VE", "AE", "AH", "AO"), "high").otherwise("medium"))


def batch_statistics(observed: DataFrame) -> DataFrame:
    return observed.groupBy("key").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("span"))


def batch_status(observed: DataFrame, failed: Column) -> DataFrame:
    good, bad = F.count_if(~failed), F.count_if(failed)
    return observed.groupBy("key").agg(good.alias("n_good"), bad.alias("n_failed"), F.when(bad == 0, "SUCCESS").when(good == 0, "FAILED").otherwise("PARTIAL").alias("status"))


def latest(observed: DataFrame, now: Column, ttl: str) -> DataFrame:
    """Per key its latest observation that is not older than the time to live; ties by id."""
    others = [c for c in observed.columns if c != "key"]
    fresh = observed.where(F.col("ts") >= now - F.expr(f"INTERVAL {ttl}"))
    return fresh.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("ts", "id")).alias("of")).select("key", "of.*")


def evicted(entries: DataFrame, capacity: int) -> DataFrame:
    """The oldest tenth of the capacity, once there are as many entries: a top-k, no global sort."""
    return entries.orderBy("ts", "key").limit(capacity // 10) if entries.limit(capacity).count() >= capacity else entries.limit(0)


def expired(uploads: DataFrame, now: Column, retention: str, done: tuple[str, ...], keep: DataFrame) -> DataFrame:
    old = uploads.where((F.col("ts") < now - F.expr(f"INTERVAL {retention}")) & F.col("status").isin(*done))
    return old.join(keep, "id", "left_anti")


def with_other(items: DataFrame, least_share: float) -> DataFrame:
    """items (site_id, item, cost) with those under a share of the site's total joined as Other."""
    share = F.col("cost") / F.sum("cost").over(Window.partitionBy("site_id"))
    return items.withColumn("item", F.when(share < least_share, "Other").otherwise(F.col("item"))).groupBy("site_id", "item").agg(F.sum("cost").alias("cost"))


def top(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key with their place, and how many more there are."""
    by = Window.partitionBy(key)
    ranked = rows.withColumns({"place": F.row_number().over(by.orderBy(*[F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o) for o in order])).cast("long"), "more": F.count("*").over(by) - n})
    return ranked.where(F.col("place") <= n)


def upsert(old: DataFrame, new: DataFrame, key: list[str], gone: DataFrame | None = None) -> DataFrame:
    """old with rows of new in place of those of equal key, without the keys that are gone."""
    whole = new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)
    return whole.join(gone, key, "left_anti") if gone is not None else whole
