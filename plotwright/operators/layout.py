"""Layouts: asset rows, candidates, objectives, fitness, ranking, diversity, results.

Layouts are assets times solutions, more rows than Spark can know when it plans; their joins name the sort-merge join,
so that the driver does not collect them to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions import geometry as G
from plotwright.tables import written

from . import spatial
from .earthwork import CUBIC_YARDS

#: Fixed values.
WEIGHTS = {"cut_fill": 0.3, "accessibility": 0.25, "road_length": 0.2, "compactness": 0.15, "slope_variance": 0.1}
COVERAGE_LIMIT = 40.0


def expanded(configs: DataFrame) -> DataFrame:
    """configs (site_id, type, quantity, width_ft, length_ft) as asset rows in metres, with ids type_i; a parking asset's spaces."""
    rows = configs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("quantity") - 1))).where("quantity > 0")
    w, ln = F.col("width_ft") * 0.3048, F.col("length_ft") * 0.3048
    spaces = F.when(F.col("type") == "parking", F.greatest(F.lit(1), F.floor(w * ln / 25.0).cast("int")))
    return rows.select("site_id", F.concat_ws("_", "type", "i").alias("asset_id"), "type", w.alias("width"), ln.alias("length"), spaces.alias("spaces"))


def drawn(*of) -> Column:
    """A number from 0 to 1 drawn by a hash of what is given."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 8), 16, 10).cast("double") / 2.0**32


def candidates(assets: DataFrame, population: int, span: float, seed: int = 42) -> DataFrame:
    """Every asset placed once in each member of a population: place and quarter turns by hashes of seed, site, member and asset."""
    rows = assets.withColumn("solution_id", F.explode(F.sequence(F.lit(0), F.lit(population - 1))))
    share = lambda k: drawn(F.lit(seed), "site_id", "solution_id", "id", F.lit(k))
    return rows.withColumns({"x": share(1) * span, "y": share(2) * span, "rotation": F.floor(share(3) * 4.0) * 90.0})


def placed(assets: DataFrame) -> DataFrame:
    """assets (x, y, width, length, rotation) with ring."""
    return assets.withColumn("ring", G.footprint(F.col("x"), F.col("y"), F.col("width"), F.col("length"), F.col("rotation")))


def objectives(layouts: DataFrame, entry: tuple[float, float], reach: float = 1000.0) -> DataFrame:
    """Per solution of each site: accessibility, road length and compactness scores, total area."""
    middle = Window.partitionBy("site_id", "solution_id")
    away = F.sqrt(F.pow(F.col("x") - F.avg("x").over(middle), 2) + F.pow(F.col("y") - F.avg("y").over(middle), 2))
    to_entry = F.sqrt(F.pow(F.col("x") - entry[0], 2) + F.pow(F.col("y") - entry[1], 2))
    b = G.bounds(F.col("ring"))
    rows = layouts.select("site_id", "solution_id", away.alias("away"), to_entry.alias("road"), (F.col("width") * F.col("length")).alias("area"), b.alias("b"))
    box = (F.max("b.max_x") - F.min("b.min_x")) * (F.max("b.max_y") - F.min("b.min_y"))
    return rows.groupBy("site_id", "solution_id").agg(
        F.count("*").alias("n_assets"), F.sum("area").alias("area"), (100.0 * (1.0 - F.least(F.avg("away") / 200.0, F.lit(1.0)))).alias("accessibility"),
        (100.0 * F.greatest(F.lit(0.0), 1.0 - F.sum("road") / reach)).alias("road_length"), F.when(F.count("*") < 2, 100.0).otherwise(100.0 * F.least(F.sum("area") / box, F.lit(1.0))).alias("compactness"),
    )


def terrain_objectives(layouts: DataFrame, cells: DataFrame, cell: float, raster: str = "site_id") -> DataFrame:
    """Per solution: cut-and-fill score from the variance of heights under footprints, slope score from slopes' means; raster names the layouts' column that gives a site's raster."""
    shapes = layouts.select(F.col(raster).alias("raster"), F.struct("site_id", "solution_id", "id").alias("id"), "ring").withColumnRenamed("raster", "site_id")
    under = spatial.zonal(cells, shapes, cell).groupBy("shape_id").agg(F.var_pop("z").alias("v"), F.avg("slope_percent").alias("s"))
    found = under.groupBy("shape_id.site_id", "shape_id.solution_id").agg(F.avg("v").alias("v"), F.avg("s").alias("s"), F.var_pop("s").alias("sv"))
    flat = F.greatest(F.lit(0.0), 1.0 - F.col("s") / 25.0) * 60.0 + F.greatest(F.lit(0.0), 1.0 - F.col("sv") / 50.0) * 40.0
    return found.select("site_id", "solution_id", (100.0 * F.greatest(F.lit(0.0), 1.0 - F.col("v") / 4.0)).alias("cut_fill"), flat.alias("slope_variance"))


def violations(layouts: DataFrame, buildable: DataFrame, zones: DataFrame, site_area: float) -> DataFrame:
    """Per solution the breaches: overlapping pairs, pairs closer than the first one's spacing, assets not wholly in the
    buildable area (site_id, parts), assets on zones, coverage over the limit. An overlap counts as a lack of spacing, too."""
    key = F.struct("site_id", "solution_id")
    split = lambda df, n: df.select(F.col("site_id.site_id").alias("site_id"), F.col("site_id.solution_id").alias("solution_id"), n.cast("long").alias("n"))
    own = written(spatial.known(layouts.select(key.alias("site_id"), "id", "ring", "spacing"), "spacing"), "layouts")
    reach = own.withColumn("reach", F.greatest(F.col("spacing"), F.lit(0.0)))  # an overlap is one whatever the spacing
    near = spatial.pairs(reach, own, "reach").where("a_id < b_id").withColumns({"met": spatial.common_area() > 1e-9, "close": F.coalesce(spatial.apart() <= F.col("a_spacing"), F.lit(False))})
    out = layouts.join(buildable.hint("merge"), "site_id").where(~F.forall("ring", lambda p: G.contains(F.col("parts"), p["x"], p["y"]))).select("site_id", "solution_id", F.lit(1).cast("long").alias("n"))
    gone = zones.select("site_id", F.col("id").alias("zone"), F.col("ring").alias("zr"))
    each = layouts.select("site_id", "solution_id").distinct().join(gone.hint("merge"), "site_id")
    on = spatial.pairs(own, spatial.known(each.select(key.alias("site_id"), F.col("zone").alias("id"), F.col("zr").alias("ring")))).where(spatial.common_area() > 0.1)
    area = layouts.groupBy("site_id", "solution_id").agg((F.sum(F.col("width") * F.col("length")) * 100.0 / site_area).alias("c")).where(F.col("c") > COVERAGE_LIMIT)
    parts = [written(split(df, n), "breaches") for df, n in ((near, F.col("met").cast("int") + F.col("close").cast("int")), (on, F.lit(1)))]
    rows = parts[0].unionByName(parts[1]).unionByName(out).unionByName(area.select("site_id", "solution_id", F.lit(1).cast("long").alias("n")))
    return rows.groupBy("site_id", "solution_id").agg(F.sum("n").alias("n_violations")).where("n_violations > 0")


def fitness(scores: dict[str, Column], breaches: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of the objectives at hand, or a penalty for breaches; weights must come to one."""
    if min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must not be negative and must sum to one")
    total = sum((F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in scores.items()), F.lit(0.0))
    return F.when(breaches > 0, -10_000.0 * F.pow(breaches, 1.5)).otherwise(total)


def diversity(layouts: DataFrame, best: DataFrame) -> DataFrame:
    """Per solution how far its assets lie from those of its site's best (site_id, solution_id), 0 to 1."""
    reference = layouts.join(best.select("site_id", "solution_id").hint("merge"), ["site_id", "solution_id"]).select("site_id", "id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("rotation").alias("br"))
    moved = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2)) + F.abs(F.col("rotation") - F.col("br")) / 10.0
    return layouts.join(reference.hint("merge"), ["site_id", "id"]).groupBy("site_id", "solution_id").agg(F.least(F.avg(moved) / 100.0, F.lit(1.0)).alias("diversity"))


def alternatives(scored: DataFrame, layouts: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """Each site's best solution and the k next by fitness mixed with diversity; scored: site_id, solution_id, fitness."""
    best = scored.groupBy("site_id").agg(F.max_by("solution_id", F.struct("fitness", -F.col("solution_id"))).alias("solution_id"))
    others = scored.join(best.hint("merge"), ["site_id", "solution_id"], "left_anti").join(diversity(layouts, best).hint("merge"), ["site_id", "solution_id"])
    mixed = others.withColumn("mixed", (1.0 - weight) * F.col("fitness") + weight * F.col("diversity") * 100.0)
    ranked = mixed.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("mixed"), "solution_id"))).where(F.col("place") <= k)
    return best.select("site_id", "solution_id", F.lit(0).alias("place")).unionByName(ranked.select("site_id", "solution_id", "place"))


def elite(scored: DataFrame, share: float) -> DataFrame:
    """The best share of each site's solutions, rounded up."""
    w = Window.partitionBy("site_id")
    return scored.withColumns({"place": F.row_number().over(w.orderBy(F.desc("fitness"), "solution_id")), "n": F.count("*").over(w)}).where(F.col("place") <= F.ceil(F.col("n") * share)).drop("n")


def tournament(scored: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Groups of about that size drawn by hash from each site's solutions, and the best of each."""
    group = F.floor(F.row_number().over(Window.partitionBy("site_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "solution_id")), "solution_id")) / size)
    return scored.withColumn("group", group).groupBy("site_id", "group").agg(F.max_by("solution_id", F.struct("fitness", -F.col("solution_id"))).alias("solution_id"))


def zipped(assets: DataFrame, order: str, places: DataFrame, by: str) -> DataFrame:
    """assets with the place of the same ordinal in their site."""
    turn = lambda c: F.row_number().over(Window.partitionBy("site_id").orderBy(c))
    return assets.withColumn("__k", turn(order)).join(places.withColumn("__k", turn(by)), ["site_id", "__k"], "left").drop("__k", by)


#: Cut and fill in cubic metres a square metre of an asset without terrain; costs a cubic yard cut and
#: filled, a square metre of an asset, a metre of road, and a road segment as if it were fifty metres long.
FLAT_CUT, FLAT_FILL = 0.5, 0.3
CUT_RATE, FILL_RATE, ASSET_RATE, ROAD_RATE, SEGMENT_METRES = 15.0, 12.0, 500.0, 100.0, 50.0
CONTINGENCY = 0.1
SQUARE_FEET = 0.092903


def project_costs(layouts: DataFrame, earth: DataFrame, segments: DataFrame, sites: DataFrame, area_in_feet: bool = False) -> DataFrame:
    """Per solution: cut, fill (cubic yards), earthwork, road_length, roads, assets, total, area_used (percent of the site).

    layouts: site_id, solution_id, id, width, length; earth: site_id, solution_id, id, cut, fill of assets on terrain,
    the others count by their area; segments: site_id, solution_id, length, a row a road segment; sites: site_id, area.
    With area_in_feet the site's area is taken for square feet, as the surveyed system does.
    """
    key = ["site_id", "solution_id"]
    area = F.col("width") * F.col("length")
    each = layouts.select(*key, "id", area.alias("area")).join(earth.select(*key, "id", "cut", "fill").hint("merge"), [*key, "id"], "left")
    moved = lambda c, share: F.sum(F.coalesce(c, F.col("area") * share * CUBIC_YARDS))
    own = each.groupBy(key).agg(moved("cut", FLAT_CUT).alias("cut"), moved("fill", FLAT_FILL).alias("fill"), F.sum("area").alias("area"))
    roads = segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum("length").alias("road_length"))
    site = sites.select("site_id", (F.col("area") * (SQUARE_FEET if area_in_feet else 1.0)).alias("site_area"))
    met = own.join(roads.hint("merge"), key, "left").join(site.hint("merge"), "site_id", "left")
    met = met.withColumns({
        "earthwork": F.col("cut") * CUT_RATE + F.col("fill") * FILL_RATE, "road_length": F.coalesce("road_length", F.lit(0.0)),
        "roads": F.coalesce("n_segments", F.lit(0)) * (ROAD_RATE * SEGMENT_METRES), "assets": F.col("area") * ASSET_RATE,
        "area_used": F.try_divide(F.col("area"), F.col("site_area")) * 100.0,
    })
    return met.withColumn("total", F.col("earthwork") + F.col("roads") + F.col("assets")).select(*key, "cut", "fill", "earthwork", "road_length", "roads", "assets", "total", "area_used")


def results(costs: DataFrame, scored: DataFrame) -> DataFrame:
    """Per solution its metrics: total of costs, of it roads by length, assets as what is left, contingency, balance of cut and fill, score.

    costs as project_costs() gives them; scored: site_id, solution_id, fitness in percent.
    """
    met = costs.join(scored.select("site_id", "solution_id", "fitness").hint("merge"), ["site_id", "solution_id"])
    roads = F.col("road_length") * ROAD_RATE
    return met.select(
        "site_id", "solution_id", "earthwork", roads.alias("road_cost"), F.greatest(F.lit(0.0), F.col("total") / (1.0 + CONTINGENCY) - F.col("earthwork") - roads).alias("asset_cost"),
        (F.col("total") * CONTINGENCY).alias("contingency"), "total", F.when(F.col("fill") > 0, F.col("cut") / F.col("fill")).otherwise(0.0).alias("balance_ratio"), (F.col("fitness") / 100.0 * 100.0).alias("score"),
    )


#: Names of the weights at the user's side, and the objectives that they stand for.
RENAMED = {"cost": "cut_fill", "accessibility": "accessibility", "aesthetics": "road_length", "buildable_area": "compactness", "environmental": "slope_variance"}


def checked_weights(weights: DataFrame) -> DataFrame:
    """Percentages by the user's names as shares by objective, and whether they come to a hundred."""
    total = sum((F.col(c) for c in RENAMED), F.lit(0))
    return weights.select("*", (F.abs(total - 100) <= 0.01).alias("is_valid"), *[(F.col(c) / 100.0).alias(f"__{o}") for c, o in RENAMED.items()]).drop(*RENAMED).withColumnsRenamed({f"__{o}": o for o in RENAMED.values()})


def moved(assets: DataFrame, dx: Column, dy: Column, turn: Column) -> DataFrame:
    return placed(assets.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "rotation": F.pmod(F.col("rotation") + turn, F.lit(360.0))}))


def merged_configs(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new's map entries over its own, and new's other values where there are any."""
    others = [c for c in old.columns if c not in ("id", "config")]
    n = new.select("id", F.col("config").alias("__config"), *[F.col(c).alias(f"__{c}") for c in others])
    kept = F.map_filter("config", lambda k, v: ~F.coalesce(F.map_contains_key("__config", k), F.lit(False)))
    whole = F.map_concat(kept, F.coalesce("__config", F.expr("cast(map() as map<string,string>)")))
    return old.join(n, "id", "left").select("id", whole.alias("config"), *[F.coalesce(f"__{c}", c).alias(c) for c in others])
