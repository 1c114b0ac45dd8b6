"""Earthwork: graded surfaces, cut and fill, volumes, costs, balance, sections.

Depths are in feet, cells in metres; volumes come in cubic yards. A positive depth is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spatial

FEET = 3.28084
#: Fixed value: cubic yards of a cubic metre.
CUBIC_YARDS = 1.30795

#: Shrink and swell factors by soil, unit costs in dollars.
SOILS = {"clay": (1.25, 1.30), "sand": (1.10, 1.15), "rock": (1.50, 1.60), "loam": (1.15, 1.20), "mixed": (1.20, 1.25)}
COSTS = {"excavation": 5.0, "fill": 8.0, "haul": 2.5, "import": 25.0, "export": 15.0, "rock": 35.0, "compaction": 3.5}


def soils(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SOILS.items()], "soil string, shrink double, swell double")


def unit_costs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COSTS.items()), "item string, dollars double")


def depths(before: DataFrame, after: DataFrame) -> DataFrame:
    """dem_id, row, col, pre, post and depth of the cells of either surface; no depth where either lacks a value."""
    key = ["dem_id", "row", "col"]
    met = before.select(*key, F.col("z").alias("pre")).join(after.select(*key, F.col("z").alias("post")), key, "full")
    return met.withColumn("depth", F.coalesce(F.col("pre") - F.col("post"), F.lit(0.0)))


def volumes(cut_fill: DataFrame, sites: DataFrame, cell: float, adjusted: bool = True) -> DataFrame:
    """Per raster: volumes, areas and mean depths; sites gives each one's soil (dem_id, soil)."""
    d, area = F.col("depth"), (cell * FEET) ** 2
    cut, fill = F.when(d > 0, d), F.when(d < 0, -d)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = cut_fill.groupBy("dem_id").agg(
        (zero(F.sum(cut)) * area / 27.0).alias("cut_cy"), (zero(F.sum(fill)) * area / 27.0).alias("fill_cy"), (F.count(cut) * area).alias("cut_area_sf"), (F.count(fill) * area).alias("fill_area_sf"),
        zero(F.avg(cut)).alias("mean_cut_ft"), zero(F.avg(fill)).alias("mean_fill_ft"),
    )
    factors = soils(cut_fill.sparkSession)
    loose = F.col("cut_cy") * (F.col("swell") if adjusted else 1.0)
    packed = F.col("fill_cy") * (F.col("shrink") if adjusted else 1.0)
    met = found.join(sites.select("dem_id", "soil"), "dem_id").join(F.broadcast(factors), "soil")
    return met.withColumns({"net_cy": loose - packed, "balanced_cy": F.least(packed, loose), "import_cy": F.greatest(packed - loose, F.lit(0.0)), "export_cy": F.greatest(loose - packed, F.lit(0.0))}).drop("shrink", "swell")


def costs(found: DataFrame, haul_miles: float = 0.25) -> DataFrame:
    """found (as volumes() gives it) with six costs and their total."""
    items = {
        "excavation_cost": F.col("cut_cy") * COSTS["excavation"], "fill_cost": F.col("fill_cy") * COSTS["fill"], "haul_cost": F.col("balanced_cy") * haul_miles * COSTS["haul"],
        "import_cost": F.col("import_cy") * COSTS["import"], "export_cost": F.col("export_cy") * COSTS["export"], "compaction_cost": F.col("fill_cy") * COSTS["compaction"],
    }
    return found.withColumns(items).withColumn("total_cost", sum((F.col(c) for c in items), F.lit(0.0)))


def balance(cut_fill: DataFrame, found: DataFrame, cell: float) -> DataFrame:
    """Per raster: fill over cut, whether within a tenth, haul between the centroids in miles, recommendations."""
    d = F.col("depth")
    mid = lambda c, k: F.avg(F.when(k, F.col(c)))
    centres = cut_fill.groupBy("dem_id").agg(mid("row", d > 0).alias("cr"), mid("col", d > 0).alias("cc"), mid("row", d < 0).alias("fr"), mid("col", d < 0).alias("fc"))
    haul = F.sqrt(F.pow(F.col("cr") - F.col("fr"), 2) + F.pow(F.col("cc") - F.col("fc"), 2)) * cell * FEET / 5280.0
    ratio = F.when(F.col("cut_cy") > 0, F.col("fill_cy") / F.col("cut_cy")).otherwise(0.0)
    whole = lambda c: F.format_string("%.0f", c)
    advice = F.array_compact(F.array(
        F.when(F.col("is_balanced"), "cut and fill are in balance").when(F.col("ratio") < 0.9, F.concat(F.lit("import "), whole("import_cy"), F.lit(" cubic yards"))).otherwise(F.concat(F.lit("export "), whole("export_cy"), F.lit(" cubic yards"))),
        F.when(~F.col("is_balanced"), F.when(F.col("ratio") < 0.9, "raise the finished grade").otherwise("lower the finished grade")),
        F.when(F.col("haul_miles") > 0.5, "bring cut and fill closer together"),
    ))
    met = found.join(centres, "dem_id").withColumns({"ratio": ratio, "haul_miles": F.coalesce(haul, F.lit(0.0))}).withColumn("is_balanced", F.col("ratio").between(0.9, 1.1))
    return met.select("dem_id", "ratio", "is_balanced", "haul_miles", advice.alias("advice"))


def profile(cells: DataFrame, lines: DataFrame, cell: float, samples: int = 100) -> DataFrame:
    """Per line (dem_id, line_id, x0, y0, x1, y1) evenly spaced samples: i, feet along, z of the cell below (null outside)."""
    i = F.col("i")
    spaced = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i")).withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * i / (samples - 1), "y": F.col("y0") + (F.col("y1") - F.col("y0")) * i / (samples - 1)})
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) * FEET
    at = spaced.withColumns({"row": (F.col("y") / cell).cast("int"), "col": (F.col("x") / cell).cast("int"), "feet": length * i / (samples - 1)})
    return at.join(cells.select("dem_id", "row", "col", "z"), ["dem_id", "row", "col"], "left").select("dem_id", "line_id", "i", "feet", "row", "col", "z")


def section(before: DataFrame, after: DataFrame, lines: DataFrame, cell: float, samples: int = 100) -> DataFrame:
    """Per line: mean depth of change and the volume of a one-foot strip along it."""
    key = ["dem_id", "line_id", "i"]
    pre, post = profile(before, lines, cell, samples), profile(after, lines, cell, samples)
    met = pre.select(*key, "feet", F.col("z").alias("pre")).join(post.select(*key, F.col("z").alias("post")), key)
    change = F.abs(F.col("pre") - F.col("post"))
    return met.groupBy("dem_id", "line_id").agg(F.avg(change).alias("mean_change"), F.max("feet").alias("length_ft"), (F.avg(change) * F.max("feet") / 27.0).alias("volume_cy"))


def graded(cells: DataFrame, covers: DataFrame) -> DataFrame:
    """cells with graded and z by the zone of highest priority (of equal ones the last listed) over each.

    covers: dem_id, row, col, priority, seq, kind (pad or swale), target, slope and feet (a swale's fall per
    hundred feet and the way along it). A pad without a target grades a cell without moving it.
    """
    best = covers.groupBy("dem_id", "row", "col").agg(F.max_by(F.struct("kind", "target", "slope", "feet"), F.struct("priority", "seq")).alias("of"))
    z = F.when(F.col("of.kind") == "swale", F.lit(100.0) - F.col("of.feet") * F.col("of.slope") / 100.0).otherwise(F.coalesce("of.target", "z"))
    return cells.join(best.hint("merge"), ["dem_id", "row", "col"], "left").select(*[c for c in cells.columns if c != "z"], F.when(F.col("of").isNull(), F.col("z")).otherwise(z).alias("z"), F.col("of").isNotNull().alias("graded"))


def covers(cells: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """What graded() asks of grading zones with a geometry: a row for each zone over each cell.

    zones: dem_id, seq, priority, kind, target, slope, and ring or parts; a swale falls along its way from its shape's
    left side, feet being the distance of the cell's middle from there.
    """
    shape = "parts" if "parts" in zones.columns else "ring"
    own = zones.withColumn("id", F.struct("seq", "priority", "kind", "target", "slope", F.array_min(F.transform(F.flatten(F.col("parts")) if shape == "parts" else F.col("ring"), lambda p: p["x"])).alias("from")))
    met = spatial.zonal(cells.select("dem_id", "row", "col"), own.select(F.col("dem_id").alias("site_id"), "id", shape), cell)
    feet = ((F.col("col") + 0.5) * cell - F.col("shape_id.from")) * FEET
    return met.select("dem_id", "row", "col", *[f"shape_id.{c}" for c in ("seq", "priority", "kind", "target", "slope")], feet.alias("feet"))


def road_crown(cells: DataFrame, width_ft: float, crown_percent: float, cross_percent: float, cell: float) -> DataFrame:
    """cells of a corridor with z from their mean, a parabolic crown and a cross slope over the distance from the raster's middle."""
    whole = Window.partitionBy("dem_id")
    away = (F.col("col") + 0.5 - (F.max("col").over(whole) + 1) / 2.0) * cell * FEET
    share = F.greatest(1.0 - F.pow(away / (width_ft / 2.0), 2), F.lit(0.0))
    return cells.withColumn("z", F.avg("z").over(whole) + share * width_ft / 2.0 * crown_percent / 100.0 - F.abs(away) * cross_percent / 100.0)


def transition(cells: DataFrame, reach: int = 3) -> DataFrame:
    """cells with z of those in zone "transition" replaced by the mean of graded cells within reach, where there are any."""
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    sent = cells.where("graded").select("dem_id", "row", "col", "z", offsets.alias("o")).groupBy("dem_id", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col")).agg(F.avg("z").alias("near"))
    met = cells.join(sent, ["dem_id", "row", "col"], "left")
    return met.withColumn("z", F.when(F.col("in_transition"), F.coalesce("near", "z")).otherwise(F.col("z"))).drop("near")


def heat(depth: Column, most: float) -> Column:
    """Red for cut, blue for fill, green for little change, of depths clipped to the range."""
    level = ((F.least(F.greatest(depth, F.lit(-most)), F.lit(most)) + most) / (2.0 * most) * 255.0).cast("int")
    return F.when(depth > 0.5, F.struct(level.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))).when(depth < -0.5, F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), (255 - level).alias("b"))).otherwise(F.struct(F.lit(0).alias("r"), F.lit(128).alias("g"), F.lit(0).alias("b")))


def pad_volumes(cells: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """Per shape on its raster the cut and fill, in cubic yards, that level its cells at their median height."""
    under = spatial.zonal(cells, shapes, cell)
    level = under.groupBy("dem_id", "shape_id").agg(F.median("z").alias("level"))
    d = F.col("z") - F.col("level")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) * cell * cell * CUBIC_YARDS
    return under.join(level.hint("merge"), ["dem_id", "shape_id"]).groupBy("dem_id", "shape_id").agg(total(F.when(d > 0, d)).alias("cut"), total(F.when(d < 0, -d)).alias("fill"))
