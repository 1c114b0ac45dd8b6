"""Raster operators: statistics, masks, filling, resampling, cropping, mosaics, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions import terrain as T
from plotwright.tables import written

from . import stencil
from .selection import with_percentiles

ACRE = 4046.86


def metrics(cells: DataFrame) -> DataFrame:
    """Per raster: least, greatest, mean, median, deviation, range, and counts of cells with and without a value."""
    own = written(cells.select("dem_id", "z"), "heights")
    n, valid = F.count("*"), F.count("z")
    found = own.groupBy("dem_id").agg(
        F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"),
        (F.max("z") - F.min("z")).alias("range_z"), valid.alias("n_valid"), (n - valid).alias("n_missing"), ((n - valid) * 100.0 / n).alias("missing_percent"),
    )
    return with_percentiles(own, ["dem_id"], "z", {"median_z": 0.5}, found)


def slope_statistics(cells: DataFrame, exact: bool = True) -> DataFrame:
    """Per raster: slope statistics, percentiles, and counts and shares by class. Exact percentiles by selection; not exact: mergeable sketches, one pass."""
    s = F.col("slope_percent")
    points = {f"p{int(p * 100)}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95)}
    k = T.slope_class(s)
    counts = {name: F.count_if(k == i) for i, name in enumerate(T.SLOPE_NAMES)}
    own = cells.where(s.isNotNull()).select("dem_id", "slope_percent")
    if exact:
        own = written(own, "slopes")
    sketches = [] if exact else [F.percentile_approx(s, p, 10_000).alias(c) for c, p in points.items()]
    found = own.groupBy("dem_id").agg(
        F.min(s).alias("min_slope"), F.max(s).alias("max_slope"), F.avg(s).alias("mean_slope"), F.stddev_pop(s).alias("std_slope"),
        *sketches, *[c.alias(f"n_{n}") for n, c in counts.items()], *[(c * 100.0 / F.count("*")).alias(f"{n}_percent") for n, c in counts.items()],
    )
    return with_percentiles(own, ["dem_id"], "slope_percent", points, found) if exact else found


def aspect_statistics(cells: DataFrame) -> DataFrame:
    """Per raster: cells with and without a direction; arithmetic mean, median and deviation of the directions."""
    a = F.when(F.col("aspect") >= 0, F.col("aspect"))
    own = written(cells.select("dem_id", "aspect", a.alias("a")), "aspects")
    found = own.groupBy("dem_id").agg(F.count("a").alias("n_defined"), F.count_if(F.col("aspect") < 0).alias("n_flat"), F.avg("a").alias("mean_aspect"), F.stddev_pop("a").alias("std_aspect"))
    return with_percentiles(own, ["dem_id"], "a", {"median_aspect": 0.5}, found)


def aspect_distribution(cells: DataFrame) -> DataFrame:
    """Per raster and sector, zero-filled, the cells and their share."""
    codes = cells.sparkSession.range(9).select(F.col("id").cast("int").alias("code"))
    found = cells.groupBy("dem_id", T.sector_code(F.col("aspect")).alias("code")).agg(F.count("*").alias("n"))
    every = found.select("dem_id").distinct().join(F.broadcast(codes))  # nine rows by definition
    n = F.coalesce("n", F.lit(0))
    return every.join(found, ["dem_id", "code"], "left").select("dem_id", "code", T.sector_name(F.col("code")).alias("sector"), n.alias("n"), (n * 100.0 / F.sum(n).over(Window.partitionBy("dem_id"))).alias("percent"))


def buildable(cells: DataFrame, slope_most: float = 25.0, z_least: float | None = None, z_most: float | None = None, facing: float | None = None, tolerance: float = 45.0) -> DataFrame:
    """cells with buildable; a missing value passes no active condition."""
    rules: list[Column] = [F.col("slope_percent") <= slope_most]
    if z_least is not None:
        rules.append(F.col("z") >= z_least)
    if z_most is not None:
        rules.append(F.col("z") <= z_most)
    if facing is not None:
        turn = F.abs(F.col("aspect") - facing)
        rules.append((F.col("aspect") < 0) | (F.least(turn, 360.0 - turn) <= tolerance))
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.coalesce(r, F.lit(False))
    return cells.withColumn("buildable", ok)


def without_spikes(cells: DataFrame, threshold: float = 3.0) -> DataFrame:
    """cells with spike (further than threshold deviations from the raster's mean) and z without those."""
    stats = cells.groupBy("dem_id").agg(F.avg("z").alias("__m"), F.stddev_pop("z").alias("__s"))
    spike = F.coalesce(F.abs(F.col("z") - F.col("__m")) > threshold * F.col("__s"), F.lit(False))
    return cells.join(stats, "dem_id").withColumn("spike", spike).withColumn("z", F.when(~F.col("spike"), F.col("z"))).drop("__m", "__s")


def keep_gentle(cells: DataFrame, sigma: float = 1.0) -> DataFrame:
    """cells with blended: w z + (1 - w) smooth, w = exp(-(g / p75 of g)^2).

    Cells of low gradient keep their value and steep ones are smoothed, as the formula has it.
    """
    g = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    steep = stencil.one_sided(cells).withColumn("__g", g)
    limit = steep.groupBy("dem_id").agg(F.percentile("__g", F.lit(0.75)).alias("__p"))
    weighed = stencil.gaussian(steep, sigma).join(limit, "dem_id").withColumn("__w", F.when(F.col("__p") > 0, F.exp(-F.pow(F.col("__g") / F.col("__p"), 2))).otherwise(1.0))
    return weighed.withColumn("blended", F.col("__w") * F.col("z") + (1.0 - F.col("__w")) * F.col("smooth")).drop("__g", "__p", "__w", "gx", "gy", "smooth")


def _nearest_on(axis: str, side: int) -> Column:
    """The nearest cell with a value on one side along an axis: its place and value.

    What lies ahead is what lies behind in the other order: a frame up to the end would be gone through anew for every cell.
    """
    held = F.when(F.col("z").isNotNull(), F.struct(F.col(axis).alias("i"), F.col("z").alias("v")))
    w = stencil.along(axis) if side < 0 else stencil.along(axis).orderBy(F.desc(axis))
    return F.last(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_linear(cells: DataFrame) -> DataFrame:
    """cells with filled: gaps take the blend, by inverse distance, of linear interpolation along row and column.

    A gap with values on one side only takes the nearest of those on its row and column.
    """
    sides = cells.withColumns({f"__{a}{s}": _nearest_on(a, -1 if s == "b" else 1) for a in ("row", "col") for s in "ba"})

    def line(axis: str) -> tuple[Column, Column]:
        b, a, i = F.col(f"__{axis}b"), F.col(f"__{axis}a"), F.col(axis)
        both = b.isNotNull() & a.isNotNull()
        value = F.when(both, b["v"] + (a["v"] - b["v"]) * (i - b["i"]) / (a["i"] - b["i"]))
        return value, F.when(both, 1.0 / F.least(i - b["i"], a["i"] - i))

    (vr, wr), (vc, wc) = line("row"), line("col")
    blend = F.when(vr.isNotNull() & vc.isNotNull(), (vr * wr + vc * wc) / (wr + wc)).otherwise(F.coalesce(vr, vc))
    reach = [F.when(F.col(f"__{a}{s}").isNotNull(), F.struct(F.abs(F.col(f"__{a}{s}")["i"] - F.col(a)).alias("d"), F.lit(k).alias("k"), F.col(f"__{a}{s}")["v"].alias("v"))) for k, (a, s) in enumerate((a, s) for a in ("col", "row") for s in "ba")]
    nearest = F.array_min(F.array_compact(F.array(*reach)))["v"]
    return sides.withColumn("filled", F.when(F.col("z").isNotNull(), F.col("z")).otherwise(F.coalesce(blend, nearest))).drop(*[f"__{a}{s}" for a in ("row", "col") for s in "ba"])


def fill_nearest(cells: DataFrame) -> DataFrame:
    """cells with filled: gaps take the value of the nearest cell, ties the one of least row, then column.

    Every cell knows the nearest value of its own row. A gap therefore asks one cell in each row no further away than
    the nearest value on its own row and column (than the raster is high, if these have none): exact, in one join,
    with as many rows as a gap is away from values, not their square.
    """
    near = {a: [F.when(x.isNotNull(), F.struct(F.abs(x["i"] - F.col(a)).alias("d"), x["i"].alias("i"), x["v"].alias("v"))) for x in (_nearest_on(a, -1), _nearest_on(a, 1))] for a in ("row", "col")}
    least = lambda a: F.array_min(F.array_compact(F.array(*near[a])))
    sided = cells.select("dem_id", "row", "col", "z", least("col").alias("__own"), least("row")["d"].alias("__up"))
    extent = cells.groupBy("dem_id").agg(F.min("row").alias("__r0"), F.max("row").alias("__r1"))
    reach = F.least(F.col("__own.d"), F.col("__up"))
    gaps = sided.where("z is null").join(extent, "dem_id").withColumn("__n", F.coalesce(reach, F.col("__r1") - F.col("__r0")))
    rows = F.explode(F.sequence(F.greatest(F.col("row") - F.col("__n"), F.col("__r0")), F.least(F.col("row") + F.col("__n"), F.col("__r1"))))
    asked = gaps.select("dem_id", "row", "col", rows.alias("vr"))
    known = sided.where("__own is not null").select("dem_id", F.col("row").alias("vr"), "col", F.col("__own.d").alias("dc"), F.col("__own.i").alias("vc"), F.col("__own.v").alias("vz"))
    apart = F.col("row") - F.col("vr")
    best = asked.join(known.hint("merge"), ["dem_id", "vr", "col"]).groupBy("dem_id", "row", "col").agg(F.min(F.struct((apart * apart + F.col("dc") * F.col("dc")).alias("d"), "vr", "vc", "vz"))["vz"].alias("fill"))
    return cells.join(best.hint("merge"), ["dem_id", "row", "col"], "left").withColumn("filled", F.coalesce("z", "fill")).drop("fill")


def resample(cells: DataFrame, factor: int, method: str = "average") -> DataFrame:
    """Cells of factor times the size: the mean of those in it, or (nearest) the one at its centre, or bilinear between centres."""
    to = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    if method == "average":
        return cells.groupBy("dem_id", *to).agg(F.avg("z").alias("z"))
    if method == "nearest":
        at = [F.col(c) % factor == factor // 2 for c in ("row", "col")]
        return cells.where(at[0] & at[1]).select("dem_id", *to, "z")
    # the centre of a large cell lies at factor / 2 - 1 / 2 from its first cell: between two cells, or on one
    low = (factor - 1) // 2
    share = (factor - 1) / 2 - low
    weight = None
    keep = F.lit(True)
    for c in ("row", "col"):
        w = F.when(F.col(c) % factor == low, 1.0 - share).when(F.col(c) % factor == low + 1, share).otherwise(0.0)
        keep = keep & (w > 0)
        weight = w if weight is None else weight * w
    return cells.where(keep).groupBy("dem_id", *to).agg(F.try_divide(F.sum(F.col("z") * weight), F.sum(F.when(F.col("z").isNotNull(), weight))).alias("z"))


def window_of(cells: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """The cells of a sub-rectangle, numbered from its corner; the range filter reaches the scan."""
    return cells.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1)).withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def crop(cells: DataFrame, boxes: DataFrame, cell: float, margin: float) -> DataFrame:
    """cells within each raster's box (dem_id, min_x, min_y, max_x, max_y; y grows with the row) grown by a margin."""
    low = lambda c: F.floor((F.col(c) - margin) / cell).cast("int")
    high = lambda c: F.floor((F.col(c) + margin) / cell).cast("int")
    limits = boxes.select("dem_id", low("min_x").alias("c0"), high("max_x").alias("c1"), low("min_y").alias("r0"), high("max_y").alias("r1"))
    return cells.join(limits, "dem_id").where("row between r0 and r1 and col between c0 and c1").drop("c0", "c1", "r0", "r1")


def mosaic(tiles: DataFrame) -> DataFrame:
    """One value a cell of overlapping tiles (with tile_order): the first tile's that has one."""
    return tiles.groupBy("dem_id", "row", "col").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("tile_order"))).alias("z"))


def surface_area(cells: DataFrame, cell: float) -> DataFrame:
    """Per raster: plan and surface area; a cell without a slope counts flat."""
    factor = F.coalesce(1.0 / F.cos(F.radians("slope_deg")), F.lit(1.0))
    return cells.groupBy("dem_id").agg((F.count("*") * cell * cell).alias("plan_area"), (F.sum(factor) * cell * cell).alias("surface_area"))


def checks(cells: DataFrame, cell: float, width: int) -> DataFrame:
    """Per raster its issues and warnings: size, resolution, gaps, elevation range, steps and outliers."""
    steep = stencil.one_sided(cells).withColumn("g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    base = cells.groupBy("dem_id").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    found = steep.join(base, "dem_id").groupBy("dem_id").agg(
        F.count("*").alias("n"), F.count("z").alias("valid"), F.min("z").alias("low"), F.max("z").alias("high"), F.max("g").alias("step"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"),
        F.count_if(F.abs(F.col("z") - F.col("m")) > 3.0 * F.col("s")).alias("far"),
    )
    gone = (F.col("n") - F.col("valid")) * 100.0 / F.col("n")
    issues = [
        (F.col("n") != F.col("height") * F.col("width"), "shape differs from header"),
        (F.col("width") != width, "width differs from header"),
        (F.col("valid") == 0, "no elevation at all"),
        (gone > 50.0, "over half of the cells are missing"),
        ((F.col("low") < -500.0) | (F.col("high") > 9000.0), "elevation out of range"),
    ]
    warnings = [
        (F.least("height", "width") < 10, "small grid"),
        (F.lit(cell) > 100.0, "coarse resolution"),
        (F.lit(cell) < 0.1, "very fine resolution"),
        ((gone > 10.0) & (gone <= 50.0), "over a tenth of the cells are missing"),
        (F.col("high") - F.col("low") < 1.0, "flat"),
        (F.col("step") > 500.0 * cell, "spikes"),
        (F.col("far") > 0.01 * F.col("valid"), "outliers"),
    ]
    listed = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return found.select("dem_id", listed(issues).alias("issues"), listed(warnings).alias("warnings")).withColumn("is_valid", F.size("issues") == 0)


def header_checks(meta: DataFrame) -> DataFrame:
    """Issues and warnings of rasters' headers (dem_id, cell_x, cell_y, min_x, min_y, max_x, max_y, epsg, geographic): cells, bounds, coordinate system."""
    degrees = F.col("min_x").between(-180, 180) & F.col("min_y").between(-90, 90)
    most = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    issues = [(F.col("min_x") >= F.col("max_x"), "west is not before east"), (F.col("min_y") >= F.col("max_y"), "south is not before north")]
    warnings = [
        (F.abs(F.col("cell_x") - F.col("cell_y")) > 0.01, "cells are not square"), (F.greatest("cell_x", "cell_y") > 100, "coarse cells"), (F.least("cell_x", "cell_y") < 0.1, "very fine cells"),
        (degrees & (most > 10), "over ten degrees wide"), (~degrees & (most > 1_000_000), "over a thousand kilometres wide"),
        (F.col("epsg").isNull(), "no coordinate system"), (F.col("epsg").isNotNull() & F.col("geographic"), "geographic coordinates"),
    ]
    listed = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return meta.select("dem_id", listed(issues).alias("issues"), listed(warnings).alias("warnings"))


def compatibility(meta: DataFrame) -> DataFrame:
    """Pairs of a site's rasters (site_id, dem_id, w, h, cell, unit, min_x, min_y) and what keeps them from being joined."""
    cols = ("dem_id", "w", "h", "cell", "unit", "min_x", "min_y")
    side = lambda p: meta.select("site_id", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    met = side("a").join(side("b"), "site_id").where("a_dem_id < b_dem_id")
    end = lambda p, c, n: F.col(f"{p}_{c}") + F.col(f"{p}_{n}") * F.col(f"{p}_cell")
    apart = (end("a", "min_x", "w") <= F.col("b_min_x")) | (end("b", "min_x", "w") <= F.col("a_min_x")) | (end("a", "min_y", "h") <= F.col("b_min_y")) | (end("b", "min_y", "h") <= F.col("a_min_y"))
    issues = F.array_compact(F.array(F.when(F.abs(F.col("a_cell") - F.col("b_cell")) > 0.01, "resolutions differ"), F.when(F.col("a_unit") != F.col("b_unit"), "units differ"), F.when(apart, "no common area")))
    return met.select("site_id", F.col("a_dem_id").alias("a"), F.col("b_dem_id").alias("b"), issues.alias("issues"))


def regrid(cells: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Cells of a new grid: the mean of the old ones whose middles, mapped to x and y, lie in them."""
    return cells.groupBy("dem_id", F.floor(y / size).cast("int").alias("row"), F.floor(x / size).cast("int").alias("col")).agg(F.avg("z").alias("z"))
