"""Neighbourhoods of raster cells (dem_id, row, col, z) by windows along rows and columns.

A window holds one row or one column of one raster, so no task needs a whole raster. Beyond the edge the
nearest cell stands in; a cell without a value stays without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def along(axis: str):
    """The window of a cell's row (axis col) or column (axis row), in order."""
    return Window.partitionBy("dem_id", "row" if axis == "col" else "col").orderBy(axis)


def neighbour(value: Column, axis: str, step: int) -> Column:
    """The value step cells on, the cell's own at the edge."""
    held = F.struct(value.alias("v"))
    moved = F.lag(held, abs(step)) if step < 0 else F.lead(held, step)
    return F.coalesce(moved.over(along(axis)), held)["v"]


def horn(cells: DataFrame, cell: float, z_factor: float = 1.0) -> DataFrame:
    """cells with dzdx and dzdy (positive southward) by 1-2-1 weighted differences."""
    sided = cells.withColumns({"__w": neighbour(F.col("z"), "col", -1), "__e": neighbour(F.col("z"), "col", 1)})
    n, s = (lambda c: neighbour(F.col(c), "row", -1)), (lambda c: neighbour(F.col(c), "row", 1))
    around = sided.withColumns({"__nw": n("__w"), "__n": n("z"), "__ne": n("__e"), "__sw": s("__w"), "__s": s("z"), "__se": s("__e")})
    x = (F.col("__ne") + 2.0 * F.col("__e") + F.col("__se")) - (F.col("__nw") + 2.0 * F.col("__w") + F.col("__sw"))
    y = (F.col("__sw") + 2.0 * F.col("__s") + F.col("__se")) - (F.col("__nw") + 2.0 * F.col("__n") + F.col("__ne"))
    return around.withColumns({"dzdx": x * z_factor / (8.0 * cell), "dzdy": y * z_factor / (8.0 * cell)}).drop("__w", "__e", "__nw", "__n", "__ne", "__sw", "__s", "__se")


def central(cells: DataFrame, cell: float, z_factor: float = 1.0) -> DataFrame:
    """cells with dzdx and dzdy by differences of the two neighbours on each axis (two published methods give this same table)."""
    x = neighbour(F.col("z"), "col", 1) - neighbour(F.col("z"), "col", -1)
    y = neighbour(F.col("z"), "row", 1) - neighbour(F.col("z"), "row", -1)
    return cells.withColumns({"dzdx": x * z_factor / (2.0 * cell), "dzdy": y * z_factor / (2.0 * cell)})


def one_sided(cells: DataFrame) -> DataFrame:
    """cells with gx and gy at spacing 1: central inside, one-sided at the edges."""

    def side(axis: str) -> Column:
        before, after = (F.lag(F.struct("z"), 1).over(along(axis))), (F.lead(F.struct("z"), 1).over(along(axis)))
        z = F.col("z")
        return F.when(before.isNull(), after["z"] - z).when(after.isNull(), z - before["z"]).otherwise((after["z"] - before["z"]) / 2.0)

    return cells.withColumns({"gx": side("col"), "gy": side("row")})


def slope(gradients: DataFrame) -> DataFrame:
    """gradients with slope_percent and slope_deg."""
    rise = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))
    return gradients.withColumns({"slope_percent": rise * 100.0, "slope_deg": F.degrees(F.atan(rise))})


def aspect(gradients: DataFrame, threshold: float = 0.1) -> DataFrame:
    """gradients (with slope_deg) with aspect, clockwise degrees from north, -1 on ground flatter than the threshold."""
    turned = 90.0 - F.degrees(F.atan2("dzdy", -F.col("dzdx")))
    turned = F.when(turned < 0, turned + 360.0).when(turned >= 360.0, turned - 360.0).otherwise(turned)
    return gradients.withColumn("aspect", F.when(F.col("slope_deg") < threshold, -1.0).otherwise(turned))


def terrain(cells: DataFrame, cell: float) -> DataFrame:
    """cells with gradients, slopes and aspect."""
    return aspect(slope(horn(cells, cell)))


def gaussian(cells: DataFrame, sigma: float = 1.0) -> DataFrame:
    """cells with smooth, z under a separable Gaussian cut at int(4 sigma + 0.5), mirrored at the edges; no value within reach, none after."""
    import math

    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]

    def blurred(df: DataFrame, value: str, out: str, axis: str, key: str) -> DataFrame:
        """The weighted sum of lags and leads; beyond an edge the values next to it, of which a row or column keeps a small map."""
        sizes = df.groupBy("dem_id", key).agg((F.max(axis) + 1).alias("__n"))
        sized = df.join(sizes, ["dem_id", key])
        edge = sized.where((F.col(axis) < reach) | (F.col(axis) >= F.col("__n") - reach)).groupBy("dem_id", key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(axis), F.col(value)))).alias("__edge"))
        met = sized.join(edge, ["dem_id", key])
        period, held = 2 * F.col("__n"), F.struct(F.col(value).alias("v"))

        def at(k: int) -> Column:
            i = F.pmod(F.col(axis) + k, period)
            mirrored = F.element_at("__edge", F.when(i >= F.col("__n"), period - 1 - i).otherwise(i).cast("int"))
            if not k:
                return F.col(value)
            moved = (F.lag(held, -k) if k < 0 else F.lead(held, k)).over(along(axis))
            return F.when((F.col(axis) + k < 0) | (F.col(axis) + k >= F.col("__n")), mirrored).otherwise(moved["v"])

        total = None
        for k, w in zip(range(-reach, reach + 1), weights):
            part = at(k) * F.lit(w)
            total = part if total is None else total + part
        return met.withColumn(out, total).drop("__n", "__edge")

    return blurred(blurred(cells, "z", "__across", "col", "row"), "__across", "smooth", "row", "col").drop("__across")
