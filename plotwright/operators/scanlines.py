"""Which cells of a raster lie in a shape, row by row.

Every edge of a shape gives the places where it crosses the middle lines of rows. Of a row these places, in order,
open and close the shape in turn, so pairs of them are spans of columns, holes and turns of the ring included. Cells
meet spans by (raster, row, stretch of columns) and a range; no cell is tested against a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions import geometry as G

#: Columns in a stretch by which cells and spans meet.
STRETCH = 64


def _first_cell(x: Column, cell: float) -> Column:
    """The first column whose middle is not left of x."""
    near = F.ceil(x / cell - 0.5)
    middle = lambda c: (c + 0.5) * cell
    return F.when(middle(near - 1) >= x, near - 1).when(middle(near) < x, near + 1).otherwise(near).cast("int")


def spans(shapes: DataFrame, cell: float) -> DataFrame:
    """dem_id, shape_id, row, c0, c1: the spans of columns that shapes cover (site_id, id, and ring, or parts: a shell with its holes).

    A cell is covered if its middle is, by the even-odd rule. Equal shapes of one id give their spans each.
    """
    rings = F.col("parts") if "parts" in shapes.columns else F.array("ring")
    own = shapes.select("site_id", "id", rings.alias("rings")).groupBy("site_id", "id", "rings").agg(F.count("*").alias("copies"))
    key = ["site_id", "id", "shape", "copies"]
    own = own.withColumn("shape", F.xxhash64("rings"))
    edge = own.select(*key, F.explode("rings").alias("ring")).select(*key, F.explode(G.edges(F.col("ring"))).alias("e"))
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    rows = F.sequence(F.floor(low / cell - 0.5).cast("int"), F.ceil(high / cell - 0.5).cast("int"))
    at = edge.where(low < high).withColumn("row", F.explode(rows)).withColumn("y", (F.col("row") + 0.5) * cell).where((low <= F.col("y")) & (F.col("y") < high))
    x = (F.col("e.b.x") - F.col("e.a.x")) * ((F.col("y") - F.col("e.a.y")) / (F.col("e.b.y") - F.col("e.a.y"))) + F.col("e.a.x")
    crossed = at.groupBy(*key, "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    pair = F.transform(F.sequence(F.lit(0), F.expr("size(xs) div 2 - 1")), lambda k: F.struct(F.col("xs")[(2 * k).cast("int")].alias("a"), F.col("xs")[(2 * k + 1).cast("int")].alias("b")))
    each = crossed.withColumn("s", F.explode(pair)).withColumns({"c0": _first_cell(F.col("s.a"), cell), "c1": _first_cell(F.col("s.b"), cell) - 1}).where("c0 <= c1")
    copied = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(F.col("site_id").alias("dem_id"), F.col("id").alias("shape_id"), "row", "c0", "c1")


def covered(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """cells with shape_id, a row for every span over them; spans are many more than Spark can know when it plans, so they are not broadcast."""
    stretch = F.explode(F.sequence(F.floor(F.col("c0") / STRETCH), F.floor(F.col("c1") / STRETCH)))
    met = cells.withColumn("__at", F.floor(F.col("col") / STRETCH)).join(spans.withColumn("__at", stretch).hint("merge"), ["dem_id", "row", "__at"])
    return met.where(F.col("col").between(F.col("c0"), F.col("c1"))).select(*cells.columns, "shape_id")


def mask(cells: DataFrame, shapes: DataFrame, cell: float, name: str = "inside") -> DataFrame:
    """cells with a flag: whether any shape of its raster covers the cell."""
    key = ["dem_id", "row", "col"]
    hit = covered(cells.select(key), spans(shapes, cell)).select(key).distinct().withColumn(name, F.lit(True))
    return cells.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
