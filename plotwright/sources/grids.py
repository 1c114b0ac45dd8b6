"""ASCII elevation grids: text files with a header of six lines, the first row of numbers in the north."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells (dem_id, row, col, z) and headers (dem_id, ncols, ..., issues) of the grids below a path partitioned by dem_id.

    Keys may be in any case; ncols, nrows and cellsize are needed; no-data (-9999 if not said) becomes null; a
    centre is moved to the corner; a grid whose numbers do not fit its header gets an issue. A file is read line by
    line, in as many tasks as it has stretches; there is one file a raster.
    """
    words = F.split(F.trim("value"), r"\s+")
    read = spark.read.text(path).select("dem_id", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), words.alias("words"))
    lines = read.where(F.col("words")[0] != "").withColumn("key", F.lower(F.col("words")[0]))
    is_head = F.col("key").isin(*HEADER)
    heads = lines.where(is_head).groupBy("dem_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("words")[1].try_cast("double")))).alias("head"))  # eight lines at most
    body = lines.where(~is_head).select("dem_id", "split", "at", "words")
    shape = body.groupBy("dem_id").agg(F.count("*").alias("n"), F.max(F.size("words")).alias("w"))
    h = lambda k: F.try_element_at("head", F.lit(k))
    corner = lambda a: F.coalesce(h(f"{a}llcenter") - h("cellsize") / 2.0, h(f"{a}llcorner"), F.lit(0.0))
    nodata = F.coalesce(h("nodata_value"), F.lit(-9999.0)).alias("nodata")
    issues = F.array_compact(F.array(
        *[F.when(h(k).isNull(), f"no {k}") for k in ("ncols", "nrows", "cellsize")], F.when((F.coalesce("n", F.lit(0)) != h("nrows")) | (F.col("w") != h("ncols")), "shape differs from header"),
    ))
    met = heads.join(shape, "dem_id", "full")
    meta = met.select("dem_id", h("ncols").cast("int").alias("width"), h("nrows").cast("int").alias("height"), h("cellsize").alias("cell"), corner("x").alias("min_x"), corner("y").alias("min_y"), nodata, issues.alias("issues"))
    # lines are numbered within the stretch of the file that a task reads, and stretches by what those before them hold
    before = body.groupBy("dem_id", "split").agg(F.count("*").alias("n")).select("dem_id", "split", F.coalesce(F.sum("n").over(Window.partitionBy("dem_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = body.withColumn("place", F.row_number().over(Window.partitionBy("dem_id", "split").orderBy("at")) - 1)
    rows = within.join(before, ["dem_id", "split"]).join(met.select("dem_id", nodata), "dem_id").select("dem_id", "nodata", (F.col("before") + F.col("place")).cast("int").alias("row"), "words")
    cells = rows.select("dem_id", "nodata", "row", F.posexplode("words").alias("col", "v"))
    z = F.col("v").try_cast("double")
    return cells.select("dem_id", "row", "col", F.when(z != F.col("nodata"), z).alias("z")), meta


def write(cells: DataFrame, path: str, cell: float, nodata: float = -9999.0) -> None:
    """One grid file a raster; its lines are made where its rows are, and only brought in order in one task."""
    rows = cells.groupBy("dem_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("z", F.lit(nodata)).alias("z")))).alias("v"))
    lines = rows.select("dem_id", F.col("row").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: x["z"].cast("string")), " ").alias("value"))
    size = cells.groupBy("dem_id").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    pairs = F.array(*[F.concat(F.lit(f"{k} "), v) for k, v in (("ncols", F.col("w")), ("NROWS", F.col("h")), ("xllcorner", F.lit(0.0)), ("yllcorner", F.lit(0.0)), ("cellsize", F.lit(cell)), ("NODATA_value", F.lit(nodata)))])
    heads = size.select("dem_id", F.posexplode(pairs).alias("k", "value")).select("dem_id", (F.col("k") - 100).cast("long").alias("n"), "value")
    lines.unionByName(heads).repartition("dem_id").sortWithinPartitions("dem_id", "n").select("dem_id", "value").write.partitionBy("dem_id").text(path)
