"""Rasters, sites and features derived from the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 10.0
WIDTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, and no negative zero."""
    return df.select([(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r(*columns: str) -> str:
    """The same in SQL, for columns of the select list."""
    return ", ".join(f'round({c}, 6) + 0.0 AS {c}' for c in columns)


def dem(spark: SparkSession, sf_dir: str, scale: float = 0.25) -> DataFrame:
    """Four rasters, ten cells wide, with heights from part sizes."""
    k = F.expr("div(p_partkey - p_partkey % 4, 4)")
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("dem_id"), (F.floor((k - k % WIDTH) / WIDTH)).cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"), (F.col("p_size") * scale).alias("z"))


def dem_sql(scale: float = 0.25, name: str = "dem") -> str:
    k = "((p_partkey - p_partkey % 4) // 4)"
    return f"{name} AS (SELECT p_partkey % 4 AS dem_id, CAST(({k} - {k} % 10) // 10 AS INT) AS \"row\", CAST({k} % 10 AS INT) AS col, p_size * CAST({scale} AS DOUBLE) AS z FROM part)"


def gap(row: Column, col: Column) -> Column:
    return (row * 31 + col * 17) % 10 == 0


def with_gaps(cells: DataFrame) -> DataFrame:
    return cells.withColumn("z", F.when(~gap(F.col("row"), F.col("col")), F.col("z")))


def gaps_sql(source: str = "dem", name: str = "gaps") -> str:
    return f'{name} AS (SELECT dem_id, "row", col, CASE WHEN ("row" * 31 + col * 17) % 10 <> 0 THEN z END AS z FROM {source})'


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raster, 300 cells wide, with heights from order prices."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("dem_id"), F.expr("div(o_orderkey, 300)").cast("int").alias("row"), (key % 300).cast("int").alias("col"), (F.col("o_totalprice") / 1000.0).alias("z"))


def post(cells: DataFrame) -> DataFrame:
    """A graded surface of the same cells."""
    return cells.withColumn("z", F.col("z") + ((F.col("row") + F.col("col")) % 3 - 1) * 0.25)


HORN_SQL = """s1 AS (SELECT *, lag(z, 1, z) OVER (PARTITION BY dem_id, "row" ORDER BY col) AS w, lead(z, 1, z) OVER (PARTITION BY dem_id, "row" ORDER BY col) AS e FROM {source}),
s2 AS (SELECT *, lag(w, 1, w) OVER v AS nw, lag(z, 1, z) OVER v AS n, lag(e, 1, e) OVER v AS ne, lead(w, 1, w) OVER v AS sw, lead(z, 1, z) OVER v AS s, lead(e, 1, e) OVER v AS se FROM s1 WINDOW v AS (PARTITION BY dem_id, col ORDER BY "row")),
g AS (SELECT dem_id, "row", col, z, ((ne + 2e0 * e + se) - (nw + 2e0 * w + sw)) / 80e0 AS dzdx, ((sw + 2e0 * s + se) - (nw + 2e0 * n + ne)) / 80e0 AS dzdy FROM s2),
sl AS (SELECT *, sqrt(dzdx * dzdx + dzdy * dzdy) * 100e0 AS slope_percent, degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) AS slope_deg FROM g),
t0 AS (SELECT *, 90e0 - degrees(atan2(dzdy, -dzdx)) AS a FROM sl),
t AS (SELECT dem_id, "row", col, z, dzdx, dzdy, slope_percent, slope_deg, CASE WHEN slope_deg < 0.1e0 THEN -1e0 WHEN a < 0 THEN a + 360e0 WHEN a >= 360 THEN a - 360e0 ELSE a END AS aspect FROM t0)"""


def terrain_sql(scale: float = 0.25) -> str:
    return "WITH " + dem_sql(scale) + ",\n" + HORN_SQL.format(source="dem")
