"""Terrain queries over rasters derived from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwright.functions import terrain as T
from plotwright.operators import raster, stencil

from .fixtures import CELL, HORN_SQL, WIDTH, big, dem, dem_sql, gaps_sql, r, rounded, terrain_sql, with_gaps

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def terrain(spark, sf_dir, scale=0.25):
    return stencil.terrain(dem(spark, sf_dir, scale), CELL)


BASE = terrain_sql()
ROUGH = terrain_sql(0.5)
CLASS = "(CASE WHEN slope_percent >= 25 THEN 3 WHEN slope_percent >= 15 THEN 2 WHEN slope_percent >= 5 THEN 1 ELSE 0 END)"
SECTOR = "(CASE WHEN aspect < 0 THEN 0 ELSE CAST(floor((aspect + 22.5e0) / 45e0) AS INT) % 8 + 1 END)"
SECTORS = "['FLAT', 'N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW']"


@query("e01_horn_gradient", f'{BASE} SELECT dem_id, "row", col, {r("dzdx", "dzdy")} FROM t')
def _(spark, sf_dir):
    return stencil.horn(dem(spark, sf_dir), CELL).select("dem_id", "row", "col", "dzdx", "dzdy")


@query("e02_central_gradient", f"""WITH {dem_sql()}, x AS (SELECT *, (lead(z, 1, z) OVER h - lag(z, 1, z) OVER h) / 20e0 AS dzdx, (lead(z, 1, z) OVER v - lag(z, 1, z) OVER v) / 20e0 AS dzdy
 FROM dem WINDOW h AS (PARTITION BY dem_id, "row" ORDER BY col), v AS (PARTITION BY dem_id, col ORDER BY "row")) SELECT dem_id, "row", col, {r("dzdx", "dzdy")} FROM x""")
def _(spark, sf_dir):
    return stencil.central(dem(spark, sf_dir), CELL).select("dem_id", "row", "col", "dzdx", "dzdy")


@query("e03_central_gradient_exaggerated", f"""WITH {dem_sql()}, x AS (SELECT *, (lead(z, 1, z) OVER h - lag(z, 1, z) OVER h) * 2e0 / 20e0 AS dzdx, (lead(z, 1, z) OVER v - lag(z, 1, z) OVER v) * 2e0 / 20e0 AS dzdy
 FROM dem WINDOW h AS (PARTITION BY dem_id, "row" ORDER BY col), v AS (PARTITION BY dem_id, col ORDER BY "row")), y AS (SELECT *, sqrt(dzdx * dzdx + dzdy * dzdy) * 100e0 AS slope_percent FROM x) SELECT dem_id, "row", col, {r("slope_percent")} FROM y""")
def _(spark, sf_dir):
    return stencil.slope(stencil.central(dem(spark, sf_dir), CELL, 2.0)).select("dem_id", "row", "col", "slope_percent")


@query("e04_slope", f'{BASE} SELECT dem_id, "row", col, {r("slope_percent", "slope_deg")} FROM t')
def _(spark, sf_dir):
    return terrain(spark, sf_dir).select("dem_id", "row", "col", "slope_percent", "slope_deg")


@query("e05_aspect", f'{BASE} SELECT dem_id, "row", col, {r("aspect")} FROM t')
def _(spark, sf_dir):
    return terrain(spark, sf_dir).select("dem_id", "row", "col", "aspect")


@query("e06_aspect_cardinal", f'{BASE} SELECT dem_id, "row", col, {r("aspect")}, {SECTOR} AS code, {SECTORS}[{SECTOR} + 1] AS sector FROM t')
def _(spark, sf_dir):
    code = T.sector_code(F.col("aspect"))
    return terrain(spark, sf_dir).select("dem_id", "row", "col", "aspect", code.alias("code"), T.sector_name(code).alias("sector"))


ONE_SIDED = """CASE WHEN lag(z) OVER {w} IS NULL THEN lead(z) OVER {w} - z WHEN lead(z) OVER {w} IS NULL THEN z - lag(z) OVER {w} ELSE (lead(z) OVER {w} - lag(z) OVER {w}) / 2e0 END"""
ONE = f"""o AS (SELECT *, {ONE_SIDED.format(w="h")} AS gx, {ONE_SIDED.format(w="v")} AS gy FROM dem WINDOW h AS (PARTITION BY dem_id, "row" ORDER BY col), v AS (PARTITION BY dem_id, col ORDER BY "row"))"""


@query("e07_one_sided_gradient", f'WITH {dem_sql()}, {ONE} SELECT dem_id, "row", col, {r("gx", "gy")} FROM o')
def _(spark, sf_dir):
    return stencil.one_sided(dem(spark, sf_dir)).select("dem_id", "row", "col", "gx", "gy")


def _gauss_sql(source: str) -> str:
    """Offsets -4..4 with weights of sigma 1, mirrored at the edges."""
    mirrored = lambda i, n: f"(CASE WHEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) >= {n} THEN 2 * {n} - 1 - (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END)"
    return f"""k AS (SELECT k, exp(-0.5e0 * k * k) / (SELECT sum(exp(-0.5e0 * i * i)) FROM range(-4, 5) x(i)) AS wt FROM range(-4, 5) y(k)),
ext AS (SELECT dem_id, max("row") + 1 AS nr, max(col) + 1 AS nc FROM {source} GROUP BY dem_id),
a AS (SELECT d.dem_id, d."row", d.col, sum(s.z * k.wt) AS za FROM {source} d JOIN ext USING (dem_id), k, {source} s WHERE s.dem_id = d.dem_id AND s."row" = d."row" AND s.col = {mirrored("d.col + k.k", "ext.nc")} GROUP BY ALL),
b AS (SELECT d.dem_id, d."row", d.col, sum(s.za * k.wt) AS smooth FROM a d JOIN ext USING (dem_id), k, a s WHERE s.dem_id = d.dem_id AND s.col = d.col AND s."row" = {mirrored('d."row" + k.k', "ext.nr")} GROUP BY ALL)"""


@query("e08_gaussian", f'WITH {dem_sql()}, {_gauss_sql("dem")} SELECT dem_id, "row", col, {r("smooth")} FROM b')
def _(spark, sf_dir):
    return stencil.gaussian(dem(spark, sf_dir)).select("dem_id", "row", "col", "smooth")


@query("e09_edge_weighted_smooth", f"""WITH {dem_sql()}, {ONE}, {_gauss_sql("dem")}, m AS (SELECT *, sqrt(gx * gx + gy * gy) AS gr FROM o), p AS (SELECT dem_id, quantile_cont(gr, 0.75) AS p FROM m GROUP BY dem_id),
f AS (SELECT m.dem_id, m."row", m.col, CASE WHEN p > 0 THEN exp(-pow(gr / p, 2)) ELSE 1e0 END AS w, z, smooth FROM m JOIN p USING (dem_id) JOIN b USING (dem_id, "row", col)), x AS (SELECT *, w * z + (1e0 - w) * smooth AS blended FROM f)
SELECT dem_id, "row", col, {r("blended")} FROM x""")
def _(spark, sf_dir):
    return raster.keep_gentle(dem(spark, sf_dir)).select("dem_id", "row", "col", "blended")


@query("e10_fill_nearest", f"""WITH {dem_sql()}, {gaps_sql()}, n AS (SELECT a.dem_id, a."row", a.col, arg_min(b.z, CAST((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col) AS BIGINT) * 1000000000 + b."row" * 100 + b.col) AS zf
 FROM gaps a JOIN gaps b ON a.dem_id = b.dem_id AND abs(a."row" - b."row") <= 10 WHERE a.z IS NULL AND b.z IS NOT NULL GROUP BY ALL)
SELECT g.dem_id, g."row", g.col, coalesce(g.z, n.zf) AS filled FROM gaps g LEFT JOIN n ON g.dem_id = n.dem_id AND g."row" = n."row" AND g.col = n.col""")
def _(spark, sf_dir):
    return raster.fill_nearest(with_gaps(dem(spark, sf_dir))).select("dem_id", "row", "col", "filled")


def _side(axis: str, other: str) -> str:
    q = f'PARTITION BY dem_id, {other} ORDER BY {axis}'
    name = axis.strip('"')
    return ", ".join(f"{fn}(CASE WHEN z IS NOT NULL THEN {v} END IGNORE NULLS) OVER ({q} ROWS BETWEEN {frame}) AS {name}_{s}{n}" for s, fn, frame in (("b", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("a", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")) for n, v in (("i", axis), ("v", "z")))


@query("e11_fill_linear", f"""WITH {dem_sql()}, {gaps_sql()}, s AS (SELECT *, {_side('"row"', "col")}, {_side("col", '"row"')} FROM gaps),
l AS (SELECT *, CASE WHEN row_bi IS NOT NULL AND row_ai IS NOT NULL AND z IS NULL THEN row_bv + (row_av - row_bv) * ("row" - row_bi) / (row_ai - row_bi) END AS vr, CASE WHEN row_bi IS NOT NULL AND row_ai IS NOT NULL AND z IS NULL THEN 1e0 / least("row" - row_bi, row_ai - "row") END AS wr,
 CASE WHEN col_bi IS NOT NULL AND col_ai IS NOT NULL AND z IS NULL THEN col_bv + (col_av - col_bv) * (col - col_bi) / (col_ai - col_bi) END AS vc, CASE WHEN col_bi IS NOT NULL AND col_ai IS NOT NULL AND z IS NULL THEN 1e0 / least(col - col_bi, col_ai - col) END AS wc FROM s),
n AS (SELECT *, list_min([x for x in [CASE WHEN col_bi IS NOT NULL THEN {{'d': abs(col_bi - col), 'k': 0, 'v': col_bv}} END, CASE WHEN col_ai IS NOT NULL THEN {{'d': abs(col_ai - col), 'k': 1, 'v': col_av}} END,
 CASE WHEN row_bi IS NOT NULL THEN {{'d': abs(row_bi - "row"), 'k': 2, 'v': row_bv}} END, CASE WHEN row_ai IS NOT NULL THEN {{'d': abs(row_ai - "row"), 'k': 3, 'v': row_av}} END] if x IS NOT NULL]).v AS near FROM l),
f AS (SELECT *, CASE WHEN z IS NOT NULL THEN z WHEN vr IS NOT NULL AND vc IS NOT NULL THEN (vr * wr + vc * wc) / (wr + wc) ELSE coalesce(vr, vc, near) END AS filled FROM n)
SELECT dem_id, "row", col, {r("filled")} FROM f""")
def _(spark, sf_dir):
    return raster.fill_linear(with_gaps(dem(spark, sf_dir))).select("dem_id", "row", "col", "filled")


@query("e13_resample_average", f'WITH {dem_sql()}, x AS (SELECT dem_id, "row" // 2 AS "row", col // 2 AS col, avg(z) AS z FROM dem GROUP BY ALL) SELECT dem_id, "row", col, {r("z")} FROM x')
def _(spark, sf_dir):
    return raster.resample(dem(spark, sf_dir), 2)


@query("e13_resample_nearest", f'WITH {dem_sql()} SELECT dem_id, "row" // 3 AS "row", col // 3 AS col, {r("z")} FROM dem WHERE "row" % 3 = 1 AND col % 3 = 1')
def _(spark, sf_dir):
    return raster.resample(dem(spark, sf_dir), 3, "nearest")


@query("e13_resample_bilinear", f"""WITH {dem_sql()}, x AS (SELECT dem_id, "row" // 4 AS "row", col // 4 AS col, avg(z) AS z FROM dem WHERE "row" % 4 IN (1, 2) AND col % 4 IN (1, 2) GROUP BY ALL) SELECT dem_id, "row", col, {r("z")} FROM x""")
def _(spark, sf_dir):
    return raster.resample(dem(spark, sf_dir), 4, "bilinear")


@query("a03_windowed_read", f'WITH {dem_sql()} SELECT dem_id, "row" - 2 AS "row", col - 3 AS col, {r("z")} FROM dem WHERE "row" BETWEEN 2 AND 6 AND col BETWEEN 3 AND 7')
def _(spark, sf_dir):
    return raster.window_of(dem(spark, sf_dir), 2, 3, 5, 5)


@query("a04_raster_extent", f'WITH {dem_sql()} SELECT dem_id, max("row") + 1 AS height, max(col) + 1 AS width, count(*) AS n_cells FROM dem GROUP BY dem_id')
def _(spark, sf_dir):
    return dem(spark, sf_dir).groupBy("dem_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("n_cells"))


@query("a02_no_data_scan", f'WITH {dem_sql()} SELECT dem_id, "row", col, {r("z")} FROM (SELECT dem_id, "row", col, nullif(z, 2.5e0) AS z FROM dem)')
def _(spark, sf_dir):
    return dem(spark, sf_dir).withColumn("z", F.when(F.col("z") != 2.5, F.col("z")))


@query("e15_crop", f"""WITH {dem_sql()}, b AS (SELECT n_nationkey AS dem_id, n_nationkey * 10e0 AS min_x, n_nationkey * 10e0 + 35e0 AS max_x, 20e0 AS min_y, 55e0 AS max_y FROM nation WHERE n_nationkey < 4)
SELECT d.dem_id, d."row", d.col, {r("z")} FROM dem d JOIN b USING (dem_id) WHERE d.col BETWEEN floor((min_x - 5e0) / 10e0) AND floor((max_x + 5e0) / 10e0) AND d."row" BETWEEN floor((min_y - 5e0) / 10e0) AND floor((max_y + 5e0) / 10e0)""")
def _(spark, sf_dir):
    key = F.col("n_nationkey")
    boxes = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 4").select(key.cast("long").alias("dem_id"), (key * 10.0).alias("min_x"), (key * 10.0 + 35.0).alias("max_x"), F.lit(20.0).alias("min_y"), F.lit(55.0).alias("max_y"))
    return raster.crop(dem(spark, sf_dir), boxes, CELL, 5.0)


@query("e17_surface_area", f"{BASE}, x AS (SELECT dem_id, count(*) * 100e0 AS plan_area, sum(coalesce(1e0 / cos(radians(slope_deg)), 1e0)) * 100e0 AS surface_area FROM t GROUP BY dem_id) SELECT dem_id, {r('plan_area', 'surface_area')} FROM x")
def _(spark, sf_dir):
    return raster.surface_area(terrain(spark, sf_dir), CELL)


@query("e18_mosaic", f"""WITH {dem_sql()}, {gaps_sql()}, u AS (SELECT 1 AS o, * FROM gaps UNION ALL SELECT 2 AS o, dem_id, "row", col, CASE WHEN col < 7 THEN z + 100e0 END AS z FROM dem)
SELECT dem_id, "row", col, {r("z")} FROM (SELECT dem_id, "row", col, arg_min(z, o) FILTER (z IS NOT NULL) AS z FROM u GROUP BY ALL)""")
def _(spark, sf_dir):
    cells = dem(spark, sf_dir)
    second = cells.withColumn("z", F.when(F.col("col") < 7, F.col("z") + 100.0)).withColumn("tile_order", F.lit(2))
    return raster.mosaic(with_gaps(cells).withColumn("tile_order", F.lit(1)).unionByName(second))


@query("f01_terrain_metrics", f"""WITH {dem_sql()}, {gaps_sql()}, x AS (SELECT dem_id, min(z) AS min_z, max(z) AS max_z, avg(z) AS mean_z, median(z) AS median_z, stddev_pop(z) AS std_z, max(z) - min(z) AS range_z, count(z) AS n_valid, count(*) - count(z) AS n_missing, (count(*) - count(z)) * 100e0 / count(*) AS missing_percent FROM gaps GROUP BY dem_id)
SELECT dem_id, n_valid, n_missing, {r("min_z", "max_z", "mean_z", "median_z", "std_z", "range_z", "missing_percent")} FROM x""")
def _(spark, sf_dir):
    return raster.metrics(with_gaps(dem(spark, sf_dir)))


@query("f02_slope_metadata", f"{BASE}, x AS (SELECT dem_id, min(slope_deg) AS min_slope, max(slope_deg) AS max_slope, avg(slope_deg) AS mean_slope, stddev_pop(slope_deg) AS std_slope FROM t GROUP BY dem_id) SELECT dem_id, {r('min_slope', 'max_slope', 'mean_slope', 'std_slope')} FROM x")
def _(spark, sf_dir):
    s = "slope_deg"
    return terrain(spark, sf_dir).groupBy("dem_id").agg(F.min(s).alias("min_slope"), F.max(s).alias("max_slope"), F.avg(s).alias("mean_slope"), F.stddev_pop(s).alias("std_slope"))


_NAMES = ("flat", "moderate", "steep", "very_steep")
_STATS = ["min_slope", "max_slope", "mean_slope", "std_slope", "p25", "p50", "p75", "p90", "p95", *[f"{n}_percent" for n in _NAMES]]


@query("f03_slope_statistics", f"""{BASE}, x AS (SELECT dem_id, min(slope_percent) AS min_slope, max(slope_percent) AS max_slope, avg(slope_percent) AS mean_slope, stddev_pop(slope_percent) AS std_slope,
 {", ".join(f"quantile_cont(slope_percent, {p / 100}) AS p{p}" for p in (25, 50, 75, 90, 95))}, {", ".join(f"count(*) FILTER ({CLASS} = {i}) AS n_{n}, count(*) FILTER ({CLASS} = {i}) * 100e0 / count(*) AS {n}_percent" for i, n in enumerate(_NAMES))} FROM t GROUP BY dem_id)
SELECT dem_id, {", ".join(f"n_{n}" for n in _NAMES)}, {r(*_STATS)} FROM x""")
def f03(spark, sf_dir):
    return raster.slope_statistics(terrain(spark, sf_dir))


@query("f04_aspect_metadata", f"""{BASE}, x AS (SELECT dem_id, count(*) FILTER (aspect >= 0) AS n_defined, count(*) FILTER (aspect < 0) AS n_flat, avg(aspect) FILTER (aspect >= 0) AS mean_aspect, median(aspect) FILTER (aspect >= 0) AS median_aspect, stddev_pop(aspect) FILTER (aspect >= 0) AS std_aspect FROM t GROUP BY dem_id)
SELECT dem_id, n_defined, n_flat, {r("mean_aspect", "median_aspect", "std_aspect")} FROM x""")
def _(spark, sf_dir):
    return raster.aspect_statistics(terrain(spark, sf_dir))


#: The large raster of fixtures.big(), for plans whose cost is a raster's size.
LARGE = 'bg AS (SELECT CAST(0 AS BIGINT) AS dem_id, CAST(o_orderkey // 300 AS INT) AS "row", CAST(o_orderkey % 300 AS INT) AS col, o_totalprice / 1000e0 AS z FROM orders)'
LARGE_TERRAIN = f'WITH {LARGE},\n{HORN_SQL.format(source="bg")}'


@query("f01_large_raster", f"WITH {LARGE} SELECT dem_id, count(*) AS n_valid, round(min(z), 6) + 0.0 AS min_z, round(max(z), 6) + 0.0 AS max_z, round(avg(z), 6) + 0.0 AS mean_z, round(median(z), 6) + 0.0 AS median_z FROM bg GROUP BY dem_id")
def _(spark, sf_dir):
    return raster.metrics(big(spark, sf_dir)).select("dem_id", "n_valid", "min_z", "max_z", "mean_z", "median_z")


@query("f03_large_raster", f"{LARGE_TERRAIN}, x AS (SELECT dem_id, avg(slope_percent) AS mean_slope, {', '.join(f'quantile_cont(slope_percent, {p / 100}) AS p{p}' for p in (25, 50, 75, 90, 95))}, count(*) FILTER ({CLASS} = 3) AS n_very_steep FROM t GROUP BY dem_id) SELECT dem_id, n_very_steep, {r('mean_slope', 'p25', 'p50', 'p75', 'p90', 'p95')} FROM x")
def _(spark, sf_dir):
    found = raster.slope_statistics(stencil.terrain(big(spark, sf_dir), CELL))
    return found.select("dem_id", "mean_slope", "p25", "p50", "p75", "p90", "p95", "n_very_steep")


@query("f05_aspect_distribution", f"""{BASE}, c AS (SELECT dem_id, {SECTOR} AS code, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT DISTINCT dem_id, CAST(i AS INT) AS code FROM t, range(9) x(i)),
x AS (SELECT e.dem_id, e.code, {SECTORS}[e.code + 1] AS sector, coalesce(c.n, 0) AS n, coalesce(c.n, 0) * 100e0 / sum(coalesce(c.n, 0)) OVER (PARTITION BY e.dem_id) AS percent FROM e LEFT JOIN c ON e.dem_id = c.dem_id AND e.code = c.code)
SELECT dem_id, code, sector, n, {r("percent")} FROM x""")
def _(spark, sf_dir):
    return raster.aspect_distribution(terrain(spark, sf_dir))


@query("c15_slope_class", f"{BASE} SELECT dem_id, {CLASS} AS class, {list(_NAMES)}[{CLASS} + 1] AS name, count(*) AS n FROM t GROUP BY ALL")
def _(spark, sf_dir):
    k = T.slope_class(F.col("slope_percent"))
    return terrain(spark, sf_dir).groupBy("dem_id", k.alias("class"), T.named(k, T.SLOPE_NAMES).alias("name")).agg(F.count("*").alias("n"))


@query("c16_aspect_sector", f"{BASE} SELECT dem_id, {SECTOR} AS code, {SECTORS}[{SECTOR} + 1] AS sector, count(*) AS n FROM t GROUP BY ALL")
def _(spark, sf_dir):
    k = T.sector_code(F.col("aspect"))
    return terrain(spark, sf_dir).groupBy("dem_id", k.alias("code"), T.sector_name(k).alias("sector")).agg(F.count("*").alias("n"))


@query("c17_solar_exposure", f"""{BASE}, x AS (SELECT *, CASE WHEN aspect < 0 THEN 0.5e0 ELSE (cos(radians(aspect - 180e0)) + 1e0) / 2e0 * exp(-abs(slope_deg - 40e0) / 30e0) END AS solar FROM t) SELECT dem_id, "row", col, {r("solar")} FROM x""")
def _(spark, sf_dir):
    return terrain(spark, sf_dir).select("dem_id", "row", "col", T.solar_exposure(F.col("aspect"), F.col("slope_deg"), 40.0).alias("solar"))


@query("c18_wind_exposure", f"""{BASE}, x AS (SELECT *, CASE WHEN aspect < 0 THEN 0.3e0 ELSE (cos(radians(aspect - 270e0)) + 1e0) / 2e0 * (0.7e0 + 0.3e0 * ((exp(slope_deg / 15e0) - 1e0) / (exp(slope_deg / 15e0) + 1e0))) END AS wind FROM t) SELECT dem_id, "row", col, {r("wind")} FROM x""")
def _(spark, sf_dir):
    return terrain(spark, sf_dir).select("dem_id", "row", "col", T.wind_exposure(F.col("aspect"), F.col("slope_deg"), 270.0).alias("wind"))


@query("c19_buildability_class", f"""{ROUGH}, x AS (SELECT dem_id, "row", avg(slope_percent) AS mean_slope FROM t GROUP BY ALL) SELECT dem_id, "row", {r("mean_slope")}, CASE WHEN mean_slope <= 5 THEN 'excellent' WHEN mean_slope <= 15 THEN 'good' WHEN mean_slope <= 25 THEN 'difficult' ELSE 'unsuitable' END AS class FROM x""")
def _(spark, sf_dir):
    return terrain(spark, sf_dir, 0.5).groupBy("dem_id", "row").agg(F.avg("slope_percent").alias("mean_slope")).withColumn("class", T.buildability_class(F.col("mean_slope")))


@query("d01_buildable_mask", f"""{ROUGH} SELECT dem_id, "row", col, coalesce(slope_percent <= 25, false) AND coalesce(z >= 3e0, false) AND coalesce(z <= 24e0, false) AND (aspect < 0 OR least(abs(aspect - 180e0), 360e0 - abs(aspect - 180e0)) <= 90e0) AS buildable FROM t""")
def _(spark, sf_dir):
    return raster.buildable(terrain(spark, sf_dir, 0.5), 25.0, 3.0, 24.0, 180.0, 90.0).select("dem_id", "row", "col", "buildable")


@query("d02_steep_mask", f'{ROUGH} SELECT dem_id, "row", col, {r("slope_percent")} FROM t WHERE slope_percent > 25')
def _(spark, sf_dir):
    return terrain(spark, sf_dir, 0.5).where("slope_percent > 25").select("dem_id", "row", "col", "slope_percent")


@query("d03_spike_mask", f"""WITH {dem_sql()}, m AS (SELECT dem_id, avg(z) AS m, stddev_pop(z) AS s FROM dem GROUP BY dem_id) SELECT d.dem_id, "row", col, abs(z - m) > 1.5e0 * s AS spike, CASE WHEN NOT abs(z - m) > 1.5e0 * s THEN z END AS z FROM dem d JOIN m ON d.dem_id = m.dem_id""")
def _(spark, sf_dir):
    return raster.without_spikes(dem(spark, sf_dir), 1.5).select("dem_id", "row", "col", "spike", "z")


@query("q07_raster_checks", f"""WITH {dem_sql()}, {gaps_sql()}, {ONE.replace("FROM dem", "FROM gaps")}, b AS (SELECT dem_id, avg(z) AS m, stddev_pop(z) AS sd FROM gaps GROUP BY dem_id),
f AS (SELECT o.dem_id, count(*) AS n, count(z) AS valid, min(z) AS low, max(z) AS high, max(sqrt(gx * gx + gy * gy)) AS step, max("row") + 1 AS height, max(col) + 1 AS width, count(*) FILTER (abs(z - m) > 3 * sd) AS far FROM o JOIN b ON o.dem_id = b.dem_id GROUP BY o.dem_id),
x AS (SELECT dem_id, array_to_string([v for v in [CASE WHEN n <> height * width THEN 'shape differs from header' END, CASE WHEN width <> 10 THEN 'width differs from header' END, CASE WHEN valid = 0 THEN 'no elevation at all' END, CASE WHEN (n - valid) * 100e0 / n > 50 THEN 'over half of the cells are missing' END, CASE WHEN low < -500 OR high > 9000 THEN 'elevation out of range' END] if v IS NOT NULL], ';') AS issues,
 array_to_string([v for v in [CASE WHEN least(height, width) < 10 THEN 'small grid' END, CASE WHEN (n - valid) * 100e0 / n > 10 AND (n - valid) * 100e0 / n <= 50 THEN 'over a tenth of the cells are missing' END, CASE WHEN high - low < 1 THEN 'flat' END, CASE WHEN step > 5000 THEN 'spikes' END, CASE WHEN far > 0.01e0 * valid THEN 'outliers' END] if v IS NOT NULL], ';') AS warnings FROM f)
SELECT dem_id, issues, warnings, issues = '' AS is_valid FROM x""")
def _(spark, sf_dir):
    found = raster.checks(with_gaps(dem(spark, sf_dir)), CELL, WIDTH)
    return found.select("dem_id", F.array_join("issues", ";").alias("issues"), F.array_join("warnings", ";").alias("warnings"), "is_valid")
