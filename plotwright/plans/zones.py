"""Zone and earthwork queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotwright.functions import geometry as G
from plotwright.operators import earthwork, raster, spatial, zones
from plotwright.operators.stencil import terrain as derive

from .fixtures import CELL, big, dem, dem_sql, post, r, rounded, table, terrain_sql, with_gaps

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def masked(spark, sf_dir):
    return raster.buildable(derive(dem(spark, sf_dir, 0.5), CELL))


def zoned(spark, sf_dir, diagonal=True):
    return zones.components(masked(spark, sf_dir), "buildable", diagonal, parts=True)


def _zones_sql(mask: str, diagonal: bool) -> str:
    near = "abs(x.\"row\" - y.\"row\") <= 1 AND abs(x.col - y.col) <= 1" if diagonal else "abs(x.\"row\" - y.\"row\") + abs(x.col - y.col) <= 1"
    return f"""{terrain_sql(0.5).replace("WITH ", "WITH RECURSIVE ", 1)},
m AS MATERIALIZED (SELECT *, "row" * 100 + col AS k FROM t WHERE {mask}),
adj AS MATERIALIZED (SELECT x.dem_id, x.k, y.k AS j FROM m x JOIN m y ON x.dem_id = y.dem_id AND {near}),
reach(dem_id, k, j) AS (SELECT dem_id, k, j FROM adj UNION SELECT r.dem_id, r.k, a.j FROM reach r JOIN adj a ON r.dem_id = a.dem_id AND r.j = a.k),
root AS (SELECT dem_id, k, min(j) AS root FROM reach GROUP BY ALL),
z AS MATERIALIZED (SELECT m.*, dense_rank() OVER (PARTITION BY m.dem_id ORDER BY root.root) AS zone_id FROM m JOIN root ON m.dem_id = root.dem_id AND m.k = root.k)"""


ZONES = _zones_sql("slope_percent <= 25", True)
#: The pieces of a zone whose cells are joined by their sides; the largest is its outline.
PARTS = """,
ad4 AS MATERIALIZED (SELECT x.dem_id, x.k, y.k AS j FROM m x JOIN m y ON x.dem_id = y.dem_id AND abs(x."row" - y."row") + abs(x.col - y.col) <= 1),
re4(dem_id, k, j) AS (SELECT dem_id, k, j FROM ad4 UNION SELECT r.dem_id, r.k, a.j FROM re4 r JOIN ad4 a ON r.dem_id = a.dem_id AND r.j = a.k),
pa AS MATERIALIZED (SELECT z.dem_id, z."row", z.col, z.zone_id, min(re4.j) AS part FROM z JOIN re4 ON z.dem_id = re4.dem_id AND z.k = re4.k GROUP BY ALL),
pe AS (SELECT pa.*, 4 - (SELECT count(*) FROM pa b WHERE b.dem_id = pa.dem_id AND b.part = pa.part AND abs(b."row" - pa."row") + abs(b.col - pa.col) = 1) AS edges FROM pa),
ps AS (SELECT dem_id, zone_id, part, count(*) AS n_cells, sum(edges) * 10e0 AS perimeter, avg((col + 0.5e0) * 10e0) AS x, avg(("row" + 0.5e0) * 10e0) AS y FROM pe GROUP BY ALL),
pm AS (SELECT dem_id, zone_id, arg_max(part, (n_cells, -part)) AS part, count(*) AS n_parts FROM ps GROUP BY ALL),
pl AS (SELECT ps.*, n_parts FROM ps JOIN pm ON ps.dem_id = pm.dem_id AND ps.zone_id = pm.zone_id AND ps.part = pm.part)"""
MEASURES = PARTS + """,
zs AS (SELECT dem_id, zone_id, count(*) AS n_cells, avg(slope_percent) AS mean_slope, min(z) AS min_z, max(z) AS max_z, avg(z) AS mean_z, count(*) * 100e0 AS area FROM z GROUP BY ALL HAVING count(*) * 100e0 >= 1000),
zm AS (SELECT zs.*, pl.x, pl.y, pl.perimeter, pl.n_cells * 100e0 AS part_area FROM zs JOIN pl ON pl.dem_id = zs.dem_id AND pl.zone_id = zs.zone_id),
zc AS (SELECT *, least(4e0 * pi() * part_area / (perimeter * perimeter), 1e0) AS compactness, CASE WHEN mean_slope <= 5 THEN 'excellent' WHEN mean_slope <= 15 THEN 'good' WHEN mean_slope <= 25 THEN 'difficult' ELSE 'unsuitable' END AS class FROM zm),
zq AS MATERIALIZED (SELECT *, least(least(area / 5000e0, 1e0) * 30e0 + greatest(0e0, 1e0 - mean_slope / 25e0) * 40e0 + compactness * 20e0 + CASE class WHEN 'excellent' THEN 10e0 WHEN 'good' THEN 7e0 WHEN 'difficult' THEN 3e0 ELSE 0e0 END, 100e0) AS quality FROM zc)"""
_ZONE = ("mean_slope", "min_z", "max_z", "mean_z", "x", "y", "area", "perimeter", "compactness", "quality")


@query("g01_zones", f'{ZONES} SELECT dem_id, "row", col, zone_id FROM z')
def _(spark, sf_dir):
    return zoned(spark, sf_dir).where("zone_id is not null").select("dem_id", "row", "col", F.col("zone_id").cast("long").alias("zone_id"))


@query("g01_zones_by_sides", f'{_zones_sql("slope_percent <= 25", False)} SELECT dem_id, "row", col, zone_id FROM z')
def _(spark, sf_dir):
    return zoned(spark, sf_dir, False).where("zone_id is not null").select("dem_id", "row", "col", F.col("zone_id").cast("long").alias("zone_id"))


@query("f06_zone_statistics", f'{ZONES}{MEASURES} SELECT dem_id, zone_id, n_cells, class, {r(*_ZONE)} FROM zq')
def _(spark, sf_dir):
    return zones.measures(zoned(spark, sf_dir), CELL).withColumn("zone_id", F.col("zone_id").cast("long"))


#: Corners of a part turn out (both sides at them open) or in (both closed, the cell between them missing); the difference is four for the outside and minus four for each hole.
RINGS = PARTS + """,
lp AS MATERIALIZED (SELECT pa.* FROM pa JOIN pm ON pa.dem_id = pm.dem_id AND pa.zone_id = pm.zone_id AND pa.part = pm.part),
cn AS (SELECT lp.dem_id, lp.zone_id, EXISTS (SELECT 1 FROM lp b WHERE b.dem_id = lp.dem_id AND b.part = lp.part AND b.col = lp.col AND b."row" = lp."row" + dr) AS a, EXISTS (SELECT 1 FROM lp b WHERE b.dem_id = lp.dem_id AND b.part = lp.part AND b."row" = lp."row" AND b.col = lp.col + dc) AS s,
 EXISTS (SELECT 1 FROM lp b WHERE b.dem_id = lp.dem_id AND b.part = lp.part AND b."row" = lp."row" + dr AND b.col = lp.col + dc) AS d FROM lp, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) v(dr, dc)),
cc AS (SELECT dem_id, zone_id, count(*) FILTER (NOT a AND NOT s) AS turns_out, count(*) FILTER (a AND s AND NOT d) AS turns_in FROM cn GROUP BY ALL)"""


@query("g02_rings", f"{ZONES}{RINGS} SELECT cc.dem_id, cc.zone_id, turns_out + turns_in AS n_corners, CAST(2 - (turns_out - turns_in) // 4 AS BIGINT) AS n_rings, round(n_cells * 100e0, 6) + 0.0 AS area, round(perimeter, 6) + 0.0 AS perimeter FROM cc JOIN pl ON pl.dem_id = cc.dem_id AND pl.zone_id = cc.zone_id")
def _(spark, sf_dir):
    """Each zone's traced rings: their corners and number, the area they enclose, and their length in the order of their corners."""
    found = zones.rings(zoned(spark, sf_dir), CELL)
    ring = Window.partitionBy("dem_id", "zone_id", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) - F.col(c)
    each = found.withColumns({"step": F.abs(ahead("x")) + F.abs(ahead("y")), "part": F.when(F.col("seq") == 0, F.col("area"))})
    out = each.groupBy("dem_id", "zone_id").agg(F.count("*").alias("n_corners"), F.count_if(F.col("seq") == 0).alias("n_rings"), F.sum("part").alias("area"), F.sum("step").alias("perimeter"))
    return out.withColumn("zone_id", F.col("zone_id").cast("long"))


_SITE = ("largest_area", "mean_quality", "median_quality", "mean_compactness", "least_area", "mean_area", "area", "percent", "quality", "acres", "buildable_slope")


@query("g07_buildability", f"""{ZONES}{MEASURES},
w AS (SELECT dem_id, count(*) AS n_cells, count(*) FILTER (slope_percent <= 25) AS n_buildable, avg(slope_percent) FILTER (slope_percent <= 25) AS buildable_slope FROM t GROUP BY dem_id),
b AS (SELECT dem_id, count(*) AS n_zones, max(area) AS largest_area, max(quality) AS best, avg(quality) AS mean_quality, median(quality) AS median_quality, avg(compactness) AS mean_compactness, min(area) AS least_area, avg(area) AS mean_area, {", ".join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in ("excellent", "good", "difficult", "unsuitable"))} FROM zq GROUP BY dem_id),
f AS (SELECT w.*, b.* EXCLUDE (dem_id), n_buildable * 100e0 AS area, n_buildable * 100e0 / n_cells AS percent, n_buildable * 100e0 / 4046.86e0 AS acres,
 coalesce(least(least(n_buildable * 100e0 / n_cells / 50e0, 1e0) * 30e0 + best / 100e0 * 30e0 + greatest(20e0 - 3e0 * (n_zones - 1), 5e0) + greatest(0e0, 1e0 - buildable_slope / 25e0) * 20e0, 100e0), 0e0) AS quality FROM w LEFT JOIN b ON w.dem_id = b.dem_id)
SELECT dem_id, n_cells, n_buildable, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_zones", "n_excellent", "n_good", "n_difficult", "n_unsuitable"))}, {r(*_SITE)} FROM f""")
def g07(spark, sf_dir):
    found = zoned(spark, sf_dir)
    return zones.site_scores(found, zones.measures(found, CELL), CELL)


@query("g08_slope_exclusions", f"""{_zones_sql("slope_percent > 25", False)} SELECT dem_id, zone_id, count(*) AS n_cells, count(*) * 100e0 AS area FROM z WHERE col BETWEEN 1 AND 8 GROUP BY ALL HAVING count(*) * 100e0 > 1""")
def _(spark, sf_dir):
    found = zones.steep_zones(derive(dem(spark, sf_dir, 0.5), CELL), F.col("col").between(1, 8), 25.0, CELL)
    return found.withColumn("zone_id", F.col("zone_id").cast("long"))


SOIL = "(CASE d.dem_id WHEN 0 THEN 'clay' WHEN 1 THEN 'sand' WHEN 2 THEN 'rock' ELSE 'mixed' END)"
CUT = f"""WITH {dem_sql()}, q AS (SELECT dem_id, "row", col, CASE WHEN ("row" * 31 + col * 17) % 10 <> 0 THEN z + (("row" + col) % 3 - 1) * 0.25e0 * CASE WHEN col < 5 THEN 2 ELSE 1 END END AS z FROM dem),
cf AS (SELECT d.dem_id, d."row", d.col, d.z AS pre, q.z AS post, coalesce(d.z - q.z, 0) AS depth FROM dem d FULL JOIN q ON d.dem_id = q.dem_id AND d."row" = q."row" AND d.col = q.col)"""
VOLUMES = f"""{CUT}, so(soil, shrink, swell) AS (VALUES ('clay', 1.25e0, 1.3e0), ('sand', 1.1e0, 1.15e0), ('rock', 1.5e0, 1.6e0), ('loam', 1.15e0, 1.2e0), ('mixed', 1.2e0, 1.25e0)),
v0 AS (SELECT dem_id, coalesce(sum(depth) FILTER (depth > 0), 0) * pow(10e0 * 3.28084e0, 2) / 27e0 AS cut_cy, coalesce(-sum(depth) FILTER (depth < 0), 0) * pow(10e0 * 3.28084e0, 2) / 27e0 AS fill_cy, count(*) FILTER (depth > 0) * pow(10e0 * 3.28084e0, 2) AS cut_area_sf, count(*) FILTER (depth < 0) * pow(10e0 * 3.28084e0, 2) AS fill_area_sf,
 coalesce(avg(depth) FILTER (depth > 0), 0) AS mean_cut_ft, coalesce(-avg(depth) FILTER (depth < 0), 0) AS mean_fill_ft FROM cf GROUP BY dem_id),
v AS (SELECT d.*, so.soil, cut_cy * swell - fill_cy * shrink AS net_cy, least(fill_cy * shrink, cut_cy * swell) AS balanced_cy, greatest(fill_cy * shrink - cut_cy * swell, 0e0) AS import_cy, greatest(cut_cy * swell - fill_cy * shrink, 0e0) AS export_cy FROM v0 d JOIN so ON so.soil = {SOIL})"""
_VOLUMES = ("cut_cy", "fill_cy", "cut_area_sf", "fill_area_sf", "mean_cut_ft", "mean_fill_ft", "net_cy", "balanced_cy", "import_cy", "export_cy")


def cut_fill(spark, sf_dir):
    before = dem(spark, sf_dir)
    moved = F.col("z") + ((F.col("row") + F.col("col")) % 3 - 1) * 0.25 * F.when(F.col("col") < 5, 2).otherwise(1)
    return earthwork.depths(before, with_gaps(before.withColumn("z", moved)))


def site_soils(spark, sf_dir):
    d = F.col("dem_id")
    return dem(spark, sf_dir).select("dem_id").distinct().withColumn("soil", F.when(d == 0, "clay").when(d == 1, "sand").when(d == 2, "rock").otherwise("mixed"))


def site_volumes(spark, sf_dir):
    return earthwork.volumes(cut_fill(spark, sf_dir), site_soils(spark, sf_dir), CELL)


@query("j03_surface_join", f'{CUT} SELECT dem_id, "row", col, {r("pre", "post", "depth")} FROM cf')
def _(spark, sf_dir):
    return cut_fill(spark, sf_dir)


@query("l09_volumes", f"{VOLUMES} SELECT dem_id, soil, {r(*_VOLUMES)} FROM v")
def _(spark, sf_dir):
    return site_volumes(spark, sf_dir)


_COSTS = ("excavation_cost", "fill_cost", "haul_cost", "import_cost", "export_cost", "compaction_cost")
COSTED = f"""{VOLUMES}, c AS (SELECT *, cut_cy * 5e0 AS excavation_cost, fill_cy * 8e0 AS fill_cost, balanced_cy * 0.25e0 * 2.5e0 AS haul_cost, import_cy * 25e0 AS import_cost, export_cy * 15e0 AS export_cost, fill_cy * 3.5e0 AS compaction_cost FROM v), ct AS (SELECT *, {" + ".join(_COSTS)} AS total_cost FROM c)"""


@query("l10_costs", f"{COSTED} SELECT dem_id, {r(*_COSTS, 'total_cost')} FROM ct")
def _(spark, sf_dir):
    return earthwork.costs(site_volumes(spark, sf_dir)).select("dem_id", *_COSTS, "total_cost")


BALANCED = f"""{COSTED}, ce AS (SELECT dem_id, avg("row") FILTER (depth > 0) AS cr, avg(col) FILTER (depth > 0) AS cc, avg("row") FILTER (depth < 0) AS fr, avg(col) FILTER (depth < 0) AS fc FROM cf GROUP BY dem_id),
ba AS (SELECT ct.*, CASE WHEN cut_cy > 0 THEN fill_cy / cut_cy ELSE 0e0 END AS ratio, coalesce(sqrt(pow(cr - fr, 2) + pow(cc - fc, 2)) * 10e0 * 3.28084e0 / 5280e0, 0e0) AS haul_miles FROM ct JOIN ce ON ct.dem_id = ce.dem_id)"""


@query("l11_balance", f"{BALANCED} SELECT dem_id, ratio BETWEEN 0.9e0 AND 1.1e0 AS is_balanced, {r('ratio', 'haul_miles')} FROM ba")
def _(spark, sf_dir):
    return earthwork.balance(cut_fill(spark, sf_dir), site_volumes(spark, sf_dir), CELL).drop("advice")


@query("l13_summary", f"{BALANCED} SELECT dem_id, soil, ratio BETWEEN 0.9e0 AND 1.1e0 AS is_balanced, {r('cut_cy', 'fill_cy', 'net_cy', 'total_cost', 'ratio')} FROM ba")
def _(spark, sf_dir):
    found = site_volumes(spark, sf_dir)
    return earthwork.costs(found).join(earthwork.balance(cut_fill(spark, sf_dir), found, CELL), "dem_id").select("dem_id", "soil", "is_balanced", "cut_cy", "fill_cy", "net_cy", "total_cost", "ratio")


LINES = """ln AS (SELECT s_suppkey AS line_id, s_suppkey % 4 AS dem_id, (s_suppkey * 7 % 100) * 1e0 AS x0, (s_suppkey * 13 % 200) * 1e0 AS y0, (s_suppkey * 11 % 100) * 1e0 AS x1, (s_suppkey * 17 % 200) * 1e0 AS y1 FROM supplier),
sp AS (SELECT *, x0 + (x1 - x0) * i / 99 AS x, y0 + (y1 - y0) * i / 99 AS y, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * 3.28084e0 * i / 99 AS feet FROM ln, range(100) n(i)),
pf AS (SELECT sp.*, CAST(trunc(y / 10) AS INT) AS "row", CAST(trunc(x / 10) AS INT) AS col FROM sp)"""


def lines(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("line_id"), (k % 4).alias("dem_id"), *[(k * a % m * 1.0).alias(n) for a, m, n in ((7, 100, "x0"), (13, 200, "y0"), (11, 100, "x1"), (17, 200, "y1"))])


@query("l02_profile", f'WITH {dem_sql()}, {LINES} SELECT p.dem_id, line_id, CAST(i AS INT) AS i, p."row", p.col, round(feet, 6) + 0.0 AS feet, d.z FROM pf p LEFT JOIN dem d ON d.dem_id = p.dem_id AND d."row" = p."row" AND d.col = p.col')
def _(spark, sf_dir):
    return earthwork.profile(dem(spark, sf_dir), lines(spark, sf_dir), CELL)


@query("l12_cross_section", f"""WITH {dem_sql()}, q AS (SELECT dem_id, "row", col, z + (("row" + col) % 3 - 1) * 0.25e0 AS z FROM dem), {LINES},
x AS (SELECT p.dem_id, line_id, avg(abs(d.z - q.z)) AS mean_change, max(feet) AS length_ft, avg(abs(d.z - q.z)) * max(feet) / 27e0 AS volume_cy FROM pf p LEFT JOIN dem d ON d.dem_id = p.dem_id AND d."row" = p."row" AND d.col = p.col LEFT JOIN q ON q.dem_id = p.dem_id AND q."row" = p."row" AND q.col = p.col GROUP BY ALL)
SELECT dem_id, line_id, {r("mean_change", "length_ft", "volume_cy")} FROM x""")
def _(spark, sf_dir):
    before = dem(spark, sf_dir)
    return earthwork.section(before, post(before), lines(spark, sf_dir), CELL)


COVERS = """cv AS (SELECT d.dem_id, d."row", d.col, n_nationkey AS seq, n_nationkey % 3 AS priority, CASE WHEN n_nationkey % 5 = 4 THEN 'swale' ELSE 'pad' END AS kind, CASE WHEN n_nationkey % 7 <> 6 THEN n_nationkey * 1e0 END AS target, 2e0 AS slope, d.col * 10e0 * 3.28084e0 AS feet
 FROM dem d, nation WHERE d.dem_id = n_nationkey % 4 AND d."row" BETWEEN n_nationkey % 11 AND n_nationkey % 11 + 4 AND d.col BETWEEN n_nationkey % 6 AND n_nationkey % 6 + 3)"""


@query("l03_graded_surface", f"""WITH {dem_sql()}, {COVERS}, b AS (SELECT dem_id, "row", col, arg_max({{'kind': kind, 'target': target, 'slope': slope, 'feet': feet}}, priority * 1000 + seq) AS o FROM cv GROUP BY ALL),
x AS (SELECT d.dem_id, d."row", d.col, CASE WHEN o IS NULL THEN z WHEN o.kind = 'swale' THEN 100e0 - o.feet * o.slope / 100e0 ELSE coalesce(o.target, z) END AS z, o IS NOT NULL AS graded FROM dem d LEFT JOIN b ON d.dem_id = b.dem_id AND d."row" = b."row" AND d.col = b.col)
SELECT dem_id, "row", col, graded, {r("z")} FROM x""")
def _(spark, sf_dir):
    return earthwork.graded(dem(spark, sf_dir), covers(spark, sf_dir))


def covers(spark, sf_dir):
    k = F.col("n_nationkey")
    areas = spark.read.parquet(f"{sf_dir}/nation.parquet").select((k % 4).cast("long").alias("dem_id"), k.alias("seq"), (k % 3).alias("priority"), F.when(k % 5 == 4, "swale").otherwise("pad").alias("kind"), F.when(k % 7 != 6, k * 1.0).alias("target"), F.lit(2.0).alias("slope"), (k % 11).alias("r0"), (k % 6).alias("c0"))
    return dem(spark, sf_dir).join(areas, "dem_id").where("row between r0 and r0 + 4 and col between c0 and c0 + 3").withColumn("feet", F.col("col") * CELL * earthwork.FEET)


#: Diamonds with a square hole, on the large raster; no middle of a cell lies on an edge.
DIAMONDS = """sh AS (SELECT s_suppkey AS id, s_suppkey * 131 % 2900 + 20.3e0 AS cx, s_suppkey * 57 % 1900 + 20.9e0 AS cy, 60 + s_suppkey % 9 * 20e0 AS reach FROM supplier),
bg AS (SELECT CAST(o_orderkey // 300 AS INT) AS "row", CAST(o_orderkey % 300 AS INT) AS col, o_totalprice / 1000e0 AS z FROM orders),
ms AS (SELECT id, reach, "row", col, z FROM (SELECT *, (col + 0.5e0) * 10 - cx AS dx, ("row" + 0.5e0) * 10 - cy AS dy FROM bg JOIN sh ON abs((col + 0.5e0) * 10 - cx) < reach AND abs(("row" + 0.5e0) * 10 - cy) < reach) WHERE abs(dx) + abs(dy) < reach AND NOT (abs(dx) < reach / 4 AND abs(dy) < reach / 4))"""


def diamonds(spark, sf_dir):
    k = F.col("s_suppkey")
    at = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 131 % 2900 + 20.3).alias("cx"), (k * 57 % 1900 + 20.9).alias("cy"), (60 + k % 9 * 20.0).alias("reach"))
    x, y, w, q = F.col("cx"), F.col("cy"), F.col("reach"), F.col("reach") / 4.0
    shell = F.array(G.point(x - w, y), G.point(x, y - w), G.point(x + w, y), G.point(x, y + w), G.point(x - w, y))
    return at.select(F.lit(0).cast("long").alias("site_id"), "id", "reach", F.array(shell, G.box(x - q, y - q, x + q, y + q)).alias("parts"))


@query("f10_ring_masks", f"WITH {DIAMONDS}, x AS (SELECT id, count(*) AS n_cells, avg(z) AS mean_z, min(z) AS min_z, max(z) AS max_z FROM ms GROUP BY id) SELECT id, n_cells, {r('mean_z', 'min_z', 'max_z')} FROM x")
def _(spark, sf_dir):
    """Cells under shapes with holes on the large raster, by spans of its rows."""
    under = spatial.zonal(big(spark, sf_dir), diamonds(spark, sf_dir), CELL)
    return under.groupBy(F.col("shape_id").alias("id")).agg(F.count("*").alias("n_cells"), F.avg("z").alias("mean_z"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


@query("l16_grading_zones", f"""WITH {DIAMONDS}, b AS (SELECT "row", col, arg_max({{'target': CASE WHEN id % 7 <> 6 THEN id * 1e0 END, 'kind': CASE WHEN id % 5 = 4 THEN 'swale' ELSE 'pad' END, 'feet': ((col + 0.5e0) * 10 - (cx - sh.reach)) * 3.28084e0}}, id % 3 * 1000000 + id) AS o FROM ms JOIN sh USING (id) GROUP BY ALL),
x AS (SELECT bg."row", bg.col, CASE WHEN o IS NULL THEN z WHEN o.kind = 'swale' THEN 100e0 - o.feet * 2e0 / 100e0 ELSE coalesce(o.target, z) END AS z, o IS NOT NULL AS graded FROM bg LEFT JOIN b ON bg."row" = b."row" AND bg.col = b.col) SELECT "row", col, graded, {r("z")} FROM x""")
def _(spark, sf_dir):
    """The large raster graded by zones that are given as shapes."""
    k = F.col("id")
    zones_ = diamonds(spark, sf_dir).select(F.col("site_id").alias("dem_id"), k.alias("seq"), (k % 3).alias("priority"), F.when(k % 5 == 4, "swale").otherwise("pad").alias("kind"), F.when(k % 7 != 6, k * 1.0).alias("target"), F.lit(2.0).alias("slope"), "parts")
    cells = big(spark, sf_dir)
    return earthwork.graded(cells, earthwork.covers(cells, zones_, CELL)).drop("dem_id")


@query("b06_heat_colours", f"""{CUT}, h AS (SELECT *, CAST(trunc((least(greatest(depth, -1e0), 1e0) + 1e0) / 2e0 * 255e0) AS INT) AS level FROM cf)
SELECT dem_id, "row", col, CASE WHEN depth > 0.5 THEN level ELSE 0 END AS r, CASE WHEN depth > 0.5 OR depth < -0.5 THEN 0 ELSE 128 END AS g, CASE WHEN depth < -0.5 THEN 255 - level ELSE 0 END AS b FROM h""")
def _(spark, sf_dir):
    return cut_fill(spark, sf_dir).select("dem_id", "row", "col", earthwork.heat(F.col("depth"), 1.0).alias("c")).select("dem_id", "row", "col", "c.*")
