"""Planar geometry as column expressions: rings are arrays of points (x, y), closed; a polygon is a shell, then holes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once; what is used twice would stand twice in the plan, and more so inside others."""
    return F.transform(F.array(value), of)[0]


def point(x, y) -> Column:
    return F.struct((F.col(x) if isinstance(x, str) else x).cast("double").alias("x"), (F.col(y) if isinstance(y, str) else y).cast("double").alias("y"))


def closed(points: list[Column]) -> Column:
    return F.array(*points, points[0])


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return closed([point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)])


def footprint(x: Column, y: Column, width: Column, length: Column, rotation: Column) -> Column:
    """The closed ring of a rectangle about its middle, turned by degrees; quarter turns are exact."""
    quarter = F.pmod(rotation, F.lit(360.0)) / 90.0
    exact = F.when(quarter.isin(0.0, 1.0, 2.0, 3.0), quarter.cast("int"))
    both = lambda c, s: F.struct(c.alias("c"), s.alias("s"))
    known = F.array(*[both(F.lit(c), F.lit(s)) for c, s in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))])
    turn = F.coalesce(F.get(known, exact), both(F.cos(F.radians(rotation)), F.sin(F.radians(rotation))))

    def corners(t: Column) -> Column:
        at = lambda a, b: point(x + width * a * t["c"] - length * b * t["s"], y + width * a * t["s"] + length * b * t["c"])
        return closed([at(-0.5, -0.5), at(0.5, -0.5), at(0.5, 0.5), at(-0.5, 0.5)])

    return _let(turn, corners)


def edges(ring: Column) -> Column:
    """Consecutive pairs of points."""
    return F.transform(F.slice(ring, 2, F.size(ring)), lambda b, i: F.struct(F.get(ring, i).alias("a"), b.alias("b")))


def _cross(e: Column, o: Column | None = None) -> Column:
    """Twice the signed area of the triangle of an edge and a point, the origin if none is given."""
    if o is None:
        return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    return (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])


def signed_area(ring: Column) -> Column:
    """From the first corner, not the origin: small rings far away keep their digits."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + _cross(e, ring[0])) / 2.0


def area(parts: Column) -> Column:
    """Shell less holes."""
    return F.abs(signed_area(parts[0])) - F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(0.0), lambda s, r: s + F.abs(signed_area(r)))


def length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)))


def centroid(ring: Column) -> Column:
    o = ring[0]
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a"))

    def step(s: Column, e: Column) -> Column:
        part = lambda c: s[c] + (e["a"][c] + e["b"][c] - 2.0 * o[c]) * _cross(e, o)
        return F.struct(part("x").alias("x"), part("y").alias("y"), (s["a"] + _cross(e, o)).alias("a"))

    return F.aggregate(edges(ring), zero, step, lambda s: point(o["x"] + F.try_divide(s["x"], 3.0 * s["a"]), o["y"] + F.try_divide(s["y"], 3.0 * s["a"])))


def bounds(points: Column) -> Column:
    pick = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(pick(F.array_min, "x").alias("min_x"), pick(F.array_min, "y").alias("min_y"), pick(F.array_max, "x").alias("max_x"), pick(F.array_max, "y").alias("max_y"))


def _right_of(x: Column, y: Column, sides: Column) -> Column:
    """Whether an odd number of edges lie to the right of a point."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.coalesce(F.try_divide(y - a["y"], b["y"] - a["y"]), F.lit(0.0)) + a["x"])

    return F.size(F.filter(sides, crossed)) % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether an odd number of edges lie to the right."""
    return _right_of(x, y, edges(ring))


def contains(parts: Column, x: Column, y: Column) -> Column:
    """Whether the point lies in an odd number of rings: in the shell and in no hole."""
    return F.size(F.filter(parts, lambda r: in_ring(x, y, r))) % 2 == 1


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(x - a["x"] - t * dx, 2) + F.pow(y - a["y"] - t * dy, 2))


def segment_nearest(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.struct(segment_distance(x, y, e).alias("d"), (a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"))


def line_distance(x: Column, y: Column, line: Column) -> Column:
    return F.array_min(F.transform(edges(line), lambda e: segment_distance(x, y, e)))


def nearest_on(x: Column, y: Column, line: Column) -> Column:
    """The nearest point of a line and its distance: d, x, y."""
    return F.array_min(F.transform(edges(line), lambda e: segment_nearest(x, y, e)))


def polygon_distance(x: Column, y: Column, parts: Column) -> Column:
    return F.when(contains(parts, x, y), 0.0).otherwise(F.array_min(F.transform(parts, lambda r: line_distance(x, y, r))))


def _side(p: Column, q: Column, o: Column) -> Column:
    return (q["x"] - p["x"]) * (o["y"] - p["y"]) - (q["y"] - p["y"]) * (o["x"] - p["x"])


def segments_cross(e: Column, f: Column) -> Column:
    """Whether two segments cross at inner points."""
    return (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) < 0) & (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) < 0)


def rings_cross(r: Column, s: Column) -> Column:
    return F.exists(edges(r), lambda e: F.exists(edges(s), lambda f: segments_cross(e, f)))


def ring_distance(r: Column, s: Column) -> Column:
    """Zero if the areas meet, else the least distance of a corner of one from an edge of the other."""

    def of(k: Column) -> Column:
        e, f = k["e"], k["f"]
        corner = lambda a, b: F.array_min(F.transform(a, lambda p: F.array_min(F.transform(b, lambda u: segment_distance(p["x"], p["y"], u)))))
        inside = F.exists(r, lambda p: _right_of(p["x"], p["y"], f)) | F.exists(s, lambda p: _right_of(p["x"], p["y"], e))
        crossed = F.exists(e, lambda u: F.exists(f, lambda v: segments_cross(u, v)))
        return F.when(crossed | inside, 0.0).otherwise(F.least(corner(r, f), corner(s, e)))

    return _let(F.struct(edges(r).alias("e"), edges(s).alias("f")), of)


def clip(subject: Column, window: Column) -> Column:
    """A convex ring clipped by a convex counter-clockwise ring: open, by half planes in turn."""
    none = F.expr(f"cast(array() as array<{POINT}>)")

    def cut(ring: Column, e: Column) -> Column:
        def part(u: Column, v: Column) -> Column:
            p, q = u["p"], v["p"]
            meet = lambda t: point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            crossing = F.when((u["s"] >= 0) != (v["s"] >= 0), F.transform(F.array(F.try_divide(u["s"], u["s"] - v["s"])), meet)).otherwise(none)
            return F.concat(F.when(u["s"] >= 0, F.array(p)).otherwise(none), crossing)

        sided = F.transform(ring, lambda p: F.struct(p.alias("p"), _side(e["a"], e["b"], p).alias("s")))
        return F.flatten(_let(sided, lambda k: F.transform(k, lambda u, i: part(u, F.get(k, (i + 1) % F.size(k))))))

    return F.aggregate(edges(window), F.transform(F.slice(subject, 1, F.size(subject) - 1), lambda p: point(p["x"], p["y"])), cut)


def clip_area(subject: Column, window: Column) -> Column:
    """The common area of two convex rings, the second counter-clockwise."""
    sides = lambda ring: F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))
    return F.abs(F.aggregate(_let(clip(subject, window), sides), F.lit(0.0), lambda s, e: s + _cross(e))) / 2.0


def is_convex(ring: Column) -> Column:
    """Whether a ring turns one way only and once around: what clip_area needs of both of its rings."""

    def of(e: Column) -> Column:
        turns = F.transform(e, lambda u, i: _side(u["a"], u["b"], F.get(e, (i + 1) % F.size(e))["b"]))
        one_way = _let(turns, lambda ts: F.forall(ts, lambda t: t >= 0) | F.forall(ts, lambda t: t <= 0))
        return one_way & ~F.exists(e, lambda u: F.exists(e, lambda v: segments_cross(u, v)))

    return _let(edges(ring), of)


def _crossing_heights(a: Column, b: Column) -> Column:
    """The ordinates at which edges of two rings cross."""

    def height(e: Column, f: Column) -> Column:
        less = lambda p, q: (p["x"] - q["x"], p["y"] - q["y"])
        (ux, uy), (vx, vy), (wx, wy) = less(e["b"], e["a"]), less(f["b"], f["a"]), less(f["a"], e["a"])
        turn = ux * vy - uy * vx
        parts = F.struct(F.try_divide(wx * vy - wy * vx, turn).alias("s"), F.try_divide(wx * uy - wy * ux, turn).alias("t"))
        return _let(parts, lambda k: F.when(k["s"].between(0.0, 1.0) & k["t"].between(0.0, 1.0), e["a"]["y"] + k["s"] * uy))

    return F.array_compact(F.flatten(F.transform(edges(a), lambda e: F.transform(edges(b), lambda f: height(e, f)))))


def _spans_at(ring: Column, y: Column) -> Column:
    """The stretches of a horizontal line that lie in a ring."""
    crossed = F.filter(edges(ring), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(crossed, lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * ((y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]))))
    return _let(xs, lambda at: F.zip_with(F.filter(at, lambda _, k: k % 2 == 0), F.filter(at, lambda _, k: k % 2 == 1), lambda u, v: F.struct(u.alias("u"), v.alias("v"))))


def slab_area(a: Column, b: Column) -> Column:
    """The common area of two rings of any shape and direction, by trapezoids.

    Corners and crossings cut the plane into slabs. In a slab no edge begins, ends or crosses, so its common part is
    trapezoids, whose area is the length of what is common half-way up times the slab's height.
    """
    heights = F.array_sort(F.array_distinct(F.concat(F.transform(a, lambda p: p["y"]), F.transform(b, lambda p: p["y"]), _crossing_heights(a, b))))
    slabs = _let(heights, lambda hs: F.transform(F.slice(hs, 2, F.size(hs)), lambda hi, i: F.struct(((F.get(hs, i) + hi) / 2.0).alias("y"), (hi - F.get(hs, i)).alias("h"))))

    def common(spans: Column) -> Column:
        one = lambda p: F.aggregate(spans["b"], F.lit(0.0), lambda s, q: s + F.greatest(F.lit(0.0), F.least(p["v"], q["v"]) - F.greatest(p["u"], q["u"])))
        return F.aggregate(spans["a"], F.lit(0.0), lambda s, p: s + one(p))

    at = lambda y: F.struct(_spans_at(a, y).alias("a"), _spans_at(b, y).alias("b"))
    return F.aggregate(slabs, F.lit(0.0), lambda s, k: s + _let(at(k["y"]), common) * k["h"])


def is_plain(ring: Column) -> Column:
    """Whether a ring is convex and counter-clockwise: such pairs can be clipped."""
    return is_convex(ring) & (signed_area(ring) > 0)


def overlap_area(a: Column, b: Column, plain: Column | None = None) -> Column:
    """The common area of two simple rings: of convex ones by clipping, of others by trapezoids; plain says whether both are, where that is known."""
    return F.when(is_plain(a) & is_plain(b) if plain is None else plain, clip_area(a, b)).otherwise(slab_area(a, b))


def upright(ring: Column) -> Column:
    """The bounds of a ring that is a rectangle along the axes, null for others."""
    level = lambda i, j: ring[i]["y"] == ring[j]["y"]
    steep = lambda i, j: ring[i]["x"] == ring[j]["x"]
    turned = (level(0, 1) & steep(1, 2) & level(2, 3) & steep(3, 0)) | (steep(0, 1) & level(1, 2) & steep(2, 3) & level(3, 0))
    return F.when(F.when(F.size(ring) == 5, (ring[0] == ring[4]) & turned), bounds(ring))


def upright_area(a: Column, b: Column) -> Column:
    """The common area of two rectangles along the axes, given by their bounds."""
    side = lambda c: F.greatest(F.least(a[f"max_{c}"], b[f"max_{c}"]) - F.greatest(a[f"min_{c}"], b[f"min_{c}"]), F.lit(0.0))
    return side("x") * side("y")


def upright_distance(a: Column, b: Column) -> Column:
    """The distance of two rectangles along the axes, given by their bounds: zero if they meet."""
    gap = lambda c: F.greatest(a[f"min_{c}"] - b[f"max_{c}"], b[f"min_{c}"] - a[f"max_{c}"], F.lit(0.0))
    return F.sqrt(F.pow(gap("x"), 2) + F.pow(gap("y"), 2))


def has_corner_inside(r: Column, s: Column) -> Column:
    """Whether a corner of either ring lies in the other: a cheap first test, which misses rings that cross without corners inside."""
    return F.exists(r, lambda p: in_ring(p["x"], p["y"], s)) | F.exists(s, lambda p: in_ring(p["x"], p["y"], r))


def point_at(line: Column, fraction: float) -> Column:
    """The point at a fraction of a line's length."""
    goal = length(line) * fraction
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, e: Column) -> Column:
        size = F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
        t = F.coalesce(F.try_divide(goal - s["gone"], size), F.lit(0.0))
        here = s["x"].isNull() & (s["gone"] + size >= goal)
        return F.struct((s["gone"] + size).alias("gone"), F.when(here, e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).otherwise(s["x"]).alias("x"), F.when(here, e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).otherwise(s["y"]).alias("y"))

    return F.aggregate(edges(line), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def area_sqm(ring: Column) -> Column:
    """Square metres of a ring in degrees: by the mean length of a degree at its middle latitude, squared."""
    mean = (F.cos(F.radians(centroid(ring)["y"])) * 111_320.0 + 110_574.0) / 2.0
    return F.abs(signed_area(ring)) * mean * mean


def perimeter_m(ring: Column) -> Column:
    """Metres around a ring in degrees, by degrees of longitude and latitude at its middle."""
    k = F.cos(F.radians(centroid(ring)["y"])) * 111_320.0
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow((e["b"]["x"] - e["a"]["x"]) * k, 2) + F.pow((e["b"]["y"] - e["a"]["y"]) * 110_574.0, 2)))


def issues(ring: Column) -> Column:
    """What is wrong with a ring in degrees."""
    e = edges(ring)
    own = F.transform(e, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    crossing = F.exists(own, lambda a: F.exists(own, lambda b: (b["i"] > a["i"] + 1) & segments_cross(a["v"], b["v"])))
    return F.array_compact(F.array(
        F.when(ring[0] != F.element_at(ring, -1), "unclosed ring"), F.when(F.size(F.array_distinct(ring)) < 3, "fewer than three corners"), F.when(crossing, "edges cross"),
        F.when(F.exists(ring, lambda p: ~(p["x"].between(-180.0, 180.0) & p["y"].between(-90.0, 90.0))), "coordinates out of range"),
    ))


def repaired(ring: Column) -> Column:
    """The ring without repeated corners, closed, counter-clockwise."""
    kept = F.filter(ring, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(ring, i - 1)))
    shut = _let(kept, lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    return _let(shut, lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r))


def wkt_ring(ring: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))


def to_wkt(parts: Column) -> Column:
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(parts, wkt_ring), ", "), F.lit(")"))


def line_wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING "), wkt_ring(line))


def from_wkt(text: Column) -> Column:
    """Kind and parts of POINT, LINESTRING, POLYGON and MULTIPOLYGON: every innermost list of points is a part."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    pair = lambda s: F.split(F.trim(s), r"\s+")
    parts = F.transform(rings, lambda r: F.transform(F.split(r, ","), lambda s: point(F.get(pair(s), F.lit(0)).try_cast("double"), F.get(pair(s), F.lit(1)).try_cast("double"))))
    return F.struct(F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1)).alias("kind"), parts.alias("parts"))


def kml_coordinates(text: Column) -> Column:
    """Points of white-space separated lon,lat[,alt]; a tuple that is none, or out of range, is null."""
    tuples = F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != "")
    n = lambda s, i: F.get(F.split(s, ","), F.lit(i)).try_cast("double")
    return F.transform(tuples, lambda s: F.when(n(s, 0).between(-180.0, 180.0) & n(s, 1).between(-90.0, 90.0), point(n(s, 0), n(s, 1))))


def buffered_area(ring: Column, distance: float) -> Column:
    """The area of a convex ring grown by a distance, round at the corners."""
    return F.abs(signed_area(ring)) + length(ring) * distance + math.pi * distance * distance
