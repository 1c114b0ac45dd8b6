"""Paths with fewer points: the greedy walk to the furthest point that a straight way reaches, by blocks of points.

Which directions a straight way may take is carried on from block to block: one interval from the points far off (more
than two tolerances) and a few merged arcs that points near by rule out. So a point's target needs no more than one
block at a time, and the walk over all targets is found by pointer doubling over the blocks that it enters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwright.tables import written

BLOCK = 1024
HALF = np.pi / 2
SAME = 1e-12


@dataclass
class Sight:
    """What a point sees ahead of it: the point, the furthest target yet, and the directions (mod pi) still open."""

    at: int
    x: float
    y: float
    z: float
    target: int
    about: float = np.nan  # direction of the first point far off
    low: float = -np.inf  # interval about it
    high: float = np.inf
    shut: list[float] = field(default_factory=list)  # starts and ends of arcs ruled out by points near by

    @property
    def closed(self) -> bool:
        return self.low > self.high + SAME

    def over(self, first: int, x: np.ndarray, y: np.ndarray, z: np.ndarray, tolerance: float, grade: float) -> None:
        """Look over the next points of the path, the first of them at the given place."""
        dx, dy = x - self.x, y - self.y
        size, angle = np.hypot(dx, dy), np.arctan2(dy, dx)
        far = size > 2 * tolerance
        ok = (size >= 1e-9) & (np.abs(z - self.z) <= grade * size)
        for start, end in zip(self.shut[::2], self.shut[1::2]):
            turned = np.mod(angle, np.pi)
            ok &= ~((turned > start + SAME) & (turned < end - SAME))
        if np.isnan(self.about) and far.any():
            self.about = float(angle[far.argmax()])
        if not np.isnan(self.about):
            angle = np.mod(angle - self.about + HALF, np.pi) - HALF
            half = np.arcsin(np.where(far, tolerance / np.maximum(size, 1e-300), 0.0))
            low = np.maximum.accumulate(np.r_[self.low, np.where(far, angle - half, -np.inf)])
            high = np.minimum.accumulate(np.r_[self.high, np.where(far, angle + half, np.inf)])
            ok &= (angle >= low[:-1] - SAME) & (angle <= high[:-1] + SAME)
            self.low, self.high = float(low[-1]), float(high[-1])
        near = np.flatnonzero((size > tolerance) & ~far)
        for k in near.tolist():
            ok[k + 1 :] &= np.abs(dx[k] * dy[k + 1 :] - dy[k] * dx[k + 1 :]) <= tolerance * size[k + 1 :]
        self._shut(np.arctan2(dy[near], dx[near]), HALF - np.arcsin(tolerance / size[near]))
        found = np.flatnonzero(ok)
        if len(found):
            self.target = first + int(found[-1])

    def _shut(self, angle: np.ndarray, width: np.ndarray) -> None:
        starts = np.mod(angle + HALF - width, np.pi)
        arcs = [*zip(self.shut[::2], self.shut[1::2])]
        for start, end in zip(starts.tolist(), (starts + 2 * width).tolist()):
            arcs += [(start, end)] if end <= np.pi else [(start, np.pi), (0.0, end - np.pi)]
        merged: list[float] = []
        for start, end in sorted(arcs):
            if merged and start < merged[-1]:
                merged[-1] = max(merged[-1], end)
            else:
                merged += [start, end]
        self.shut = merged


def _look(sight: Sight, first: int, xyz: list[np.ndarray], tolerance: float, grade: float) -> None:
    """Look over a block from its first place on, in stretches that grow, until no direction is open."""
    begin, step = max(0, sight.at + 1 - first), 32
    while begin < len(xyz[0]) and not sight.closed:
        sight.over(first + begin, *(a[begin : begin + step] for a in xyz), tolerance, grade)
        begin, step = begin + step, step * 2


_POINTS = pa.struct([("place", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
_SIGHT = "array<struct<at:long,x:double,y:double,z:double,target:long,about:double,low:double,high:double,shut:array<double>>>"
_LINKS = "array<struct<at:long,target:long>>"


def _arrays(points: pa.ListScalar) -> tuple[int, list[np.ndarray]]:
    values = points.values
    return values.field("place")[0].as_py(), [values.field(c).to_numpy(zero_copy_only=False) for c in "xyz"]


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_pylist([of({n: batch.column(n)[i] for n in batch.schema.names})], schema)


def _walked(links: dict[int, int], start: int) -> list[int]:
    out, at = [], start
    while at in links:
        out.append(at)
        at = links[at]
    return [*out, at]


def simplified(path: DataFrame, tolerance: float, max_grade: float, block: int = BLOCK) -> DataFrame:
    """Points of paths (path_id, seq, x, y, z and more) that remain: from each kept one the furthest ahead that a straight way
    reaches within the tolerance of all between and no steeper than the grade, else the next.

    A path of one block is walked in its own row. Points of longer ones look over a block a round until no direction is
    open, so rounds grow with the longest straight way, not with the path; no row holds more than a block. Points of equal
    seq are ordered by x, y and z; rows of a null path_id are one path; an empty table gives none.
    """
    grade = max_grade / 100
    order = Window.partitionBy("path_id").orderBy("seq", "x", "y", "z")
    ranked = written(path.withColumn("__place", (F.row_number().over(order) - 1).cast("long")).withColumn("__path", F.struct("path_id")), "ranked_points")
    key = ranked.schema["__path"].dataType
    point = F.struct(F.col("__place").alias("place"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    sizes = ranked.groupBy("__path").agg(F.count("*").alias("n"))
    packed = ranked.groupBy("__path", F.floor(F.col("__place") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    packed = written(packed.join(sizes, "__path"), "path_blocks")
    arrow_key = pa.struct([("path_id", _arrow(key.fields[0].dataType))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> dict:
            _, xyz = _arrays(row["points"])
            kept, n = [0], len(xyz[0])
            while kept[-1] < n - 1:
                at = kept[-1]
                sight = Sight(at, *(float(a[at]) for a in xyz), at + 1)
                _look(sight, 0, xyz, tolerance, grade)
                kept.append(sight.target)
            return {"__path": row["__path"].as_py(), "kept": kept}

        yield from _rows(batches, pa.schema([("__path", arrow_key), ("kept", pa.list_(pa.int64()))]), one)

    kept_schema = f"__path {key.simpleString()}, kept array<long>"
    kept = packed.where(F.col("n") <= block).mapInArrow(walk, kept_schema)
    deep = packed.where(F.col("n") > block)
    longest = deep.agg(F.max("n")).first()[0]
    if longest:
        kept = kept.unionByName(_walk_blocks(deep, key, arrow_key, tolerance, grade, block, -(-longest // block)))
    places = kept.select("__path", F.explode("kept").alias("__place"))
    return ranked.join(places, ["__path", "__place"], "left_semi").select(*path.columns)


def _arrow(of) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(of)


def _walk_blocks(deep: DataFrame, key, arrow_key: pa.DataType, tolerance: float, grade: float, block: int, blocks: int) -> DataFrame:
    """Kept places of paths of several blocks, a row a block that the walk enters."""
    sight_type = pa.list_(pa.struct([*((n, pa.int64() if n in ("at", "target") else pa.float64()) for n in ("at", "x", "y", "z", "target", "about", "low", "high")), ("shut", pa.list_(pa.float64()))]))
    out = pa.schema([("__path", arrow_key), ("home", pa.int64()), ("ahead", pa.int64()), ("done", pa.list_(pa.struct([("at", pa.int64()), ("target", pa.int64())]))), ("open", sight_type)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> dict:
            first, xyz = _arrays(row["points"])
            ends = first + len(xyz[0]) == row["n"].as_py()
            seen = row["open"].as_py()
            if seen is None:  # the points of this block themselves
                sights = [Sight(first + i, *(float(a[i]) for a in xyz), first + i + 1) for i in range(len(xyz[0]))]
                sights = sights[:-1] if ends else sights
            else:
                sights = [Sight(**s) for s in seen]
            for sight in sights:
                _look(sight, first, xyz, tolerance, grade)
            done = [{"at": s.at, "target": s.target} for s in sights if ends or s.closed]
            left = [vars(s) for s in sights if not (ends or s.closed)]
            return {"__path": row["__path"].as_py(), "home": row["home"].as_py(), "ahead": row["block"].as_py() + 1, "done": done, "open": left}

        yield from _rows(batches, out, one)

    schema = f"__path {key.simpleString()}, home long, ahead long, done {_LINKS}, open {_SIGHT}"
    turn = deep.select("__path", "block", "points", "n", F.col("block").alias("home"), F.lit(None).cast(_SIGHT).alias("open"))
    found = None
    while True:
        now = written(turn.mapInArrow(look, schema), "sights")
        found = now if found is None else found.unionByName(now)
        still = now.where(F.size("open") > 0)
        if not still.limit(1).count():
            break
        turn = still.select("__path", F.col("ahead").alias("block"), "home", "open").join(deep.select("__path", "block", "points", "n"), ["__path", "block"])
    links = written(found.groupBy("__path", "home").agg(F.flatten(F.collect_list("done")).alias("links")), "path_links")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> dict:
            own, exits = {r["at"]: r["target"] for r in row["links"].as_py()}, {}
            for at in sorted(own, reverse=True):
                exits[at] = exits.get(own[at], own[at])
            return {"__path": row["__path"].as_py(), "exits": [{"at": a, "target": t} for a, t in exits.items()]}

        yield from _rows(batches, pa.schema([("__path", arrow_key), ("exits", out.field("done").type)]), one)

    exits = links.mapInArrow(leave, f"__path {key.simpleString()}, exits {_LINKS}").select("__path", F.inline("exits"))
    jumps = written(exits, "path_jumps")
    entered = deep.select("__path").distinct().withColumn("at", F.lit(0).cast("long"))
    far = 1  # jumps lead over as many entered blocks
    while True:
        entered = written(entered.unionByName(entered.join(jumps, ["__path", "at"]).select("__path", F.col("target").alias("at"))), "path_entries")
        far *= 2
        if far >= 2 * blocks:
            break
        on = jumps.select("__path", F.col("at").alias("target"), F.col("target").alias("then"))
        jumps = written(jumps.join(on, ["__path", "target"]).select("__path", "at", F.col("then").alias("target")), "path_jumps")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row: dict) -> dict:
            walked = _walked({r["at"]: r["target"] for r in row["links"].as_py()}, row["at"].as_py())
            return {"__path": row["__path"].as_py(), "kept": walked}

        yield from _rows(batches, pa.schema([("__path", arrow_key), ("kept", pa.list_(pa.int64()))]), one)

    starts = entered.withColumn("home", F.floor(F.col("at") / block).cast("long"))
    return links.join(starts, ["__path", "home"]).mapInArrow(local, f"__path {key.simpleString()}, kept array<long>")
