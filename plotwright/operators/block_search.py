"""Least-cost searches over large graphs, a block of nodes at a time.

A graph is cut into blocks of nodes that lie together. Its arcs are packed once, a row a block, and stay where they
are. A round settles every block that has been entered anew, whole, inside one task, and passes on only the arcs that
leave it: what is shuffled a round are these entries, in proportion to the frontier, and the number of rounds is the
number of blocks that a path crosses, not of its arcs. Entries far beyond the nearest ones can wait (``width``, the
breadth of a distance bucket), so that a block is not settled again for ways that prove too long.

Ways are compared by cost, then length, then number of arcs, then the terminal they come from; the predecessor is the
least node by which the best way comes. Every arc adds to the number of arcs, so predecessors never form a ring, also
where arcs cost nothing, and each of these values is that of one way.

One searched block, its arcs included, must fit a task; what blocks of one graph have in common is one row an entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.tables import written

#: Node ids that a block takes where a graph has no better rule.
BLOCK_IDS = 4096
#: Rows of entries, of some dozen bytes, up to which they are sent to the packed arcs; more are joined by a shuffle.
FEW = 200_000

KEY = ["site_id", "search", "block"]
_WAY = "node long, cost double, length double, arcs int, origin long, prev long, prev_block long"
_WAYS = f"array<struct<{', '.join(f'{a}: {b}' for a, b in (c.split() for c in _WAY.split(', ')))}>>"


def id_block(node: Column) -> Column:
    """Blocks of consecutive ids."""
    return F.floor(node / BLOCK_IDS).cast("long")


def grid_block(node: Column, side: int = 64, stride: int = 100_000) -> Column:
    """Square blocks of grid nodes, whose ids are row * stride + column."""
    return F.floor(node / (stride * side)).cast("long") * stride + F.floor(node % stride / side).cast("long")


def packed_arcs(edges: DataFrame, block: Callable[[Column], Column]) -> DataFrame:
    """One row a block: its arcs (site_id, src, dst, weight, length), each edge in both directions."""
    length = "length" if "length" in edges.columns else "weight"
    one = edges.select("site_id", "src", "dst", F.col("weight").cast("double").alias("weight"), F.col(length).cast("double").alias("length"))
    both = one.unionByName(one.select("site_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "length"))
    arcs = F.struct("src", "dst", block(F.col("dst")).alias("to"), "weight", "length")
    return both.withColumn("block", block(F.col("src"))).groupBy("site_id", "block").agg(F.collect_list(arcs).alias("arcs"))


def _least(columns: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Of each group the place of its least row, compared by the columns in turn."""
    order = np.lexsort((*columns[::-1], group))
    return order[np.flatnonzero(np.diff(group[order], prepend=-1))]


def _less(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether rows of a come before those of b, by the columns in turn."""
    out, level = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for x, y in zip(a, b):
        out |= level & (x < y)
        level &= x == y
    return out


class Settled:
    """The best ways to the nodes of one block, given its arcs and the ways that enter it."""

    def __init__(self, arcs: dict[str, np.ndarray], entries: dict[str, np.ndarray], block: int):
        inside = arcs["to"] == block
        self.nodes = np.unique(np.concatenate([arcs["src"], arcs["dst"][inside], entries["node"]]))
        n = len(self.nodes)
        big = np.iinfo(np.int64).max
        self.key = [np.full(n, np.inf), np.full(n, np.inf), np.full(n, big), np.full(n, big)]
        src, self.inside = np.searchsorted(self.nodes, arcs["src"]), inside
        own = np.flatnonzero(inside)
        own = own[np.argsort(src[own], kind="stable")]
        self.src, self.dst = src[own], np.searchsorted(self.nodes, arcs["dst"][own])
        self.weight, self.length = arcs["weight"][own], arcs["length"][own]
        first = np.searchsorted(self.src, np.arange(n + 1))
        at = np.searchsorted(self.nodes, entries["node"])
        entered = [entries[c] for c in ("cost", "length", "arcs", "origin")]
        changed = self._take(at, entered)
        while len(changed):
            size = first[changed + 1] - first[changed]
            arcs_of = np.repeat(first[changed] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            changed = self._take(self.dst[arcs_of], self._over(self.src[arcs_of], self.weight[arcs_of], self.length[arcs_of]))
        self._predecessors(at, entered, entries, block)
        out = np.flatnonzero(~inside)
        self.out_src, self.out = src[out], {c: arcs[c][out] for c in ("dst", "to")}
        self.out_key = self._over(self.out_src, arcs["weight"][out], arcs["length"][out])

    def _over(self, src: np.ndarray, weight: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The ways over some arcs."""
        cost, far, arcs, origin = (k[src] for k in self.key)
        return [cost + weight, far + length, np.where(np.isfinite(cost), arcs + 1, arcs), origin]

    def _take(self, to: np.ndarray, ways: list[np.ndarray]) -> np.ndarray:
        """The nodes for which one of the ways is better than the one they have; they take it."""
        if not len(to):
            return to
        best = _least(ways, to)
        best = best[_less([w[best] for w in ways], [k[to[best]] for k in self.key])]
        for k, w in zip(self.key, ways):
            k[to[best]] = w[best]
        return to[best]

    def _predecessors(self, at: np.ndarray, entered: list[np.ndarray], entries: dict[str, np.ndarray], block: int) -> None:
        ways = [np.concatenate(x) for x in zip(entered, self._over(self.src, self.weight, self.length))]
        to = np.concatenate([at, self.dst])
        prev = np.concatenate([entries["prev"], self.nodes[self.src]])
        home = np.concatenate([entries["prev_block"], np.full(len(self.src), block)])
        same = np.all([w == k[to] for w, k in zip(ways, self.key)], axis=0) & np.isfinite(ways[0])
        to, prev, home = to[same], prev[same], home[same]
        best = _least([prev], to)
        self.prev, self.prev_block = np.full(len(self.nodes), -1), np.full(len(self.nodes), -1)
        self.prev[to[best]], self.prev_block[to[best]] = prev[best], home[best]

    def ways(self) -> list[np.ndarray]:
        """The columns of _WAY for every reached node."""
        at = np.flatnonzero(np.isfinite(self.key[0]))
        return [self.nodes[at], *(k[at] for k in self.key), self.prev[at], self.prev_block[at]]

    def leaving(self, block: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The best ways over arcs that leave the block, of each node that they lead to, and the blocks of these."""
        live = np.flatnonzero(np.isfinite(self.out_key[0]))
        _, group = np.unique(self.out["dst"][live], return_inverse=True)
        prev = self.nodes[self.out_src[live]]
        best = _least([*(k[live] for k in self.out_key), prev], group)
        own = live[best]
        return [self.out["dst"][own], *(k[own] for k in self.out_key), prev[best], np.full(len(own), block)], self.out["to"][own]


_KINDS = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
_NAMES = [c.split()[0] for c in _WAY.split(", ")]


def _structs(columns: list[np.ndarray], more: dict[str, np.ndarray] | None = None) -> pa.Array:
    arrays = [pa.array(c).cast(k) for c, k in zip(columns, _KINDS)]
    more = more or {}
    return pa.StructArray.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in more.values())], names=[*_NAMES, *more])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def columns(lists: pa.Array, k: int) -> dict[str, np.ndarray]:
        own = lists.slice(k, 1).flatten()
        return {own.type.field(c).name: own.field(c).to_numpy(zero_copy_only=False) for c in range(own.type.num_fields)}

    for batch in batches:
        blocks = batch.column("block").to_pylist()
        for k, block in enumerate(blocks):
            settled = Settled(columns(batch.column("arcs"), k), columns(batch.column("entries"), k), block)
            leaving, to = settled.leaving(block)
            one = [batch.column(c).slice(k, 1) for c in KEY]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (_structs(settled.ways()), _structs(leaving, {"to": to}))]
            yield pa.RecordBatch.from_arrays([*one, *lists], names=[*KEY, "ways", "leaving"])


_EMPTY = "cast(array() as array<struct<src: long, dst: long, to: long, weight: double, length: double>>)"
_ORDER = ["cost", "length", "arcs", "origin", "prev"]


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """df, marked to be sent to every task where it is small; else blocks, which pack well in their files, are not sent either."""
    return F.broadcast(df) if rows <= FEW else df


def searched(edges: DataFrame, sources: DataFrame, block: Callable[[Column], Column] = id_block, width: float | None = None) -> DataFrame:
    """site_id, search, block, ways: the best ways from the nearest source of each search to all nodes they reach.

    edges: site_id, src, dst, weight (not negative) and, if ways are to be measured too, length; sources: site_id,
    search, node. One row a block, written; ways holds node, cost, length, arcs, origin (a source), prev and its block.
    """
    start = sources.select("site_id", "search", block(F.col("node")).alias("block"), "node", F.lit(0.0).alias("cost"), F.lit(0.0).alias("length"), F.lit(0).alias("arcs"), F.col("node").alias("origin"), F.lit(-1).cast("long").alias("prev"), F.lit(-1).cast("long").alias("prev_block"))
    fresh = written(start.distinct(), "entries")
    packed = packed_arcs(edges, block)
    lone = fresh.select("site_id", "block").distinct().join(packed.select("site_id", "block"), ["site_id", "block"], "left_anti")
    packed = written(packed.unionByName(lone.withColumn("arcs", F.expr(_EMPTY))), "arcs")
    key = ", ".join(f"{c} {fresh.schema[c].dataType.simpleString()}" for c in KEY)
    known, settled, turn, rows = fresh, None, 0, fresh.count()
    while rows or not turn:
        due = fresh
        if width is not None:
            nearest = fresh.groupBy("site_id", "search").agg(F.min("cost").alias("nearest"))
            due = fresh.join(nearest, ["site_id", "search"]).where(F.col("cost") < F.col("nearest") + width).drop("nearest")
        asked = due.select(KEY).distinct()
        entered = (known.join(_sent(asked, rows), KEY, "left_semi") if turn else known).groupBy(KEY).agg(F.collect_list(F.struct(*_NAMES)).alias("entries"))
        met = _sent(entered, rows).join(packed.hint("merge"), ["site_id", "block"]).select(*KEY, "entries", "arcs")
        found = written(met.mapInArrow(_settle, f"{key}, ways {_WAYS}, leaving {_WAYS[:-2]}, to: long>>").withColumn("turn", F.lit(turn)), "settled")
        settled = found if settled is None else settled.unionByName(found)
        n = found.agg(F.sum(F.size("leaving"))).first()[0] or 0
        left = found.select("site_id", "search", F.explode("leaving").alias("w")).select("site_id", "search", F.col("w.to").alias("block"), *[f"w.{c}" for c in _NAMES])
        best = left.groupBy(*KEY, "node").agg(F.min(F.struct(*_ORDER, "prev_block")).alias("w")).select(*KEY, "node", "w.*")
        had = known.groupBy(*KEY, "node").agg(F.min(F.struct(*_ORDER)).alias("had"))
        if n <= FEW:  # then it is not the whole of known that is dealt
            had = known.join(F.broadcast(best.select(*KEY, "node")), [*KEY, "node"], "left_semi").groupBy(*KEY, "node").agg(F.min(F.struct(*_ORDER)).alias("had"))
        better = best.join(had.hint("merge"), [*KEY, "node"], "left").where(F.col("had").isNull() | (F.struct(*_ORDER) < F.col("had"))).select(*KEY, *_NAMES)
        better = written(better, "entries")
        fresh = better if width is None else written(fresh.join(asked, KEY, "left_anti").unionByName(better), "entries")
        known, turn, rows = known.unionByName(better), turn + 1, fresh.count()
    last = settled.groupBy(KEY).agg(F.max("turn").alias("turn"))
    return written(settled.join(last.hint("merge"), [*KEY, "turn"]).select(*KEY, "ways"), "ways") if turn > 1 else settled.select(*KEY, "ways")


def reach(found: DataFrame) -> DataFrame:
    """site_id, search, node, cost, length, arcs, origin, prev (null at a source): a row a node that is reached."""
    rows = found.select("site_id", "search", F.explode("ways").alias("w")).select("site_id", "search", "w.*")
    return rows.withColumn("prev", F.when(F.col("prev") >= 0, F.col("prev"))).drop("prev_block")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of each path that lies in a block: its nodes, and where it goes on."""
    for batch in batches:
        at, goal = batch.column("at").to_pylist(), batch.column("goal")
        ways, before = batch.column("ways"), None
        for k, (node, block) in enumerate(zip(at, batch.column("block").to_pylist())):
            own = ways.slice(k, 1).flatten()
            nodes, prev, home, arcs = (own.field(c).to_numpy(zero_copy_only=False) for c in ("node", "prev", "prev_block", "arcs"))
            path, here = [], block
            while here == block:
                i = int(np.searchsorted(nodes, node))
                path.append((node, int(arcs[i])))
                node, here = int(prev[i]), int(home[i])
            lists = pa.ListArray.from_arrays(pa.array([0, len(path)], pa.int32()), pa.StructArray.from_arrays([pa.array([p[0] for p in path], pa.int64()), pa.array([p[1] for p in path], pa.int32())], names=["node", "arcs"]))
            yield pa.RecordBatch.from_arrays([batch.column("site_id").slice(k, 1), batch.column("search").slice(k, 1), goal.slice(k, 1), lists, pa.array([node], pa.int64()), pa.array([here], pa.int64())], names=["site_id", "search", "goal", "path", "at", "block"])


def paths(found: DataFrame, goals: DataFrame, block: Callable[[Column], Column] = id_block) -> DataFrame:
    """site_id, search, goal, node, arcs: the nodes of the best ways to some goals (site_id, search, goal), arcs counted from the source.

    A round walks through one block, and all paths at once.
    """
    at = goals.select("site_id", "search", "goal").distinct().select("site_id", "search", "goal", F.col("goal").alias("at"), block(F.col("goal")).alias("block"))
    at, whole = written(at, "at"), None
    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    schema = f"site_id {kinds['site_id']}, search {kinds['search']}, goal long, path array<struct<node: long, arcs: int>>, at long, block long"
    while True:
        rows = at.count()
        if not rows and whole is not None:
            return whole
        reached = found.where(F.size("ways") > 0)
        met = _sent(at, rows).join(reached.hint("merge"), KEY).where(F.exists("ways", lambda w: w["node"] == F.col("at")))
        step = written(met.select(*KEY, F.col("goal").cast("long").alias("goal"), F.col("at").cast("long").alias("at"), "ways").mapInArrow(_walk, schema), "walk")
        part = step.select("site_id", "search", "goal", F.explode("path").alias("p")).select("site_id", "search", "goal", "p.*")
        whole = part if whole is None else whole.unionByName(part)
        at = written(step.where("block >= 0").select("site_id", "search", "goal", "at", "block"), "at")


def nearest_links(edges: DataFrame, found: DataFrame) -> DataFrame:
    """site_id, src, dst (origins, src < dst), length, cost, and the edge (a, b) that joins their regions best.

    found: ways of one search a site from all its terminals. Each node belongs to the region of the terminal that it
    comes from; an edge between two regions is a way from one terminal to the other, and of each pair the shortest is
    kept. Where cost is the length, a least spanning tree of these links weighs as much as one of all pairs' ways.
    """
    at = reach(found).select("site_id", "node", "origin", "cost", "length")
    end = lambda c: at.select("site_id", F.col("node").alias(c), F.col("origin").alias(f"{c}_origin"), F.col("cost").alias(f"{c}_cost"), F.col("length").alias(f"{c}_length"))
    own = edges.withColumn("own_length", F.col("length" if "length" in edges.columns else "weight")).select("site_id", "src", "dst", "weight", "own_length")
    met = own.join(end("src").hint("merge"), ["site_id", "src"]).join(end("dst").hint("merge"), ["site_id", "dst"]).where("src_origin <> dst_origin")
    swap = F.col("src_origin") > F.col("dst_origin")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    length = F.col("src_length") + F.col("own_length") + F.col("dst_length")
    cost = F.col("src_cost") + F.col("weight") + F.col("dst_cost")
    one = met.select("site_id", pick("src_origin", "dst_origin").alias("src"), pick("dst_origin", "src_origin").alias("dst"), F.struct(length.alias("length"), cost.alias("cost"), pick("src", "dst").alias("a"), pick("dst", "src").alias("b")).alias("way"))
    return one.groupBy("site_id", "src", "dst").agg(F.min("way").alias("way")).select("site_id", "src", "dst", "way.*")
