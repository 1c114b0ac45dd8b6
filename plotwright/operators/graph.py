"""Graphs as edge tables: components, least-cost paths, spanning trees, degrees, junctions.

Loops keep their state in written tables and fetch one row of counts a round, never nodes or edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.tables import written

from . import block_search as blocks


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(links: DataFrame, left: str, right: str) -> DataFrame:
    """Per linked node (of any orderable type) its component: columns node and root, the component's least node."""
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    edges = written(edges, "links")
    state = _state(edges)
    before = None
    while state[0] and state != before:  # the number of rounds grows with the square of its logarithm at most
        edges = written(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def labelled(nodes: DataFrame, links: DataFrame, left: str, right: str) -> DataFrame:
    """nodes (column node) with root, alone or the least of their component."""
    return nodes.join(stars(links, left, right), "node", "left").withColumn("root", F.coalesce("root", "node"))


def local_roots(links: DataFrame) -> DataFrame:
    """graph, node, root of the ends of links (graph, block, a, b; long ids): the least node that links of its own block join it with.

    A block's links are settled in one task, without rounds.
    """

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(frame[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            after = root.copy()
            np.minimum.at(after, root[a], low)
            np.minimum.at(after, root[b], low)
            after = after[after]
            if (after == root).all():
                return pd.DataFrame({"graph": frame["graph"].iloc[0], "node": ids, "root": ids[root]})
            root = after

    kind = links.schema["graph"].dataType.simpleString()
    return links.groupBy("graph", "block").applyInPandas(step, f"graph {kind}, node long, root long")


def labelled_by_blocks(nodes: DataFrame, links: DataFrame, block: Callable[[Column], Column]) -> DataFrame:
    """nodes (graph, node; long ids) with root, the least node of their component: blocks are settled first, and only what joins them goes round."""
    own = written(links.select("graph", "a", "b", block(F.col("a")).alias("block"), block(F.col("b")).alias("other")), "block-links")
    local = written(local_roots(own.where("block = other").select("graph", "block", "a", "b")), "local-roots")
    inner = nodes.join(local.hint("merge"), ["graph", "node"], "left").select("graph", "node", F.coalesce("root", "node").alias("inner"))
    look = lambda c: local.select("graph", F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    across = own.where("block <> other").join(look("a").hint("merge"), ["graph", "a"], "left").join(look("b").hint("merge"), ["graph", "b"], "left")
    key = lambda c: F.struct("graph", c.alias("node"))
    outer = stars(across.select(key(F.coalesce("a_root", "a")).alias("x"), key(F.coalesce("b_root", "b")).alias("y")), "x", "y")
    outer = outer.select(F.col("node.graph").alias("graph"), F.col("node.node").alias("inner"), F.col("root.node").alias("outer"))
    return inner.join(outer.hint("merge"), ["graph", "inner"], "left").select("graph", "node", F.coalesce("outer", "inner").alias("root"))


def least_costs(edges: DataFrame, sources: DataFrame, width: float | None = None, block: Callable[[Column], Column] = blocks.id_block) -> DataFrame:
    """site_id, source, node, dist, prev, arcs of every node that a source reaches.

    edges: site_id, src, dst, weight (not negative), walked in both directions; sources: site_id, source. Whole blocks
    of nodes are settled at once (block_search), all sites and sources together. Of ways of equal cost the one of
    fewest arcs is taken, then the least predecessor.
    """
    found = blocks.searched(edges.drop("length"), sources.select("site_id", F.col("source").alias("search"), F.col("source").alias("node")), block, width)
    return blocks.reach(found).select("site_id", F.col("search").alias("source"), "node", F.col("cost").alias("dist"), "prev", "arcs")


def path_nodes(reach: DataFrame, goals: DataFrame, block: Callable[[Column], Column] = blocks.id_block) -> DataFrame:
    """site_id, source, goal, node, back (steps from the goal): paths of goals (site_id, source, goal), all walked back at once, a block a round."""
    none = F.lit(-1).cast("long")
    way = F.struct("node", F.coalesce("prev", none).alias("prev"), F.coalesce(block(F.col("prev")), none).alias("prev_block"), "arcs")
    packed = reach.select("site_id", F.col("source").alias("search"), block(F.col("node")).alias("block"), way.alias("way"))
    packed = written(packed.groupBy("site_id", "search", "block").agg(F.sort_array(F.collect_list("way")).alias("ways")), "reach")
    walked = blocks.paths(packed, goals.select("site_id", F.col("source").alias("search"), "goal"), block)
    end = walked.groupBy("site_id", "search", "goal").agg(F.max("arcs").alias("far"))
    return walked.join(end, ["site_id", "search", "goal"]).select("site_id", F.col("search").alias("source"), "goal", "node", (F.col("far") - F.col("arcs")).alias("back"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (site_id, src, dst, weight) of least total weight that connect each site, by rounds of Boruvka; ties by src, dst."""
    node = lambda c: F.struct("site_id", F.col(c).alias("n"))
    e = written(edges.select("site_id", "src", "dst", "weight", node("src").alias("a"), node("dst").alias("b")), "forest-edges")
    chosen, live = None, e.withColumns({"ra": F.col("a"), "rb": F.col("b")})
    while True:  # each round halves the trees at least
        key = F.struct("weight", "src", "dst")
        ends = live.select(F.col("ra").alias("r"), key.alias("k"), "site_id").union(live.select("rb", key, "site_id"))
        picked = ends.groupBy("r").agg(F.min("k").alias("k"), F.first("site_id").alias("site_id")).select("site_id", "k.*").distinct()
        if not picked.limit(1).count():
            break
        chosen = written(picked if chosen is None else chosen.unionByName(picked).distinct(), "forest")
        linked = chosen.select(node("src").alias("a"), node("dst").alias("b"))
        roots = stars(linked, "a", "b")
        look = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
        live = e.join(look("a", "ra"), "a", "left").join(look("b", "rb"), "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")
        live = written(live, "forest-live")
    return chosen if chosen is not None else e.select("site_id", "weight", "src", "dst").limit(0)


def degrees(edges: DataFrame) -> DataFrame:
    """site_id, node, degree."""
    return edges.select("site_id", F.col("src").alias("node")).union(edges.select("site_id", "dst")).groupBy("site_id", "node").agg(F.count("*").alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per site: nodes, edges, components, whether one component, mean degree."""
    key = F.struct("site_id", "node")
    linked = edges.select(F.struct("site_id", F.col("src").alias("node")).alias("a"), F.struct("site_id", F.col("dst").alias("node")).alias("b"))
    parts = labelled(nodes.select(key.alias("node")), linked, "a", "b").groupBy(F.col("node.site_id").alias("site_id")).agg(F.count("*").alias("n_nodes"), F.countDistinct("root").alias("n_components"))
    n_edges = edges.groupBy("site_id").agg(F.count("*").alias("n_edges"))
    found = parts.join(n_edges, "site_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return found.withColumns({"connected": F.col("n_components") == 1, "mean_degree": 2.0 * F.col("n_edges") / F.col("n_nodes")})
