"""Peeling of the inner nodes into components, and the forest of components over the rounds."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.components import FINISH, connected_components
from lacuna.operators.graph import components
from lacuna.operators.indexing import dense_index
from lacuna.sources.staging import small, stage


@dataclass
class Lineage:
    """members (iter, cid, node_id); parents (parent_iter, parent_cid, iter, cid); levels (node_id, iter_label); comps (iter, cid, size)."""

    members: DataFrame
    parents: DataFrame
    levels: DataFrame
    comps: DataFrame


def peel(working: DataFrame, adj: DataFrame) -> DataFrame:
    """Nodes of working all of whose neighbours are in working."""
    inside = working.select("node_id")
    mine = adj.join(inside.withColumnRenamed("node_id", "node"), "node", "left_semi")
    edge = mine.join(inside.withColumnRenamed("node_id", "nbr"), "nbr", "left_anti").select(F.col("node").alias("node_id"))
    return inside.join(edge, "node_id", "left_anti")


def numbered_components(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(cid, node_id) of components with at least so many nodes, numbered from 0 by their smallest node."""
    found = stage(components(nodes, edges), "components")
    sizes = found.groupBy("component").count().where(F.col("count") >= least).select("component")
    return found.join(dense_index(sizes, ["component"], "cid"), "component").select("cid", "node_id")


def depths(inner: DataFrame, adj: DataFrame, rounds: int) -> DataFrame:
    """(node_id, depth): the peeling rounds that each of inner survives, at most rounds.

    A node survives as many rounds as there are steps from the nearest node with a neighbour outside. So one
    search goes inwards from all such nodes at once; a step looks only at the neighbours of the last step's nodes.
    """
    nodes = inner.select("node_id")
    mine = adj.join(nodes.withColumnRenamed("node_id", "node"), "node", "left_semi")
    marked = stage(mine.join(nodes.select(F.col("node_id").alias("nbr"), F.lit(True).alias("in")), "nbr", "left"), "marked")
    front = stage(marked.where(F.col("in").isNull()).select(F.col("node").alias("node_id")).distinct(), "front")
    found = front.withColumn("depth", F.lit(0))
    inside = marked.where(F.col("in")).select("node", "nbr")
    for k in range(1, rounds):
        near = inside.join(small(front.withColumnRenamed("node_id", "nbr")), "nbr", "left_semi").select(F.col("node").alias("node_id")).distinct()
        front = stage(near.join(found, "node_id", "left_anti"), "front")
        if not front.take(1):
            break
        found = found.unionByName(front.withColumn("depth", F.lit(k)))
    return nodes.join(found, "node_id", "left").select("node_id", F.coalesce("depth", F.lit(rounds)).alias("depth"))


def _tree(deep: DataFrame, edges: DataFrame, rounds: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each level k: (node_id, root) of the nodes of depth k or more, and (root, up) of level k's roots to those of level k - 1.

    root is the least node of the component among those nodes. An edge joins components from the level of its shallower end upwards, so
    levels are built from the deepest up, each from the roots of the one below and the edges of its own level alone: every
    edge is looked at once, on a graph that shrinks to the components.
    """
    ends = edges.join(deep.select(F.col("node_id").alias("src"), F.col("depth").alias("a")), "src").join(deep.select(F.col("node_id").alias("dst"), F.col("depth").alias("b")), "dst")
    leveled = stage(ends.select("src", "dst", F.least("a", "b", F.lit(rounds - 1)).alias("level")), "leveled")
    roots, ups, below = [], [], None
    for k in range(rounds - 1, -1, -1):
        pairs = leveled.where(F.col("level") == k).select("src", "dst")
        fresh = deep.where((F.col("depth") >= k) if below is None else (F.col("depth") == k)).select("node_id", F.col("node_id").alias("old"))
        if below is not None:
            for end in ("src", "dst"):
                pairs = pairs.join(below.select(F.col("node_id").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            fresh = fresh.unionByName(below.select("node_id", F.col("root").alias("old")))
        found = stage(connected_components(pairs, finish=FINISH).select(F.col("node").alias("old"), "component"), "components")
        met = small(found)
        now = stage(fresh.join(met, "old", "left").select("node_id", F.coalesce("component", "old").alias("root")), "roots")
        if below is not None:
            olds = below.where("node_id = root").select(F.col("root").alias("old"))  # a root is a node of its component
            ups.insert(0, stage(olds.join(met, "old", "left").select(F.col("old").alias("root"), F.coalesce("component", "old").alias("up")), "ups"))
        roots.insert(0, now)
        below = now
    return roots, ups


def component_lineage(inner: DataFrame, edges: DataFrame, adj: DataFrame, rounds: int = 5, least: int = 5, factor: float = 0, raster: bool = False, strict: bool = True, valid: DataFrame | None = None) -> Lineage:
    """Components of up to so many rounds of peeling, until fewer than two components are left, as one component tree.

    inner: (node_id). edges: canonical, used for components. adj: its neighbours decide the peeling. A
    node's iter_label is the last round that it was in, plus one. For rasters under strict, survivors of
    the last round have 0 and survivors of an early stop max(0, round - 1), as in the established results.
    With valid (node_id), components of the first round without a valid node are no components, and their
    nodes go no further than that round. Components of round k have at least least + factor * k nodes, and
    cid numbers them from 0 by their smallest node.

    Depths come from one search inwards, and the components of all rounds from one tree built over descending depth.
    """
    if rounds < 1:
        raise ValueError("peeling needs at least one round")
    deep = stage(depths(stage(inner.select("node_id").distinct(), "inner"), adj, rounds), "depths")
    roots, ups = _tree(deep, edges, rounds)
    every = roots[0].withColumn("iter", F.lit(0))
    for k, table in enumerate(roots[1:], 1):
        every = every.unionByName(table.withColumn("iter", F.lit(k)))
    sizes = every.groupBy("iter", "root").agg(F.count("*").alias("size"))
    limit = F.lit(int(least)) if not factor else F.floor(F.lit(float(least)) + F.lit(float(factor)) * F.col("iter"))
    large = stage(sizes.where(F.col("size") >= limit), "large")
    if valid is not None:
        hit = roots[0].join(valid.select("node_id"), "node_id", "left_semi").select("root").distinct()
        out = stage(large.where("iter = 0").select("root").join(hit, "root", "left_anti"), "out")
        large, gone = _without(large, out, ups), roots[0].join(small(out), "root", "left_semi").select("node_id")
    counts = dict.fromkeys(range(rounds), 0) | {r["iter"]: r["count"] for r in large.groupBy("iter").count().collect()}
    deepest = deep.agg(F.max("depth")).first()[0]
    # A round runs while nodes are left; the first with fewer than two components is the last and has none.
    few = next((k for k in range(rounds) if counts[k] < 2 and (k == 0 or (deepest or 0) >= k)), None)
    ran = rounds if few is None else few
    label = F.col("depth") + 1
    if few is not None:
        label = F.when(F.col("depth") >= few, F.lit(max(0, few - 1) if raster and strict else few + 1)).otherwise(label)
    else:
        label = F.when(F.col("depth") >= rounds, F.lit(0 if raster and strict else rounds)).otherwise(label)
    levels = deep.select("node_id", label.cast("int").alias("iter_label"))
    if valid is not None and few != 0:
        levels = levels.join(gone.select("node_id", F.lit(1).alias("only")), "node_id", "left").select("node_id", F.coalesce("only", "iter_label").alias("iter_label"))
    if not ran:
        warnings.warn("fewer than two components: no groups", stacklevel=2)
    numbered = dense_index(large.where(F.col("iter") < ran), ["iter", "root"], "at")
    start = numbered.groupBy("iter").agg(F.min("at").alias("start"))  # a row for each round
    comps = stage(numbered.join(F.broadcast(start), "iter").select("iter", "root", (F.col("at") - F.col("start")).alias("cid"), "size"), "comps")
    members = every.where(F.col("iter") < ran).join(small(comps), ["iter", "root"]).select("cid", "node_id", "iter")
    chain = None
    for k, up in enumerate(ups[: max(0, ran - 1)], 1):
        one = up.select(F.lit(k).alias("iter"), "root", "up")
        chain = one if chain is None else chain.unionByName(one)
    if chain is None:
        parents = inner.sparkSession.createDataFrame([], "parent_iter int, parent_cid long, iter int, cid long")
    else:
        above = comps.select((F.col("iter") + 1).alias("iter"), F.col("root").alias("up"), F.col("cid").alias("parent_cid"))
        parents = chain.join(comps.select("iter", "root", "cid"), ["iter", "root"]).join(above, ["iter", "up"]).select((F.col("iter") - 1).alias("parent_iter"), "parent_cid", "iter", "cid")
    return Lineage(stage(members, "members"), stage(parents, "parents"), stage(levels, "levels"), comps.select("iter", "cid", "size"))


def _without(large: DataFrame, out: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """large (iter, root, size) without the first round's roots in out, and without what lies below them."""
    kept = [large.where("iter = 0").join(small(out), "root", "left_anti")]
    for k, up in enumerate(ups, 1):
        out = stage(up.join(out.withColumnRenamed("root", "up"), "up", "left_semi").select("root"), "out")
        kept.append(large.where(F.col("iter") == k).join(small(out), "root", "left_anti"))
    return stage(_union(kept), "large")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def seeds(lineage: Lineage, rounds: int = 64) -> DataFrame:
    """(iter, cid, invalid): the earliest component of each unbranched path up from a leaf.

    A leaf climbs while its parent has no other child; it is invalid if its own parent has. All leaves
    climb together, a join a step, and paths are no longer than the peeling rounds.
    """
    nodes = lineage.comps.select("iter", "cid")
    up = lineage.parents
    only = up.groupBy("parent_iter", "parent_cid").agg(F.count("*").alias("children"))
    step = stage(up.join(only, ["parent_iter", "parent_cid"]), "steps")
    leaves = nodes.join(up.select(F.col("parent_iter").alias("iter"), F.col("parent_cid").alias("cid")), ["iter", "cid"], "left_anti")
    first = leaves.join(step, ["iter", "cid"], "left").select("iter", "cid", (F.coalesce("children", F.lit(0)) > 1).alias("invalid"))
    now = stage(first, "climb")
    for _ in range(rounds):
        moved = now.join(step.where("children = 1"), ["iter", "cid"], "left")
        nxt = stage(moved.select(F.coalesce("parent_iter", "iter").alias("iter"), F.coalesce("parent_cid", "cid").alias("cid"), "invalid", F.col("parent_iter").isNotNull().alias("moved")), "climb")
        go_on = bool(nxt.where("moved").take(1))
        now = nxt.drop("moved")
        if not go_on:
            break
    return now.groupBy("iter", "cid").agg(F.max("invalid").alias("invalid"))
