"""Merging of groups that touch each other along much of their border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.staging import discard, small, stage

MAX_ROUNDS = 30


def contact_nodes(assigned: DataFrame, adj: DataFrame) -> DataFrame:
    """(group_id, node_id, other): each group's distinct outside neighbours, and the group that they are in (null: none)."""
    mine = adj.join(assigned.select(F.col("node_id").alias("node"), "group_id"), "node").select("group_id", F.col("nbr").alias("node_id")).distinct()
    return _outside(mine.join(assigned.withColumnRenamed("group_id", "other"), "node_id", "left")).select("group_id", "node_id", "other")


def _outside(touch: DataFrame) -> DataFrame:
    return touch.where(F.col("other").isNull() | (F.col("other") != F.col("group_id")))


def _counted(touch: DataFrame) -> DataFrame:
    return touch.groupBy("group_id", "other").agg(F.count("*").alias("n"))


def contacts(assigned: DataFrame, adj: DataFrame) -> DataFrame:
    """(group_id, other, n): number of distinct outside neighbours of each group by the group they are in (null: none)."""
    return _counted(contact_nodes(assigned, adj))


def group_sizes(assigned: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(group_id, size, edge): nodes of each group, and those of them in boundary (node_id)."""
    edge = F.lit(0)
    if boundary is not None:
        assigned = assigned.join(boundary.select("node_id").distinct().withColumn("at_edge", F.lit(1)), "node_id", "left")
        edge = F.count("at_edge")
    return assigned.groupBy("group_id").agg(F.count("*").alias("size"), edge.cast("long").alias("edge"))


def decisions(assigned: DataFrame, adj: DataFrame, boundary: DataFrame | None = None, threshold: float = 0.2, max_size: int = 1_000_000, invalid: DataFrame | None = None) -> DataFrame:
    """(group_id, size, neighbours, touching, target): what each group would merge into.

    target is null where the group touches none or is over max_size (it is skipped from then on), the
    group itself where it stays, else the group it touches most (the smallest id of ties): if the share
    of grouped neighbours, with the group's own boundary nodes added, reaches the threshold, or if the
    group is in invalid.
    """
    return _decided(group_sizes(assigned, boundary), contacts(assigned, adj), threshold, max_size, invalid)


def _decided(sizes: DataFrame, counted: DataFrame, threshold: float, max_size: int, invalid: DataFrame | None) -> DataFrame:
    """decisions() from the groups' sizes and their counted contacts."""
    other = F.col("other")
    best = F.max(F.when(other.isNotNull(), F.struct(F.col("n"), (-other).alias("g"))))
    near = counted.groupBy("group_id").agg(F.sum("n").alias("neighbours"), F.sum(F.when(other.isNotNull(), F.col("n")).otherwise(0)).alias("touching"), best.alias("best"))
    out = sizes.join(near, "group_id", "left").select("group_id", "size", "edge", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("touching", F.lit(0)).alias("touching"), (-F.col("best.g")).alias("top"))
    bad = F.lit(False)
    if invalid is not None:
        out = out.join(invalid.select("group_id", F.lit(True).alias("bad")).distinct(), "group_id", "left")
        bad = F.coalesce(F.col("bad"), F.lit(False))
    share = F.try_divide(F.col("touching") + F.col("edge"), F.col("neighbours"))
    target = F.when((F.col("touching") > 0) & (F.col("size") <= max_size), F.when((share >= threshold) | bad, F.col("top")).otherwise(F.col("group_id")))
    return out.select("group_id", "size", "neighbours", "touching", target.alias("target"))


def fold(decided: DataFrame) -> DataFrame:
    """(group_id, final) of the groups that move, when decisions apply one after another by ascending size and id.

    A's nodes go to its target B, and on to B's target if B moves later than A; a target that has moved
    before is filled again. So a group follows moves of ascending order; the chains are followed by
    pointer doubling, not one by one.
    """
    moves = decided.where("target IS NOT NULL AND target <> group_id").select("group_id", "target", F.struct("size", "group_id").alias("turn"))
    moves = stage(moves, "moves")
    later = moves.select(F.col("group_id").alias("target"), F.col("turn").alias("next_turn"))
    hops = moves.join(later, "target", "left").select("group_id", F.col("target").alias("final"), F.coalesce(F.col("next_turn") > F.col("turn"), F.lit(False)).alias("on"))
    hops = stage(hops, "hops")
    while hops.where("on").take(1):
        ahead = hops.select(F.col("group_id").alias("final"), F.col("final").alias("farther"), F.col("on").alias("still"))
        both = hops.join(ahead, "final", "left")
        hops = stage(both.select("group_id", F.when(F.col("on"), F.col("farther")).otherwise(F.col("final")).alias("final"), F.when(F.col("on"), F.col("still")).otherwise(False).alias("on")), "hops")
    return hops.select("group_id", "final")


def relabel(assigned: DataFrame, moved: DataFrame) -> DataFrame:
    return assigned.join(moved, "group_id", "left").select("node_id", F.coalesce("final", "group_id").alias("group_id"))


def merge_groups(assigned: DataFrame, adj: DataFrame, isolated: DataFrame, boundary: DataFrame | None = None, threshold: float = 0.2, max_size: int = 1_000_000, invalid: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """assigned after rounds of merging, until the number of groups no longer falls.

    isolated: (group_id) that never merge away, but may be merged into; groups that are skipped in one
    round join them. The adjacency is joined once, into a table of contacts (group, outside node, its group). A round
    contracts that table and the sizes by its moves, and the nodes get their final groups at the end.
    """
    touch = stage(contact_nodes(assigned, adj), "contacts")
    sizes = stage(group_sizes(assigned, boundary), "sizes")
    names = sizes.select("group_id", F.col("group_id").alias("final"))
    skip, before = isolated.select("group_id"), sizes.count()
    for _ in range(max_rounds):
        decided = stage(_decided(sizes, _counted(touch), threshold, max_size, invalid), "decisions")
        open_ones = decided.join(skip, "group_id", "left_anti")
        moved = stage(fold(open_ones), "moved")
        if not moved.take(1):
            break
        to = small(moved.select(F.col("group_id").alias("was"), "final"))
        skip = stage(skip.unionByName(open_ones.where("target IS NULL").select("group_id")).distinct(), "skip")
        names = stage(names.join(to.withColumnRenamed("final", "then"), F.col("final") == F.col("was"), "left").select("group_id", F.coalesce("then", "final").alias("final")), "names")
        now = touch.join(to, F.col("group_id") == F.col("was"), "left").select(F.coalesce("final", "group_id").alias("group_id"), "node_id", "other")
        now = now.join(to, F.col("other") == F.col("was"), "left").select("group_id", "node_id", F.coalesce("final", "other").alias("other"))
        old, touch = touch, stage(_outside(now).distinct(), "contacts")
        discard(old)
        sizes = stage(sizes.join(to, F.col("group_id") == F.col("was"), "left").groupBy(F.coalesce("final", "group_id").alias("group_id")).agg(F.sum("size").alias("size"), F.sum("edge").alias("edge")), "sizes")
        after = sizes.count()
        if after >= before:
            break
        before = after
    return relabel(assigned, small(names.where("group_id <> final")) if names.take(1) else names)
