"""Regrowth of seed components into groups, in synchronous waves from the deepest level up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.graph import adjacency, mode_neighbour
from lacuna.operators.indexing import dense_index
from lacuna.operators.lineage import Lineage
from lacuna.sources.staging import discard, stage

#: Waves after which the written additions are put together.
COMPACT = 8


def seed_groups(lineage: Lineage, chosen: DataFrame) -> DataFrame:
    """(group_id, iter, cid, invalid): seeds numbered from 0 by round and component."""
    return dense_index(chosen, ["iter", "cid"], "group_id")


def wave(adj: DataFrame, unassigned: DataFrame, assigned: DataFrame, single_connect: int = 1, connect: int = 1) -> DataFrame:
    """(node_id, group_id) of the unassigned nodes that join a group now: that of most of their assigned neighbours.

    A node with neighbours of one group needs single_connect of them, one between groups connect of the
    most frequent; the smallest group id wins ties.
    """
    near = adj.join(unassigned.select(F.col("node_id").alias("node")), "node", "left_semi")
    best = mode_neighbour(near, assigned)
    joins = (F.col("total") >= single_connect) & (((F.col("groups") == 1) & (F.col("count") >= single_connect)) | (F.col("count") >= connect))
    return best.where(joins).select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))


def grow(lineage: Lineage, groups: DataFrame, inner_edges: DataFrame, single_connect: int = 1, connect: int = 1) -> DataFrame:
    """(node_id, group_id): seeds grown over inner edges. At each level only groups seeded there or deeper take in nodes.

    A wave writes only the nodes that it adds, and after a level's first wave only their neighbours are
    looked at: for all others nothing has changed. Every COMPACT waves what was added is put together.
    """
    groups = stage(groups, "groups")
    adj = stage(adjacency(inner_edges), "adjacency")
    base = stage(lineage.members.join(groups, ["iter", "cid"]).groupBy("node_id").agg(F.max("group_id").alias("group_id")), "assigned")
    added: list[DataFrame] = []
    deepest = groups.agg(F.max("iter")).first()[0]
    for level in range(-1 if deepest is None else deepest, -1, -1):
        taking = groups.where(F.col("iter") >= level).select("group_id")
        front = None
        while True:
            assigned = _together([base, *added])
            left = lineage.levels.where(F.col("iter_label") >= level + 1).join(assigned, "node_id", "left_anti")
            if front is not None:
                near = adj.join(front.select(F.col("node_id").alias("nbr")), "nbr", "left_semi").select(F.col("node").alias("node_id"))
                left = left.join(near, "node_id", "left_semi")
            front = stage(wave(adj, left, assigned.join(taking, "group_id", "left_semi"), single_connect, connect), "added")
            if not front.take(1):
                discard(front)
                break
            if len(added) == COMPACT:
                old, base = [base, *added], stage(assigned, "assigned")
                added = []
                for table in old:
                    discard(table)
            added.append(front)
    return _together([base, *added])


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
