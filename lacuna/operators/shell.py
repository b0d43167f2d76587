"""Shells: denser cells around each group, attached in synchronous rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.staging import stage


def directed_edges(edges: DataFrame, nodes: DataFrame, order: str = "density") -> DataFrame:
    """(node, nbr) from the denser end to the less dense one of canonical edges (src < dst); ties go from src to dst.

    With density_temperature the denser end must not be hotter either, and pairs that fit neither way are dropped.
    """
    if order not in ("density", "density_temperature"):
        raise ValueError(f"unknown order {order!r}")
    cols = ["density"] + ["temperature"] * (order != "density")
    a = nodes.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = nodes.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = edges.join(a, "src").join(b, "dst")
    forward, backward = F.col("a_density") >= F.col("b_density"), F.col("b_density") >= F.col("a_density")
    if order != "density":
        forward, backward = forward & (F.col("a_temperature") <= F.col("b_temperature")), backward & (F.col("b_temperature") <= F.col("a_temperature"))
    ends = F.when(forward, F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"))).when(backward, F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    return both.select(ends.alias("e")).where("e IS NOT NULL").select("e.node", "e.nbr")


def walk_reach(start: DataFrame, adj: DataFrame, steps: int) -> DataFrame:
    """(node_id) that a walk of exactly so many steps from start reaches; each step replaces the set."""
    now = start.select("node_id")
    for _ in range(steps):
        now = stage(adj.join(now.withColumnRenamed("node_id", "node"), "node", "left_semi").select(F.col("nbr").alias("node_id")).distinct(), "reach")
    return now


def shell_round(candidates: DataFrame, directed: DataFrame, assigned: DataFrame, inner: DataFrame, inner_connect: int = 1, connect: int = 2) -> DataFrame:
    """(node_id, group_id) of the candidates that join a group in this round.

    Of a node's less dense neighbours the most frequent group is taken, the smallest of ties. It needs
    inner_connect of them if any neighbour is in inner, else connect.
    """
    mine = directed.join(candidates.select(F.col("node_id").alias("node")), "node", "left_semi")
    state = mine.join(assigned.select(F.col("node_id").alias("nbr"), "group_id"), "nbr", "left").join(inner.select(F.col("node_id").alias("nbr"), F.lit(1).alias("in")), "nbr", "left")
    per = state.groupBy("node", "group_id").agg(F.count("*").alias("n"), F.max(F.coalesce("in", F.lit(0))).alias("in"))
    best = F.max(F.when(F.col("group_id").isNotNull(), F.struct(F.col("n"), (-F.col("group_id")).alias("g"))))
    top = per.groupBy("node").agg(best.alias("b"), F.max("in").alias("in"), F.sum("n").alias("neighbours"))
    enough = (F.col("neighbours") >= inner_connect) & (F.col("b.n") >= F.when(F.col("in") == 1, inner_connect).otherwise(connect))
    return top.where(enough).select(F.col("node").alias("node_id"), (-F.col("b.g")).alias("group_id"))


def assign_shells(candidates: DataFrame, directed: DataFrame, assigned: DataFrame, inner_connect: int = 1, connect: int = 2, max_rounds: int = 3) -> DataFrame:
    """assigned with the shells: up to max_rounds rounds, each on the state that the last one left."""
    inner = assigned.select("node_id")
    left = stage(candidates.select("node_id").join(inner, "node_id", "left_anti"), "candidates")
    directed = stage(directed, "directed")
    for _ in range(max_rounds):
        new = stage(shell_round(left, directed, assigned, inner, inner_connect, connect), "shell")
        if not new.take(1):
            break
        assigned = stage(assigned.unionByName(new), "assigned")
        left = stage(left.join(new, "node_id", "left_anti"), "candidates")
    return assigned
