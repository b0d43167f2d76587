"""Edge tables: canonical pairs, adjacency, pixel and radius graphs, sub-graphs."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.components import FINISH, connected_components
from lacuna.sources.staging import small, stage

#: Neighbours ahead of a pixel in row order: together with their mirror images the 8- and the 4-neighbourhood.
AHEAD_8, AHEAD_4 = ((0, 1), (1, -1), (1, 0), (1, 1)), ((0, 1), (1, 0))


@dataclass(frozen=True)
class Within:
    """The graph of all pairs of points (node_id, x, y, z) closer than r, as a rule instead of a table: radius_edges without its rows."""

    r: float


def canonical_edges(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) with src < dst; loops and null ends are dropped."""
    a, b = F.col(src), F.col(dst)
    return pairs.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr) both ways, of canonical edges."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr")))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(F.count("*").alias("degree"))


def pixel_edges(pixels: DataFrame, ahead=AHEAD_8) -> DataFrame:
    """Canonical edges of neighbouring pixels of the table (node_id, iy, ix); an equi-join on the shifted place."""
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ahead])
    moved = pixels.select(F.col("node_id").alias("a"), "iy", "ix", F.explode(shifts).alias("s")).select("a", (F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"))
    return canonical_edges(moved.join(pixels.select(F.col("node_id").alias("b"), "iy", "ix"), ["iy", "ix"]), "a", "b")


def grid_edges(spark: SparkSession, height: int, width: int, ahead=AHEAD_8) -> DataFrame:
    """Edges of all pixels of a raster, made from their numbers without a join."""
    n = F.col("id")
    iy, ix = F.floor(n / width), F.pmod(n, F.lit(width))
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ahead])
    at = spark.range(height * width).select(n.alias("src"), iy.alias("iy"), ix.alias("ix"), F.explode(shifts).alias("s"))
    ny, nx = F.col("iy") + F.col("s.dy"), F.col("ix") + F.col("s.dx")
    return at.where((ny < height) & (nx >= 0) & (nx < width)).select("src", (ny * width + nx).alias("dst"))


#: Points of a grid cell that one task compares with a neighbour cell's; a fuller cell is split.
CELL_POINTS = 20_000


def radius_edges(points: DataFrame, r: float, axes: tuple[str, ...] = ("x", "y", "z"), cell_points: int = CELL_POINTS) -> DataFrame:
    """Pairs closer than r: equi-join on grid cells of size r, one side dealt to its own cell and the cells ahead, then the exact distance.

    Half of the neighbour cells suffice, as a pair of two cells meets in the one that is ahead of the other. A cell of over
    cell_points points is dealt in parts by node, and what is compared with it goes to each part, so a dense cell is no single key.
    """
    cells = [F.floor(F.col(a) / r).alias(f"c{a}") for a in axes]
    home = points.select(F.col("node_id").alias("dst"), *[F.col(a).alias(f"b{a}") for a in axes], *cells)
    ahead = [ds for ds in product((-1, 0, 1), repeat=len(axes)) if ds >= (0,) * len(axes)]
    around = F.array(*[F.struct(F.lit(not any(ds)).alias("own"), *[F.lit(d).alias(f"d{a}") for a, d in zip(axes, ds, strict=True)]) for ds in ahead])
    dealt = points.select(F.col("node_id").alias("src"), *axes, F.explode(around).alias("d"), *cells)
    dealt = dealt.select("src", *axes, F.col("d.own").alias("own"), *[(F.col(f"c{a}") + F.col(f"d.d{a}")).alias(f"c{a}") for a in axes])
    keys = [f"c{a}" for a in axes]
    full = stage(home.groupBy(*keys).count().where(F.col("count") > cell_points).select(*keys, F.ceil(F.col("count") / cell_points).cast("int").alias("parts")), "full_cells")
    if full.take(1):
        held = small(full)
        home = home.join(held, keys, "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        dealt = dealt.join(held, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        keys.append("part")
    d2 = sum(((F.col(a) - F.col(f"b{a}")) * (F.col(a) - F.col(f"b{a}")) for a in axes), F.lit(0.0))
    return dealt.join(home, keys).where((~F.col("own") | (F.col("src") < F.col("dst"))) & (d2 < r * r)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def short_edges(edges: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Edges whose ends are closer than the threshold; edges to absent points fall away."""
    a = points.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = points.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    return edges.join(a, "src").join(b, "dst").where(d2 < threshold**2).select("src", "dst")


def by_ids(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of external ids (a, b) as node ids (src, dst); pairs with an absent id fall away."""
    one = nodes.select(F.col("id").alias("a"), F.col("node_id").alias("src"))
    two = nodes.select(F.col("id").alias("b"), F.col("node_id").alias("dst"))
    return pairs.join(one, "a").join(two, "b").select("src", "dst")


def merged_chunk_edges(pairs: DataFrame, nodes: DataFrame, threshold: float, overlap: DataFrame) -> DataFrame:
    """(src, dst) of all chunks' pairs of external ids (a, b): looked up, shorter than the threshold, and once where chunks overlap.

    nodes: (id, node_id, x, y, z). overlap: (node_id) of the zone that several chunks hold. An edge of which
    an end is there may come from several chunks and is made distinct; the others are in one chunk and are passed on unshuffled.
    """
    short = short_edges(by_ids(pairs, nodes), nodes, threshold)
    zone = overlap.select(F.col("node_id").alias("_node")).distinct().withColumn("_in", F.lit(True))
    marked = short.join(zone.withColumnsRenamed({"_node": "src", "_in": "_a"}), "src", "left").join(zone.withColumnsRenamed({"_node": "dst", "_in": "_b"}), "dst", "left")
    shared = F.coalesce("_a", "_b", F.lit(False))
    return marked.where(~shared).select("src", "dst").unionByName(canonical_edges(marked.where(shared).select("src", "dst")))


def in_chunks(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk, node_id) of the nodes (id, node_id) that chunks hold by external id (chunk, id); a chunk that repeats an id holds it once."""
    return held.select("chunk", "id").distinct().join(nodes.select("id", "node_id"), "id").select("chunk", "node_id")


def chunk_edges(edges: DataFrame, held: DataFrame) -> DataFrame:
    """(chunk, src, dst): the edges with both ends in a chunk (chunk, node_id), for each such chunk."""
    a = held.select("chunk", F.col("node_id").alias("src"))
    b = held.select("chunk", F.col("node_id").alias("dst"))
    return edges.join(a, "src").join(b, ["chunk", "dst"], "left_semi").select("chunk", "src", "dst")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (node_id)."""
    keep = nodes.select("node_id")
    return edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) for all of nodes: the least node id of the component, their own where they have no edge."""
    found = connected_components(induced(edges, nodes), finish=FINISH).select(F.col("node").alias("node_id"), "component")
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def mode_neighbour(adj: DataFrame, assigned: DataFrame) -> DataFrame:
    """(node, group, count, groups, total): the most frequent group among a node's neighbours, the smallest of ties.

    assigned: (node_id, group_id) without nulls. Two map-side combined aggregates, so hot nodes are summed where they lie.
    """
    met = adj.join(assigned.select(F.col("node_id").alias("nbr"), "group_id"), "nbr").groupBy("node", "group_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("group_id")).alias("g")))
    return met.groupBy("node").agg(best.alias("b"), F.count("*").alias("groups"), F.sum("n").alias("total")).select("node", (-F.col("b.g")).alias("group"), F.col("b.n").alias("count"), "groups", "total")
