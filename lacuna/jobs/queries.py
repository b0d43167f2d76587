"""Registered queries: each applies one operator to a view of the given tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import masks as M
from lacuna.functions.relabel import display_labels
from lacuna.jobs.config import ImageConfig, InnerConfig, ShellConfig, SnapshotConfig
from lacuna.jobs.extract import classify_chunks, classify_points, classify_raster, extract_points, extract_raster
from lacuna.operators import gnn, graph, grow, lineage, merge, profile, raster, shell
from lacuna.sources import snapshot as S
from lacuna.sources import views as V
from lacuna.sources.fits import read_fits, write_fits
from lacuna.sources.staging import stage, stage_path

#: Radius of the point graph.
RADIUS = 0.1


def _inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event grid with its quiet cells as inner."""
    return V.quiet(V.events_grid(spark, sf_dir))


def _grid_adj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.pixel_edges(V.events_grid(spark, sf_dir)))


def _days(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the event raster."""
    return (V.events_grid(spark, sf_dir).agg(F.max("iy")).first()[0] or 0) + 1


def _calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order raster with its calm blocks as inner."""
    return V.calm(V.orders_grid(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, group_id): the quiet cells by weekday, a fixed grouping for single steps."""
    return _inner(spark, sf_dir).where("inner").select("node_id", F.pmod("iy", F.lit(7)).alias("group_id"))


def slice_mask(spark, sf_dir):
    return V.particles(spark, sf_dir).where(M.in_slice(F.col("z"), 0.0, 0.05)).select("node_id", "z")


def range_mask(spark, sf_dir):
    return V.particles(spark, sf_dir).where(M.in_range(F.col("x"), -0.1, 0.1)).select("node_id", "x")


def line_mask(spark, sf_dir):
    return V.particles(spark, sf_dir).where(M.on_line({"x": 0.0, "z": 0.0}, 0.08)).select("node_id", "x", "z")


def cylinder_filter(spark, sf_dir):
    return V.particles(spark, sf_dir).where(M.in_cylinder(F.col("x"), F.col("y"), F.col("z"), 0.05, 0.2, 0.1)).select("node_id", "x", "y", "z")


def cylinder_boundary(spark, sf_dir):
    r = M.radius(F.col("x"), F.col("y"))
    return V.particles(spark, sf_dir).select("node_id", M.cylinder_boundary(r, F.col("z"), (0.02, 0.25), (-0.2, 0.2), 0.02).alias("is_boundary"))


def box_boundary(spark, sf_dir):
    limits = [(F.col(c), (-0.2, 0.2)) for c in "xyz"]
    return V.particles(spark, sf_dir).select("node_id", M.box_boundary(limits, 0.02).alias("is_boundary"))


def polar_coordinates(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return V.particles(spark, sf_dir).select("node_id", F.round(M.radius(x, y), 6).alias("r"), F.round(M.azimuth(x, y), 6).alias("phi"), F.round(M.azimuth_mod(M.azimuth(x, y)), 6).alias("phi_mod"))


def azimuth_chunks(spark, sf_dir):
    return M.with_chunks(V.particles(spark, sf_dir), 8, 0.05).select("node_id", F.col("chunk").cast("long").alias("chunk"), "own")


def overlap_zone(spark, sf_dir):
    phi = M.azimuth(F.col("x"), F.col("y"))
    return V.particles(spark, sf_dir).where(M.near_chunk_edge(phi, 32, 0.01)).select("node_id")


def display_projection(spark, sf_dir):
    return V.particles(spark, sf_dir).select("node_id", F.round(F.log10("density"), 6).alias("log_density"), F.round(F.asinh(F.col("temperature")), 6).alias("asinh_temperature"))


def region_class(spark, sf_dir):
    cells = _inner(spark, sf_dir)
    group = F.when(F.pmod("ix", F.lit(3)) == 0, F.col("iy"))
    return cells.select("node_id", M.region_class(F.col("inner"), group).cast("long").alias("region"))


def pixel_clean(spark, sf_dir):
    v = F.when(F.pmod("node_id", F.lit(5)) == 0, F.lit(float("nan"))).when(F.pmod("node_id", F.lit(5)) == 1, -F.col("v")).otherwise(F.col("v"))
    return V.events_grid(spark, sf_dir).select("node_id", M.clean(v).alias("v"))


def valid_pixels(spark, sf_dir):
    return raster.valid(V.pixels(spark, sf_dir)).select("node_id", "iy", "ix")


def pixel_edges_valid(spark, sf_dir):
    return graph.pixel_edges(V.pixels(spark, sf_dir))


def pixel_edges_all(spark, sf_dir):
    size = V.events_grid(spark, sf_dir).agg(F.max("iy") + 1, F.max("ix") + 1).first()
    return graph.grid_edges(spark, size[0], size[1])


def radius_edges(spark, sf_dir):
    return graph.radius_edges(V.particles(spark, sf_dir), RADIUS)


def edge_length_filter(spark, sf_dir):
    points = V.particles(spark, sf_dir)
    ring = points.select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    return graph.short_edges(ring, points, 0.25)


def edge_canonical(spark, sf_dir):
    return graph.canonical_edges(V.part_supplier(spark, sf_dir))


def adjacency(spark, sf_dir):
    return _grid_adj(spark, sf_dir)


def degree(spark, sf_dir):
    return graph.degree(graph.adjacency(graph.canonical_edges(V.part_supplier(spark, sf_dir))))


def id_lookup(spark, sf_dir):
    nodes = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") * 10 + 1).alias("id"))
    pairs = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10 + 1).alias("a"), (F.col("l_suppkey") * 10 + 1).alias("b"))
    return graph.by_ids(pairs, nodes).groupBy("src", "dst").agg(F.count("*").alias("n"))


def chunk_membership(spark, sf_dir):
    late = V.table(spark, sf_dir, "lineitem").where("l_shipdate >= '1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.table(spark, sf_dir, "orders").join(late, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def chunk_last_wins(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.struct("l_orderkey", "l_linenumber").alias("chunk"), F.col("l_quantity").alias("score"))
    return gnn.last_chunk_wins(rows)


def induced_edges(spark, sf_dir):
    cells = _inner(spark, sf_dir)
    return graph.induced(graph.pixel_edges(cells), cells.where("inner"))


def rz_profile(spark, sf_dir):
    points = V.particles(spark, sf_dir)
    got = profile.profile(points, "density", profile.bin_edges(points, 0.05, 0.05))
    return got.select("r_bin", "z_bin", F.round("mass", 6).alias("mass"), F.round("mean", 6).alias("mean"))


def profile_normalised(spark, sf_dir):
    points = V.particles(spark, sf_dir)
    edges = profile.bin_edges(points, 0.05, 0.05)
    got = profile.corrected(points, "temperature", edges, profile.profile(points, "temperature", edges))
    return got.select("node_id", (F.round("log_ratio", 6) + 0.0).alias("log_ratio"))


def scaled_features(spark, sf_dir):
    got = profile.features(V.particles(spark, sf_dir), ["density", "temperature"], True, 0.05, 0.05)
    return got.select("node_id", (F.round("f0", 6) + 0.0).alias("f0"), (F.round("f1", 6) + 0.0).alias("f1"))


def robust_scale(spark, sf_dir):
    points = V.particles(spark, sf_dir).withColumn("q", F.ln("density"))
    return profile.robust_apply(points, "q", profile.robust_fit(points, "q"), "scaled").select("node_id", (F.round("scaled", 6) + 0.0).alias("scaled"))


def robust_scale_by_group(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    got = profile.robust_apply(rows, "l_quantity", profile.robust_fit(rows, "l_quantity", ["l_returnflag"]), "scaled", ["l_returnflag"])
    return got.select("l_orderkey", "l_linenumber", (F.round("scaled", 6) + 0.0).alias("scaled"))


def scaler_reuse(spark, sf_dir):
    """Fitted on the density of the particles, applied to the same particles once they are denser, as in a later snapshot."""
    points = V.particles(spark, sf_dir)
    fitted = profile.robust_fit(points.withColumn("q", F.ln("density")), "q")
    later = points.withColumn("q", F.ln(F.col("density") * F.col("temperature")))
    return profile.robust_apply(later, "q", fitted, "scaled").select("node_id", (F.round("scaled", 6) + 0.0).alias("scaled"))


def saved_features(spark, sf_dir):
    """Profile and scaler saved from the particles, applied to the same particles once they are denser."""
    path = stage_path(spark, "features")
    points = V.particles(spark, sf_dir)
    profile.fit_features(points, ["density"], path, 0.05, 0.05)
    later = points.withColumn("density", F.col("density") * F.col("temperature"))
    return profile.saved_features(later, ["density"], path).select("node_id", (F.round("f0", 6) + 0.0).alias("f0"))


def phase_space_hist(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem")
    return profile.histogram_2d(rows, F.col("l_quantity"), F.col("l_discount"), (0.0, 50.0), (-0.005, 0.105), 11)


def component_ids(spark, sf_dir):
    cells = _inner(spark, sf_dir)
    edges = stage(graph.pixel_edges(cells), "edges")
    return lineage.numbered_components(cells.where("inner"), graph.induced(edges, cells.where("inner")), 2)


def component_medians(spark, sf_dir):
    cells = stage(_inner(spark, sf_dir).where("inner"), "cells")
    found = graph.components(cells, graph.pixel_edges(cells))
    both = stage(found.join(cells, "node_id"), "components")
    medians = profile.group_medians(both, "v", ["component"]).withColumnRenamed("median", "median_v")
    return both.groupBy("component").agg(F.count("*").alias("n")).join(medians, "component")


def component_sizes(spark, sf_dir):
    """4-connected components of the cells of the shipping raster that are a deviation or more under the mean."""
    cells = stage(V.quiet(V.pixels(spark, sf_dir), 1.0).where("inner"), "cells")
    return raster.label(cells).groupBy("component").agg(F.count("*").alias("n"))


def peel_once(spark, sf_dir):
    cells = stage(_calm(spark, sf_dir), "cells")
    return lineage.peel(cells.where("inner"), graph.adjacency(graph.pixel_edges(cells)))


def _lineage(spark, sf_dir) -> lineage.Lineage:
    cells = stage(_calm(spark, sf_dir), "cells")
    edges = stage(graph.pixel_edges(cells, graph.AHEAD_4), "edges")
    return lineage.component_lineage(cells.where("inner"), edges, graph.adjacency(edges), rounds=3, least=1)


def valid_components(spark, sf_dir):
    """The first round's components with a valid cell: one within three percent of the largest price."""
    cells = stage(_calm(spark, sf_dir), "cells")
    edges = stage(graph.pixel_edges(cells, graph.AHEAD_4), "edges")
    level = cells.agg((F.max("v") * 0.97).alias("level"))
    valid = cells.crossJoin(F.broadcast(level)).where("v > level")
    return lineage.component_lineage(cells.where("inner"), edges, graph.adjacency(edges), rounds=1, least=1, valid=valid).members.select("cid", "node_id")


def peel_levels(spark, sf_dir):
    return _lineage(spark, sf_dir).levels.select("node_id", F.col("iter_label").cast("long").alias("iter_label"))


def lineage_edges(spark, sf_dir):
    return _lineage(spark, sf_dir).parents.select(*[F.col(c).cast("long").alias(c) for c in ("parent_iter", "parent_cid", "iter", "cid")])


def lineage_seeds(spark, sf_dir):
    return lineage.seeds(_lineage(spark, sf_dir)).select(F.col("iter").cast("long").alias("iter"), "cid", "invalid")


def mode_neighbour(spark, sf_dir):
    got = graph.mode_neighbour(_grid_adj(spark, sf_dir), _halves(spark, sf_dir))
    return got.select("node", F.col("group").alias("mode_group"), F.col("count").alias("n"), "groups", "total")


def mode_supplier_nation(spark, sf_dir):
    """For each part, the nation that most of its suppliers are of: the same operator on a graph that grows with the line items."""
    adj = graph.adjacency(graph.canonical_edges(V.part_supplier(spark, sf_dir)))
    nations = V.table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("node_id"), F.col("s_nationkey").cast("long").alias("group_id"))
    got = graph.mode_neighbour(adj, nations)
    return got.select("node", F.col("group").alias("mode_group"), F.col("count").alias("n"), "groups", "total")


def grow_wave(spark, sf_dir):
    cells = stage(_inner(spark, sf_dir), "cells")
    adj = graph.adjacency(graph.pixel_edges(cells))
    return grow.wave(adj, cells.where("NOT inner"), _halves(spark, sf_dir), 2, 3)


def merge_contacts(spark, sf_dir):
    return merge.contacts(_halves(spark, sf_dir), _grid_adj(spark, sf_dir))


def merge_decisions(spark, sf_dir):
    edge = V.events_grid(spark, sf_dir).where("ix IN (0, 23)")
    return merge.decisions(_halves(spark, sf_dir), _grid_adj(spark, sf_dir), edge, 0.3)


def merge_all(spark, sf_dir):
    """Blocks of quiet cells merged until nothing falls any more; the first block never merges away."""
    blocks = _inner(spark, sf_dir).where("inner").select("node_id", (F.floor(F.col("iy") / 4) * 4 + F.floor(F.col("ix") / 6)).alias("group_id"))
    edge = V.events_grid(spark, sf_dir).where("ix IN (0, 23)")
    first = spark.range(1).select(F.col("id").alias("group_id"))
    return merge.merge_groups(stage(blocks, "blocks"), stage(_grid_adj(spark, sf_dir), "adjacency"), first, edge, 0.2)


def group_stats(spark, sf_dir):
    cells = _inner(spark, sf_dir)
    edge = F.sum(F.when(F.col("ix").isin(0, 23), 1).otherwise(0))
    both = stage(cells.join(_halves(spark, sf_dir), "node_id"), "groups")
    medians = profile.group_medians(both, "v", ["group_id"]).withColumnRenamed("median", "median_v")
    return both.groupBy("group_id").agg(F.count("*").alias("size"), edge.alias("boundary")).join(medians, "group_id")


def directed_edges(spark, sf_dir):
    cells = stage(V.events_grid(spark, sf_dir).withColumnRenamed("v", "density"), "cells")
    return shell.directed_edges(graph.pixel_edges(cells), cells)


def directed_edges_density_temperature(spark, sf_dir):
    points = stage(V.particles(spark, sf_dir), "points")
    return shell.directed_edges(graph.radius_edges(points, RADIUS), points, "density_temperature")


def shell_reach(spark, sf_dir):
    return shell.walk_reach(_halves(spark, sf_dir).where("group_id = 0"), stage(_grid_adj(spark, sf_dir), "adjacency"), 3)


def shell_round(spark, sf_dir):
    cells = stage(_inner(spark, sf_dir).withColumnRenamed("v", "density"), "cells")
    groups = stage(_halves(spark, sf_dir), "groups")
    directed = shell.directed_edges(graph.pixel_edges(cells), cells)
    return shell.shell_round(cells.where("NOT inner"), directed, groups, groups.select("node_id"))


def erosion(spark, sf_dir):
    cells = stage(_calm(spark, sf_dir), "cells")
    height = cells.agg(F.max("iy")).first()[0] or 0
    return raster.erode(cells.where("inner").select("node_id", "iy", "ix"), height + 1, V.ORDER_COLUMNS)


def dilation(spark, sf_dir):
    return raster.dilate(_inner(spark, sf_dir).where("inner"), _days(spark, sf_dir), V.HOURS, 2)


def _grid_flags(spark, sf_dir) -> DataFrame:
    grid = raster.full_grid(V.events_grid(spark, sf_dir), _days(spark, sf_dir), V.HOURS)
    return stage(V.quiet(grid, 0.0), "flags")


def small_holes(spark, sf_dir):
    return raster.fill_small_holes(_grid_flags(spark, sf_dir), area=4).select("node_id", "inner")


def fill_holes(spark, sf_dir):
    return raster.fill_holes(_grid_flags(spark, sf_dir), _days(spark, sf_dir), V.HOURS).select("node_id", "inner")


def gaussian_norm(spark, sf_dir):
    days = _days(spark, sf_dir)
    grid = raster.full_grid(V.events_grid(spark, sf_dir), days, V.HOURS)
    return raster.normalized(grid, [1], (days, V.HOURS)).select("node_id", F.round("v", 6).alias("v"))


def _weeks(spark, sf_dir) -> tuple[DataFrame, tuple[int, int]]:
    """The full raster of shipping weeks and part columns, and its size."""
    size = (V.pixels(spark, sf_dir).agg(F.max("iy")).first()[0] or 0) + 1, V.PART_COLUMNS
    return raster.full_grid(V.pixels(spark, sf_dir), *size), size


def gaussian_norm_shipping(spark, sf_dir):
    """The shipping raster over itself smoothed at two scales, a row for each."""
    grid, size = _weeks(spark, sf_dir)
    return raster.normalized(grid, [1, 2], size).select("node_id", F.col("sigma").cast("long").alias("sigma"), F.round("v", 6).alias("v"))


def multiscale_mean_shipping(spark, sf_dir):
    grid, size = _weeks(spark, sf_dir)
    return raster.composed(grid, [1, 2], size).select("node_id", F.round("v", 6).alias("v"))


def multiscale_mean(spark, sf_dir):
    days = _days(spark, sf_dir)
    grid = raster.full_grid(V.events_grid(spark, sf_dir), days, V.HOURS)
    return raster.composed(grid, [1, 2], (days, V.HOURS)).select("node_id", F.round("v", 6).alias("v"))


def max_over_scales(spark, sf_dir):
    scores = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_extendedprice").alias("score"))
    return gnn.best_over_scales(scores)


def align_moments(spark, sf_dir):
    got = raster.moments(_inner(spark, sf_dir).where("inner"))
    return got.select(*[F.round(c, 6).alias(c) for c in ("syy", "sxx", "sxy")])


def nonzero_bbox(spark, sf_dir):
    return raster.nonzero_box(V.quiet(V.pixels(spark, sf_dir), -2.0).where("NOT inner"))


def aligned_raster(spark, sf_dir):
    """The busy cells of the event grid, turned to an axis."""
    lit = V.quiet(V.events_grid(spark, sf_dir), 0.0).where("NOT inner").drop("inner")
    out, _, _ = raster.align(lit, _days(spark, sf_dir), V.HOURS)
    return out.select("iy", "ix", F.round("v", 4).alias("v"))


#: Small integer weights, so that SQL can state the same network.
TOY = gnn.Weights.from_dict(
    {
        "root": [[1.0, 0.5], [-1.0, 2.0]],
        "rel": [[0.5, -1.0], [1.0, 0.25]],
        "bias": [0.1, -0.2],
        "gamma": [1.5, 0.5],
        "beta": [0.0, 0.3],
        "mean": [0.2, 0.1],
        "var": [0.99999, 3.99999],
        "left": [[1.0, -1.0], [0.5, 0.5], [2.0, 0.0], [-1.0, 1.0]],
        "left_bias": [0.0, 0.1, 0.0, -0.1],
        "right": [[0.5, 1.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]],
        "right_bias": [0.0, 0.0, 0.2, 0.0],
        "attention": [[1.0, -0.5], [0.5, 1.0]],
        "last": [0.25, -0.25],
    }
)
TOY_IMAGE = gnn.Weights.from_dict(
    {
        **{k: getattr(TOY, k) for k in ("bias", "gamma", "beta", "mean", "var", "left_bias", "right_bias")},
        "root": [[1.0], [-1.0]],
        "rel": [[0.5], [1.0]],
        "left": [[1.0, -1.0], [0.5, 0.5]],
        "left_bias": [0.0, 0.1],
        "right": [[0.5, 1.0], [1.0, 0.0]],
        "right_bias": [0.0, 0.2],
        "attention": [[1.0], [-0.5]],
        "last": [0.25],
    }
)


def _points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points = stage(V.particles(spark, sf_dir), "points")
    return points, stage(graph.adjacency(graph.radius_edges(points, RADIUS)), "adjacency")


def graphconv_mean(spark, sf_dir):
    points, adj = _points(spark, sf_dir)
    got = gnn.neighbour_means(points.select("node_id", "density", "temperature"), adj, ["density", "temperature"])
    return got.select("node_id", F.round("mean_density", 6).alias("mean_density"), F.round("mean_temperature", 6).alias("mean_temperature"))


def gnn_softmax(spark, sf_dir):
    points = stage(V.particles(spark, sf_dir), "points")
    got = gnn.softmax_score(gnn.forward(points, graph.Within(RADIUS), ["density", "temperature"], TOY))
    return got.select("node_id", F.round("score", 6).alias("score"))


def gnn_sigmoid(spark, sf_dir):
    cells = stage(V.events_grid(spark, sf_dir).withColumn("f", F.ln("v")), "cells")
    got = gnn.sigmoid_score(gnn.forward(cells, graph.adjacency(graph.pixel_edges(cells)), ["f"], TOY_IMAGE))
    return got.select("node_id", F.round("score", 6).alias("score"))


def classify_particles(spark, sf_dir):
    """The whole scoring of points: profiles, scaling, network, threshold."""
    points = stage(V.particles(spark, sf_dir), "points")
    config = SnapshotConfig(z_bin_size=0.05, r_bin_size=0.05)
    got = classify_points(points, graph.Within(RADIUS), ["density", "temperature"], TOY, config)
    return got.select("node_id", F.round("score", 6).alias("score"), "inner")


def _chunked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Particles, and eight azimuthal chunks with their halos."""
    points = stage(V.particles(spark, sf_dir), "points")
    return points, stage(graph.in_chunks(M.with_chunks(points, 8, 0.05).select("chunk", "id"), points), "held")


def chunk_members(spark, sf_dir):
    """Which particles each chunk holds, looked up by their ids."""
    points = V.particles(spark, sf_dir)
    return graph.in_chunks(M.with_chunks(points, 8, 0.05).select("chunk", "id"), points).select(F.col("chunk").cast("long").alias("chunk"), "node_id")


def classify_chunk_tables(spark, sf_dir):
    """The scoring of points chunk by chunk on halo edges: features of all, a graph for each chunk, the last chunk wins."""
    points, held = _chunked(spark, sf_dir)
    config = SnapshotConfig(z_bin_size=0.05, r_bin_size=0.05)
    got = classify_chunks(points, held, graph.Within(RADIUS), ["density", "temperature"], TOY, config)
    return got.select("node_id", F.round("score", 6).alias("score"), "inner")


def chunk_scores_cached(spark, sf_dir):
    """The same by way of a saved score table, read a second time under another threshold."""
    path = stage_path(spark, "scores")
    points, held = _chunked(spark, sf_dir)
    make = lambda level: classify_chunks(points, held, graph.Within(RADIUS), ["density", "temperature"], TOY, SnapshotConfig(z_bin_size=0.05, r_bin_size=0.05, detection_threshold=level), path, {"model": "toy"})
    make(0.5)
    return make(0.9).select("node_id", F.round("score", 6).alias("score"), "inner")


def classify_event_raster(spark, sf_dir):
    """The whole scoring of a raster: scales, scaling, network, threshold, small holes."""
    config = ImageConfig(filter_sizes=[1, 2], small_hole_size=4)
    got, _, _ = classify_raster(V.events_grid(spark, sf_dir), _days(spark, sf_dir), V.HOURS, TOY_IMAGE, config)
    return got.select("node_id", F.round("v", 6).alias("v"), F.round("score", 6).alias("score"), "inner")


def preprocessed_event_raster(spark, sf_dir):
    """The event raster as both detection modes would score it, without scoring."""
    days, out = _days(spark, sf_dir), None
    for mode in ("composed", "max"):
        config = ImageConfig(filter_sizes=[1, 2], detection_mode=mode)
        got, _, _ = classify_raster(V.events_grid(spark, sf_dir), days, V.HOURS, None, config, preprocess_only=True)
        one = got.select(F.lit(mode).alias("mode"), "node_id", F.col("sigma").cast("long").alias("sigma"), F.round("v", 6).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def raster_from_arrays(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("iy"), F.col("embedding").alias("values"))
    width = rows.agg(F.max(F.size("values"))).first()[0] or 0
    return raster.from_arrays(rows, width).select("node_id", "iy", "ix", F.round(F.col("v").cast("double"), 6).alias("v"))


def fits_region(spark, sf_dir):
    """The event grid written as a FITS image in bands; a region of it read back."""
    path = stage_path(spark, "image")
    write_fits(V.events_grid(spark, sf_dir), path, _days(spark, sf_dir), V.HOURS, 8)
    got = read_fits(spark, path, (slice(3, -2), slice(5, 20)))[0]
    return got.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def fits_whole(spark, sf_dir):
    """The raster of shipping weeks and part columns, written as a FITS image and read back whole; absent pixels are NaN there."""
    path = stage_path(spark, "image")
    height = (V.pixels(spark, sf_dir).agg(F.max("iy")).first()[0] or 0) + 1
    write_fits(V.pixels(spark, sf_dir), path, height, V.PART_COLUMNS, 64)
    pixels, height, width = read_fits(spark, path)
    return raster.full_grid(pixels, height, width)


def chunk_edges_merged(spark, sf_dir):
    """Pairs of consecutive particles as every azimuthal chunk with its halo would give them, put together."""
    points = V.particles(spark, sf_dir)
    held = stage(M.with_chunks(points, 8, 0.05).select("chunk", "id"), "chunks")
    pairs = held.select("chunk", F.col("id").alias("a")).join(held.select("chunk", (F.col("id") - 1).alias("a"), F.col("id").alias("b")), ["chunk", "a"])
    zone = points.where(M.near_chunk_edge(M.azimuth(F.col("x"), F.col("y")), 8, 0.05))
    return graph.merged_chunk_edges(pairs, points, 0.25, zone)


def display_relabel(spark, sf_dir):
    """Customers of the orders as shuffled display labels, by a column expression over the dense customer numbers."""
    n = (V.table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0) + 1
    return V.table(spark, sf_dir, "orders").select("o_orderkey", display_labels(F.col("o_custkey"), n, 7).alias("label"))


def line_profile(spark, sf_dir):
    """Density along y near the axis, coloured by temperature, in 40 pixel columns."""
    points = V.particles(spark, sf_dir).where(M.on_line({"x": 0.0, "z": 0.0}, 0.15))
    got = profile.line_profile(points, "y", F.log10("density"), 40, F.col("temperature"))
    return got.select("pixel", "n", *[F.round(c, 6).alias(c) for c in ("first", "last", "least", "largest", "color")])


def line_profile_orders(spark, sf_dir):
    """The same reduction at a larger size: prices over order numbers, in 500 pixel columns."""
    points = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderkey").cast("double").alias("x"), "o_totalprice", "o_custkey")
    got = profile.line_profile(points, "x", F.col("o_totalprice"), 500, F.col("o_custkey"))
    return got.select("pixel", "n", *[F.round(c, 4).alias(c) for c in ("first", "last", "least", "largest", "color")])


def chunk_store(spark, sf_dir):
    """Chunk tables of two snapshots: written, one chunk missing and added, one replaced by the denser half, listed by file names."""
    path, points = stage_path(spark, "chunks"), V.particles(spark, sf_dir)
    S.write_chunks(points, path, 150, 4, 0.05)
    some = M.with_chunks(points, 8, 0.05).where("own AND chunk <> 3").drop("chunk", "own")
    S.write_chunks(some, path, 151, 8, 0.0)
    S.write_chunks(points, path, 151, 8, 0.05)  # what is there stays
    second = M.with_chunks(points.where("density > 1"), 8, 0.0).where("chunk = 2").drop("chunk", "own")
    S.write_chunks(second, path, 151, 8, 0.0, replace=True)
    listed = S.list_chunks(spark, path, 151)
    complete = S.chunks_complete(S.read_chunks(spark, path, 151))
    return listed.select(*[F.col(c).cast("long").alias(c) for c in ("snapshot", "section")], F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n", F.lit(complete).alias("complete"))


def chunk_store_first(spark, sf_dir):
    """Rows of the first two sections of a stored snapshot."""
    path = stage_path(spark, "chunks")
    for snapshot, chunks in ((150, 4), (151, 8)):
        S.write_chunks(V.particles(spark, sf_dir), path, snapshot, chunks, 0.05)
    return S.read_chunks(spark, path, 151, 2).select(F.col("chunk").cast("long").alias("chunk"), "node_id", "own")


def extract_grid_points(spark, sf_dir):
    cells = _inner(spark, sf_dir).select("node_id", "iy", "ix", "inner", F.col("v").alias("density"))
    cells = stage(cells, "cells")
    return extract_points(cells, graph.pixel_edges(cells, graph.AHEAD_4), InnerConfig(min_component_size=2), ShellConfig(max_layer=2))


def extract_grid_raster(spark, sf_dir):
    days = _days(spark, sf_dir)
    grid = raster.full_grid(V.events_grid(spark, sf_dir), days, V.HOURS)
    return extract_raster(stage(V.quiet(grid, 0.3), "cells"), days, V.HOURS, InnerConfig(min_component_size=2), ShellConfig(max_layer=2))


def extract_shipping_raster(spark, sf_dir):
    """The whole segmentation on the raster of shipping weeks and part columns."""
    height = V.pixels(spark, sf_dir).agg(F.max("iy") + 1).first()[0]
    grid = raster.full_grid(V.pixels(spark, sf_dir), height, V.PART_COLUMNS)
    return extract_raster(stage(V.quiet(grid, 0.8), "cells"), height, V.PART_COLUMNS, InnerConfig(peel_iteration=3), ShellConfig())



QUERIES = {
    f.__name__: f
    for f in (
        slice_mask,
        range_mask,
        line_mask,
        cylinder_filter,
        cylinder_boundary,
        box_boundary,
        polar_coordinates,
        azimuth_chunks,
        overlap_zone,
        display_projection,
        region_class,
        pixel_clean,
        valid_pixels,
        pixel_edges_valid,
        pixel_edges_all,
        radius_edges,
        edge_length_filter,
        edge_canonical,
        adjacency,
        degree,
        id_lookup,
        chunk_membership,
        chunk_last_wins,
        induced_edges,
        rz_profile,
        profile_normalised,
        scaled_features,
        robust_scale,
        robust_scale_by_group,
        scaler_reuse,
        phase_space_hist,
        component_ids,
        component_medians,
        component_sizes,
        peel_once,
        peel_levels,
        lineage_edges,
        lineage_seeds,
        mode_neighbour,
        mode_supplier_nation,
        grow_wave,
        merge_contacts,
        merge_decisions,
        merge_all,
        group_stats,
        directed_edges,
        directed_edges_density_temperature,
        shell_reach,
        shell_round,
        erosion,
        dilation,
        small_holes,
        fill_holes,
        gaussian_norm,
        multiscale_mean,
        gaussian_norm_shipping,
        multiscale_mean_shipping,
        max_over_scales,
        align_moments,
        nonzero_bbox,
        aligned_raster,
        graphconv_mean,
        gnn_softmax,
        gnn_sigmoid,
        saved_features,
        valid_components,
        classify_particles,
        chunk_members,
        classify_chunk_tables,
        chunk_scores_cached,
        classify_event_raster,
        preprocessed_event_raster,
        raster_from_arrays,
        chunk_edges_merged,
        fits_region,
        fits_whole,
        display_relabel,
        line_profile,
        line_profile_orders,
        chunk_store,
        chunk_store_first,
        extract_grid_points,
        extract_grid_raster,
        extract_shipping_raster,
    )
}
