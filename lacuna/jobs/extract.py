"""Facades: classify scores nodes, extract turns scored nodes into groups with shells."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.jobs.config import ImageConfig, InnerConfig, ShellConfig, SnapshotConfig
from lacuna.operators import gnn, graph, grow, lineage, merge, profile, raster, shell
from lacuna.sources.staging import stage


def classify_points(points: DataFrame, edges: DataFrame | graph.Within, names: list[str], weights: gnn.Weights, config: SnapshotConfig | None = None) -> DataFrame:
    """points with score and inner: normalised features, one network pass over the whole graph, threshold.

    edges: pairs of node ids (src, dst), or a radius: all pairs of points that are closer, of which none is written.
    """
    config = config or SnapshotConfig()
    adj = edges if isinstance(edges, graph.Within) else stage(graph.adjacency(graph.canonical_edges(edges)), "adjacency")
    feats = stage(profile.features(points, names, config.normalize, config.z_bin_size, config.r_bin_size), "features")
    scored = gnn.softmax_score(gnn.forward(feats, adj, [f"f{k}" for k in range(len(names))], weights), weights.attention.shape[1])
    return points.join(scored, "node_id").withColumn("inner", F.col("score") > config.detection_threshold)


def classify_chunks(
    points: DataFrame, held: DataFrame, edges: DataFrame | graph.Within, names: list[str], weights: gnn.Weights, config: SnapshotConfig | None = None, cache: str | None = None, attributes: dict | None = None, force: bool = False
) -> DataFrame:
    """points with score and inner, scored chunk by chunk: features of the whole snapshot, the network on each chunk's own edges.

    held: (chunk, node_id) with halos; edges: (chunk, src, dst), raw, or a radius for each chunk's own points. Of a node in several chunks the highest chunk counts, a node of
    none scores 0. With cache, a path (config.score_path), scores are read from there if they were made with the
    same attributes (model, snapshot) and feature settings, unless forced; the threshold is applied to them afterwards.
    """
    config = config or SnapshotConfig()

    def make() -> DataFrame:
        feats = stage(profile.features(points, names, config.normalize, config.z_bin_size, config.r_bin_size), "features")
        return gnn.score_chunks(feats, held, edges, [f"f{k}" for k in range(len(names))], weights)

    if cache:
        said = {**(attributes or {}), "features": names, "normalize": config.normalize, "z_bin_size": config.z_bin_size, "r_bin_size": config.r_bin_size}
        scores = load_or_make(points.sparkSession, cache, make, said, force)
    else:
        scores = make()
    both = points.join(scores.select("node_id", "score"), "node_id", "left").na.fill(0.0, ["score"])
    return both.withColumn("inner", F.col("score") > config.detection_threshold)


def preprocess_raster(pixels: DataFrame, height: int, width: int, config: ImageConfig | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """(grid, scales, height, width): all pixels of the aligned raster, and what is scored of them at each scale (column sigma).

    With composed scales the grid itself is their mean and has sigma 0; with max the grid is as it came and each scale is a row of its own.
    """
    config = config or ImageConfig()
    if config.align:
        pixels, height, width = raster.align(pixels, height, width)
    grid = stage(raster.full_grid(pixels, height, width), "grid")
    if config.detection_mode == "composed":
        grid = stage(raster.composed(grid, config.filter_sizes, (height, width)), "grid")
        scales = grid.withColumn("sigma", F.lit(0))
    else:
        scales = stage(raster.normalized(grid, config.filter_sizes, (height, width)), "scales")
    return grid, scales, height, width


def classify_raster(pixels: DataFrame, height: int, width: int, weights: gnn.Weights | None, config: ImageConfig | None = None, preprocess_only: bool = False) -> tuple[DataFrame, int, int]:
    """(all pixels with v, score and inner, height, width): aligned if asked for, normalised, scored at each scale, small holes filled.

    With preprocess_only, for which no weights are needed, the pixels at each scale (v, sigma) before any scoring.
    """
    config = config or ImageConfig()
    grid, scales, height, width = preprocess_raster(pixels, height, width, config)
    if preprocess_only:
        return scales.select("node_id", "iy", "ix", "sigma", "v"), height, width
    live = raster.valid(grid).select("node_id")
    adj = stage(graph.adjacency(graph.pixel_edges(raster.valid(grid))), "adjacency")
    logs = scales.join(live, "node_id", "left_semi").select("node_id", "sigma", F.ln("v").alias("ln_v"))
    logs = stage(profile.robust_apply(logs, "ln_v", profile.robust_fit(logs, "ln_v", ["sigma"]), "f0", ["sigma"]), "features")
    scores = None
    for sigma in [0] if config.detection_mode == "composed" else config.filter_sizes:
        one = gnn.sigmoid_score(gnn.forward(logs.where(F.col("sigma") == sigma).select("node_id", "f0"), adj, ["f0"], weights))
        scores = one if scores is None else scores.unionByName(one)
    best = gnn.best_over_scales(scores)
    scored = grid.join(best, "node_id", "left").na.fill(0.0, ["score"]).withColumn("inner", F.col("score") > config.detection_threshold)
    return raster.fill_small_holes(stage(scored, "scored"), area=config.small_hole_size), height, width


def _groups(found: lineage.Lineage, inner_edges: DataFrame, adj: DataFrame, boundary: DataFrame | None, config: InnerConfig) -> DataFrame:
    seeds = stage(grow.seed_groups(found, lineage.seeds(found)), "seeds")
    assigned = grow.grow(found, seeds, inner_edges, config.single_connect, config.connect)
    invalid = seeds.where("invalid") if config.enforce_terminal_bijection else None
    return merge.merge_groups(assigned, adj, seeds.where("iter = 0"), boundary, config.threshold, config.max_group_size, invalid)


def extract_points(scored: DataFrame, edges: DataFrame, inner: InnerConfig | None = None, shells: ShellConfig | None = None, boundary: DataFrame | None = None) -> DataFrame:
    """(node_id, inner_group, group_id), -1 for none: peel, grow, merge and, if shells is given, attach shells.

    scored: (node_id, inner, density[, temperature]). edges: pairs of node ids; loops, repeats and
    direction don't matter. Fewer than two components give no groups. An empty table gives no rows.
    """
    inner = inner or InnerConfig()
    edges = stage(graph.canonical_edges(edges), "edges")
    adj = stage(graph.adjacency(edges), "adjacency")
    marked = scored.where("inner").select("node_id")
    found = lineage.component_lineage(marked, edges, adj, inner.peel_iteration, inner.min_component_size, inner.component_iteration_size_factor)
    assigned = stage(_groups(found, graph.induced(edges, marked), adj, boundary, inner), "groups")
    full = assigned
    if shells:
        reach = shell.walk_reach(assigned, adj, shells.max_layer)
        full = shell.assign_shells(reach, shell.directed_edges(edges, scored, shells.pair_order), assigned, shells.inner_connect, shells.connect, shells.max_iter)
    return _labelled(scored, assigned, full)


def extract_raster(grid: DataFrame, height: int, width: int, inner: InnerConfig | None = None, shells: ShellConfig | None = None) -> DataFrame:
    """(node_id, inner_group, group_id) of a full raster (node_id, iy, ix, v, inner): components and peeling are 4-connected, the rest 8-connected."""
    inner = inner or InnerConfig()
    spark = grid.sparkSession
    edges = stage(graph.grid_edges(spark, height, width), "edges")
    adj = stage(graph.adjacency(edges), "adjacency")
    cross = stage(graph.grid_edges(spark, height, width, graph.AHEAD_4), "cross")
    marked = grid.where("inner").select("node_id")
    found = lineage.component_lineage(marked, cross, graph.adjacency(cross), inner.peel_iteration, inner.min_component_size, inner.component_iteration_size_factor, raster=True)
    assigned = stage(_groups(found, graph.induced(edges, marked), adj, None, inner), "groups")
    full = assigned
    if shells:
        reach = raster.dilate(grid.where("inner"), height, width, shells.max_layer)
        outer = grid.where(~F.col("inner") & (F.col("v") > 0)).join(reach, ["iy", "ix"], "left_semi").select("node_id")
        directed = shell.directed_edges(edges, grid.withColumnRenamed("v", "density"))
        full = shell.assign_shells(outer, directed, assigned, shells.inner_connect, shells.connect, shells.max_iter)
    return _labelled(grid, assigned, full)


def _labelled(nodes: DataFrame, assigned: DataFrame, full: DataFrame) -> DataFrame:
    out = nodes.select("node_id").join(assigned.withColumnRenamed("group_id", "inner_group"), "node_id", "left").join(full, "node_id", "left")
    return out.select("node_id", F.coalesce("inner_group", F.lit(-1)).alias("inner_group"), F.coalesce("group_id", F.lit(-1)).alias("group_id"))


def save(df: DataFrame, path: str, attributes: dict) -> None:
    """Write a result and its parameters; both are Spark-written, so any shared store will do."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(json.dumps(attributes, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_attributes")


def load_or_make(spark, path: str, make, attributes: dict, force: bool = False) -> DataFrame:
    """The result at path if it was made with the same parameters; else make() is saved there first."""
    try:
        same = not force and spark.read.text(f"{path}_attributes").first()[0] == json.dumps(attributes, sort_keys=True)
    except Exception as e:  # only a path that isn't there means that the result has to be made
        if "PATH_NOT_FOUND" not in str(e):
            raise
        same = False
    if not same:
        save(make(), path, attributes)
    return spark.read.parquet(path)
