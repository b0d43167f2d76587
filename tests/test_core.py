"""Operators against hand-made fixtures, plain-Python restatements, and SQL on the given tables."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.functions import masks
from lacuna.jobs import config as C
from lacuna.jobs import registry
from lacuna.jobs.extract import extract_points, extract_raster, load_or_make
from lacuna.jobs.oracles import ORACLES
from lacuna.jobs.queries import QUERIES, TOY
from lacuna.jobs.registry import load_weights
from lacuna.operators import gnn, graph, grow, indexing, lineage, merge, profile, raster, shell, tiles
from lacuna.operators.components import connected_components
from lacuna.sources.staging import discard, stage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(map(plain, r)) for r in got.select(names).collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


# H7: a grid of 15 x 11 cells

ART = """...............
.#####...#####.
.#####...#####.
.#############.
.#####...#####.
.#####...#####.
...............
...............
.......####....
.......####....
...............""".split("\n")
W, H = 15, 11
INNER = [r * W + c for r in range(H) for c in range(W) if ART[r][c] == "#"]


@pytest.fixture(scope="module")
def h7(spark):
    edges = stage(graph.grid_edges(spark, H, W), "edges")
    adj = stage(graph.adjacency(edges), "adj")
    inner = spark.createDataFrame([(i,) for i in INNER], "node_id long")
    return edges, adj, inner


def run_lineage(h7, rounds):
    edges, adj, inner = h7
    return lineage.component_lineage(inner, edges, adj, rounds, 1)


def test_lineage(h7):
    for rounds in (2, 3, 5):
        found = run_lineage(h7, rounds)
        comps = {(r["iter"], r["cid"]): (r["n"], r["first"]) for r in found.members.groupBy("iter", "cid").agg(F.count("*").alias("n"), F.min("node_id").alias("first")).collect()}
        want = {(0, 0): (53, 16), (0, 1): (8, 127), (1, 0): (9, 32), (1, 1): (9, 40)}
        forest = {(0, 0, 1, 0), (0, 0, 1, 1)}
        levels = {1: 43, 2: 18}
        seeds = {(0, 1, False), (1, 0, True), (1, 1, True)}
        if rounds > 2:
            want |= {(2, 0): (1, 48), (2, 1): (1, 56)}
            forest |= {(1, 0, 2, 0), (1, 1, 2, 1)}
            levels = {1: 43, 2: 16, 3: 2}
            seeds = {(0, 1, False), (1, 0, False), (1, 1, False)}
        assert comps == want
        assert {tuple(r) for r in found.parents.select("parent_iter", "parent_cid", "iter", "cid").collect()} == forest
        assert {r["iter_label"]: r["count"] for r in found.levels.groupBy("iter_label").count().collect()} == levels
        assert {tuple(r) for r in lineage.seeds(found).collect()} == seeds


@pytest.fixture(scope="module")
def grown(h7):
    edges, _, inner = h7
    found = run_lineage(h7, 5)
    groups = stage(grow.seed_groups(found, lineage.seeds(found)), "groups")
    return stage(grow.grow(found, groups, graph.induced(edges, inner)), "grown"), groups


def sizes(df):
    return {r["group_id"]: r["count"] for r in df.groupBy("group_id").count().collect()}


def test_growth_and_merge(h7, grown):
    _, adj, _ = h7
    assigned, groups = grown
    assert sizes(assigned) == {0: 8, 1: 27, 2: 26}
    at = {r["node_id"]: r["group_id"] for r in assigned.collect()}
    assert [at[3 * W + c] for c in (6, 7, 8)] == [1, 1, 2]
    got = {r["group_id"]: (r["touching"] / r["neighbours"], r["target"]) for r in merge.decisions(assigned, adj, threshold=0.03).collect()}
    assert got[1][0] == pytest.approx(0.0357, abs=1e-4) and got[2][0] == pytest.approx(0.0385, abs=1e-4)
    assert (got[0][1], got[1][1], got[2][1]) == (None, 2, 1)
    isolated = groups.where("iter = 0")
    assert sizes(merge.merge_groups(assigned, adj, isolated, threshold=0.2)) == {0: 8, 1: 27, 2: 26}
    assert sizes(merge.merge_groups(assigned, adj, isolated, threshold=0.03)) == {0: 8, 2: 53}


def test_shells(spark, h7, grown):
    edges, adj, _ = h7
    nodes = spark.createDataFrame([(i, 1.0 if i in INNER else 2.0 + min(abs(i // W - 5), 3)) for i in range(W * H)], "node_id long, density double")
    assigned = grown[0]
    reach = shell.walk_reach(assigned, adj, 2).join(assigned, "node_id", "left_anti")
    assert reach.count() == 83
    full = shell.assign_shells(reach, shell.directed_edges(edges, nodes), assigned, 1, 2, 3)
    assert sizes(full) == {0: 27, 1: 59, 2: 54}


def test_facades(spark, h7):
    edges, _, _ = h7
    nodes = spark.createDataFrame([(i, i in INNER, 1.0 if i in INNER else 2.0 + min(abs(i // W - 5), 3)) for i in range(W * H)], "node_id long, inner boolean, density double")
    inner, shells = C.InnerConfig(min_component_size=1), C.ShellConfig(max_layer=2)
    one = {r["node_id"]: (r["inner_group"], r["group_id"]) for r in extract_points(nodes, edges, inner, shells).collect()}
    again = extract_points(nodes.repartition(7), edges.selectExpr("dst AS src", "src AS dst").union(edges), inner, shells)
    assert one == {r["node_id"]: (r["inner_group"], r["group_id"]) for r in again.collect()}
    assert sum(g >= 0 for _, g in one.values()) == 27 + 59 + 54 and sum(i >= 0 for i, _ in one.values()) == len(INNER)
    assert all(i == -1 or i == g for i, g in one.values())
    none = extract_points(nodes.withColumn("inner", F.lit(False)), edges, inner, shells).collect()
    assert {(r["inner_group"], r["group_id"]) for r in none} == {(-1, -1)}
    grid = spark.createDataFrame([(i, i // W, i % W, 1.0 if i in INNER else 2.0, i in INNER) for i in range(W * H)], "node_id long, iy long, ix long, v double, inner boolean")
    got = {r["node_id"]: (r["inner_group"], r["group_id"]) for r in extract_raster(grid, H, W, inner, shells).collect()}
    assert len(got) == W * H and len({g for g, _ in got.values()} - {-1}) == 3


# H4 to H6, single steps


def test_mode_takes_smallest_of_ties(spark):
    adj = spark.createDataFrame([(0, n) for n in range(1, 6)], "node long, nbr long")
    groups = spark.createDataFrame([(1, 5), (2, 5), (3, 3), (4, 3), (5, 9)], "node_id long, group_id long")
    assert [tuple(r) for r in graph.mode_neighbour(adj, groups).collect()] == [(0, 3, 2, 3, 5)]


@pytest.mark.parametrize("order,targets,want", [((0, 1), {0: 1, 1: 2}, [2, 2, 2]), ((1, 0), {0: 1, 1: 2}, [1, 2, 2]), ((0, 1), {0: 1, 1: 0}, [0, 0, 2])])
def test_merge_fold(spark, order, targets, want):
    decided = spark.createDataFrame([(g, k, targets[g]) for k, g in enumerate(order)], "group_id long, size long, target long")
    cells = spark.createDataFrame([(g, g) for g in range(3)], "node_id long, group_id long")
    got = merge.relabel(cells, merge.fold(decided)).orderBy("node_id").collect()
    assert [r["group_id"] for r in got] == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 7), min_size=8, max_size=8), st.permutations(range(8)))
def test_merge_fold_equals_loop(spark, targets, order):
    label = list(range(8))
    for g in order:
        if targets[g] != g:
            label = [targets[g] if x == g else x for x in label]
    decided = spark.createDataFrame([(g, k, targets[g]) for k, g in enumerate(order)], "group_id long, size long, target long")
    cells = spark.createDataFrame([(g, g) for g in range(8)], "node_id long, group_id long")
    assert [r["group_id"] for r in merge.relabel(cells, merge.fold(decided)).orderBy("node_id").collect()] == label


def test_walk_reach_is_exact(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    adj = graph.adjacency(edges)
    start = spark.createDataFrame([(0, 0)], "node_id long, group_id long")
    nodes = spark.createDataFrame([(i, 1.0 + i) for i in range(4)], "node_id long, density double")
    for layers, reach, shells in ((1, {1}, {1}), (2, {2}, set()), (3, {1, 3}, {1})):
        got = {r["node_id"] for r in shell.walk_reach(start, adj, layers).collect()} - {0}
        assert got == reach
        full = shell.assign_shells(shell.walk_reach(start, adj, layers), shell.directed_edges(edges, nodes), start, 1, 1, 3)
        assert {r["node_id"] for r in full.collect()} - {0} == shells


# Graphs


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components_equal_union_find(spark, pairs):
    up = list(range(41))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df.repartition(3)).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_components_of_a_long_path_and_star(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(500).tolist()
    path = [(names[i], names[i + 1]) for i in range(299)]
    star = [(names[300], names[i]) for i in range(301, 500)]
    df = spark.createDataFrame([*path, *star, (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert set(got.values()) == {min(names[:300]), min(names[300:])} and len(got) == 500


def test_pixel_edges(spark):
    cells = [(r * 3 + c, r, c) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(cells, "node_id long, iy long, ix long")
    assert graph.pixel_edges(df).count() == graph.grid_edges(spark, 3, 3).count() == 20
    assert graph.pixel_edges(df.where("node_id <> 4")).count() == 12


def test_radius_edges_equal_brute(spark):
    xyz = np.random.default_rng(2).uniform(-1, 1, (120, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "node_id long, x double, y double, z double")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if ((xyz[i] - xyz[j]) ** 2).sum() < 0.09}
    assert {tuple(r) for r in graph.radius_edges(df, 0.3).collect()} == want


def test_edges_with_repeats_loops_and_absent_ids(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 2)], "src long, dst long")
    assert [tuple(r) for r in graph.canonical_edges(df).collect()] == [(1, 2)]
    nodes = spark.createDataFrame([(0, 10), (1, 20)], "node_id long, id long")
    assert [tuple(r) for r in graph.by_ids(spark.createDataFrame([(10, 20), (10, 99)], "a long, b long"), nodes).collect()] == [(0, 1)]


def test_dense_index(spark):
    keys = np.random.default_rng(1).permutation(1000).tolist()
    got = indexing.dense_index(spark.createDataFrame([(k,) for k in keys], "k long"), ["k"], "at").collect()
    assert all(r["k"] == r["at"] for r in got) and len(got) == 1000


# Masks and features


def test_masks(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(masks.in_slice(F.col("p"), 0.0, 1.0)) == [True, True, False]
    assert one(masks.in_range(F.col("p"), 0.0, 1.0)) == [False, True, False]
    assert one(masks.is_valid(F.col("p"))) == [False, True, True]
    xyz = spark.createDataFrame([(1.0, 0.0, 5.0), (1.1, 0.0, 5.0)], "x double, y double, z double")
    assert [r[0] for r in xyz.select(masks.on_line({"x": 0.0, "y": 0.0}, 1.0)).collect()] == [True, False]
    with pytest.raises(ValueError):
        masks.on_line({"x": 0.0}, 1.0)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (None,), (2.0,)], "v double")
    assert [r[0] for r in odd.select(masks.clean(F.col("v"))).collect()] == [0, 0, 0, 0, 2]
    assert [masks.chunk_count(n) for n in (0, 1, 5_000_000, 9_000_000, 180_000_000)] == [1, 1, 1, 2, 32]


def test_robust_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "q double")
    fit = profile.robust_fit(df, "q")
    assert tuple(fit.first()) == (3.0, 3.25)
    got = [r["s"] for r in profile.robust_apply(df, "q", fit, "s").orderBy("q").collect()]
    assert got == pytest.approx([-0.615385, -0.307692, 0.307692, 1.538462], abs=1e-6)
    assert tuple(profile.robust_fit(df.withColumn("q", F.lit(5.0)), "q").first()) == (5.0, 1.0)
    with pytest.raises(ValueError):
        profile.features(df, ["pressure"])


def test_robust_fit_is_exact_without_a_percentile_buffer(spark):
    rng = np.random.default_rng(3)
    rows = [(str(g), float(v)) for g, n in enumerate((1, 2, 3, 50, 400)) for v in np.round(rng.standard_normal(n), 2)]
    rows += [("null", None), (None, 1.0), (None, 4.0), ("3", None), ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, q double").repartition(7)
    for by in (["g"], []):
        for some in (df, df.where("q IS NULL"), df.limit(0)):
            fit = profile.robust_fit(some, "q", by)
            assert "percentile" not in fit._jdf.queryExecution().toString()
            q = F.percentile("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            want = some.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[1], F.col("q")[2] - F.col("q")[0]).collect()
            got = fit.collect()
            assert len(got) == len(want)
            key = lambda r: str(r[:-2])
            for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
                assert tuple(x)[:-2] == tuple(y)[:-2]
                for a, b in ((x[-2], y[-2]), (x[-1], 1.0 if y[-1] == 0 else y[-1])):
                    assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12, nan_ok=True)


# Rasters


def grid_of(spark, a):
    return spark.createDataFrame([(int(r * a.shape[1] + c), int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "node_id long, iy long, ix long, v double")


def test_gaussian_equals_direct_sum(spark):
    a = np.random.default_rng(3).uniform(0, 1, (6, 5))
    w = tiles.kernel(2)
    at = lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    want = np.array([[sum(w[p] * w[q] * a[at(y + p - 8, 6), at(x + q - 8, 5)] for p in range(17) for q in range(17)) for x in range(5)] for y in range(6)])
    got = np.zeros_like(a)
    for r in raster.gaussian(grid_of(spark, a), 2).collect():
        got[r["iy"], r["ix"]] = r["v"]
    assert np.allclose(got, want)


def test_morphology(spark):
    a = np.zeros((7, 7))
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    cells = grid_of(spark, a).where("v > 0")
    assert {(r["iy"], r["ix"]) for r in raster.erode(cells, 7, 7).collect()} == {(2, 2), (2, 4), (4, 2), (4, 4)}
    assert raster.dilate(cells, 7, 7).count() == 25 + 20
    grid = grid_of(spark, a).withColumn("inner", F.col("v") > 0)
    assert raster.fill_holes(grid, 7, 7).where("inner").count() == 25
    assert raster.fill_small_holes(grid, area=2).where("inner").count() == 25
    assert raster.fill_small_holes(grid, area=1).where("inner").count() == 24
    edge = grid_of(spark, np.ones((4, 4)))
    assert raster.erode(edge, 4, 4).count() == 16


def test_align_turns_a_bar(spark):
    a = np.zeros((20, 20))
    for k in range(3, 17):
        a[k, k - 1 : k + 2] = 1
    out, h, w = raster.align(grid_of(spark, a), 20, 20)
    assert max(h, w) > 2.5 * min(h, w) and out.count() == h * w
    turned, h, w = raster.rotate(grid_of(spark, a), 20, 20, 90)
    got = np.zeros((h, w))
    for r in turned.collect():
        got[r["iy"], r["ix"]] = r["v"]
    assert np.allclose(got, np.rot90(a)) or np.allclose(got, np.rot90(a, -1))
    cut = raster.region(grid_of(spark, a), 3, 6, 2, 6)
    assert cut.count() == 12 and cut.agg(F.max("node_id")).first()[0] == 11


# Network


def test_network_by_hand(spark):
    x = np.array([[1.0, 2.0], [3.0, 1.0], [0.5, 0.5], [2.0, 2.0]])
    nbrs = [[1], [0, 2], [1], []]
    w = TOY
    mean = np.array([x[n].mean(0) if n else np.zeros(2) for n in nbrs])
    h = np.maximum((x @ w.root.T + mean @ w.rel.T + w.bias - w.mean) / np.sqrt(w.var + w.eps) * w.gamma + w.beta, 0)
    left, right = h @ w.left.T + w.left_bias, h @ w.right.T + w.right_bias
    want = []
    for i in range(4):
        near, total = [*nbrs[i], i], np.zeros(2)
        for k in range(2):
            s = left[near, 2 * k : 2 * k + 2] + right[i, 2 * k : 2 * k + 2]
            e = np.where(s > 0, s, 0.2 * s) @ w.attention[k]
            a = np.exp(e - e.max())
            total += (a / a.sum()) @ left[near, 2 * k : 2 * k + 2]
        want.append(total / 2 + w.last)
    nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "node_id long, a double, b double")
    adj = spark.createDataFrame([(i, j) for i, n in enumerate(nbrs) for j in n], "node long, nbr long")
    got = gnn.forward(nodes, adj, ["a", "b"], w).orderBy("node_id").collect()
    assert np.allclose([[r["o0"], r["o1"]] for r in got], want)
    p = gnn.softmax_score(gnn.forward(nodes, adj, ["a", "b"], w)).orderBy("node_id").collect()
    assert np.allclose([r["score"] for r in p], [1 / (1 + math.exp(o[1] - o[0])) for o in want])


# Jobs


def test_config(tmp_path):
    assert C.parse_chunk_name("151_3_-0.5_0.0_sec_vor.npz") == (151, 3)
    with pytest.raises(ValueError):
        C.parse_chunk_name("x.npz")
    C.check_intervals([(0.0, math.pi), (-math.pi, 0.0)], -math.pi, math.pi)
    with pytest.raises(ValueError):
        C.check_intervals([(-math.pi, 0.0), (0.1, math.pi)], -math.pi, math.pi)
    one, two = C.config_hash(C.InnerConfig()), C.config_hash(C.InnerConfig(), C.ShellConfig())
    assert len(one) == 8 and one != two and C.result_path("r", 1, "m", C.InnerConfig()).endswith("_unshelled")
    assert C.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        C.ImageConfig(detection_mode="x")
    with pytest.raises(TypeError):
        C.ImageConfig(filter_sizes=[1.5])


def test_registry(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "models.yaml").write_text("models:\n  cube:\n    config: cube.yaml\n    description: d\n  flat:\n    config: flat.yaml\n")
    (tmp_path / "configs/base.yaml").write_text("architecture: {heads: 8, out_channels: 2}\nmetadata: {tags: [3d]}\n")
    (tmp_path / "configs/cube.yaml").write_text("base_config: base.yaml\narchitecture: {in_channels: 2}\n")
    (tmp_path / "configs/flat.yaml").write_text("base_config: base.yaml\narchitecture: {heads: 2}\nmetadata: {tags: [2d]}\ninput_features: [column density]\n")
    models = registry.registry(spark, tmp_path / "models.yaml")
    assert registry.get_model(models, "CUBE")["heads"] == 8
    assert [r["name"] for r in registry.list_models(models, ["2d"]).collect()] == ["flat"]
    assert [r["name"] for r in registry.list_models(models, part="CU").collect()] == ["cube"]
    with pytest.raises(KeyError, match="cube, flat"):
        registry.get_model(models, "none")


def test_weights_come_from_a_table_with_the_shapes_of_the_model(spark):
    model = {"name": "Small", "in_channels": 2, "hidden": 2, "out_channels": 2, "heads": 2}
    rows = []
    for name in ("root", "rel", "bias", "gamma", "beta", "mean", "var", "left", "left_bias", "right", "right_bias", "attention", "last"):
        x = np.asarray(getattr(TOY, name))
        rows += [("small", name, int(at[0]), int(at[1]) if x.ndim > 1 else 0, float(v)) for at, v in np.ndenumerate(x)]
    table = lambda rows: spark.createDataFrame(rows + [("other", "bias", 0, 0, 9.0)], "name string, parameter string, i int, j int, value double")
    got = load_weights(table(rows), model)
    assert all((np.asarray(getattr(got, n)) == np.asarray(getattr(TOY, n))).all() for n in ("root", "left", "attention", "last", "bias"))
    for bad in (rows[1:], rows + rows[:1], rows + [("small", "bias", 2, 0, 1.0)], rows + [("small", "more", 0, 0, 1.0)]):
        with pytest.raises(ValueError):
            load_weights(table(bad), model)


def test_valid_nodes_decide_about_first_components(spark, h7):
    edges, adj, inner = h7
    every = lineage.component_lineage(inner, edges, adj, 3, 1)
    first = every.members.where("iter = 0")
    only = {r["cid"] for r in first.collect()}
    assert len(only) == 2
    none = lineage.component_lineage(inner, edges, adj, 3, 1, valid=inner.where("false"))
    assert none.members.count() == 0 and none.levels.count() == inner.count()
    same = lineage.component_lineage(inner, edges, adj, 3, 1, valid=inner)
    assert sorted(map(tuple, same.members.collect())) == sorted(map(tuple, every.members.collect()))


def test_group_medians_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), None if v < 0.05 else round(float(v), 2)) for g, v in zip(rng.integers(0, 4, 500), rng.random(500), strict=True)] + [(9, None)]
    got = {r["g"]: r["median"] for r in profile.group_medians(spark.createDataFrame(rows, "g long, v double").repartition(5), "v", ["g"]).collect()}
    for g in range(4):
        assert got[g] == pytest.approx(np.median([v for k, v in rows if k == g and v is not None]))
    assert got.get(9) is None


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from lacuna.sources import staging

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session)
    Context.master = "local[2]"
    assert staging.shared_dir(Session)


def test_cache_is_reused_only_for_equal_parameters(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = f"{tmp_path}/result"
    for attributes in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert load_or_make(spark, path, make, attributes).count() == 3
    assert len(calls) == 2


def test_stage_and_discard(spark):
    df = stage(spark.range(5), "x")
    assert df.count() == 5
    files = df.inputFiles()
    discard(df)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
