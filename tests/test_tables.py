"""Brackets of percentiles, display labels, line profiles, the chunk store, tiles, the component tree, merging on contacts, and clashing names."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.names import fresh
from lacuna.functions.relabel import display_labels, shuffled
from lacuna.operators import components, graph, indexing, lineage, merge, profile, raster, tiles
from lacuna.sources import snapshot as S


def test_brackets_are_bit_equal_to_the_exact_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 30_000), rng.normal(0, 1, 30_000), strict=True)]
    rows += [(7, 1.0)] * 50 + [(8, None)] * 3 + [(9, 5.0), (None, 2.0), (None, 4.0), (10, -0.0), (10, 0.0)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.expr(f"percentile(v, array({', '.join(map(str, shares))}))").alias("p")).collect()}
    for rows_in_one, accuracy in ((profile.BROADCAST_ROWS, 10_000), (0, 10_000), (profile.BROADCAST_ROWS, 50)):
        monkeypatch.setattr(profile, "BROADCAST_ROWS", rows_in_one)
        monkeypatch.setattr(profile, "ACCURACY", accuracy)
        got = {r["g0"]: [r[f"q{k}"] for k in range(5)] for r in profile._percentiles(df, "v", ["g"], shares).collect()}
        assert got.keys() == want.keys() and all(got[g] == (want[g] or [None] * 5) for g in want)


def test_a_wrong_sketch_is_noticed(spark, monkeypatch):
    """Brackets that miss their ranks: every value is counted instead."""
    df = spark.createDataFrame([(float(k),) for k in range(2000)], "v double")
    monkeypatch.setattr(profile.F, "percentile_approx", lambda c, asked, a: F.transform(F.array(*[F.lit(1.0)] * len(asked)), lambda x: x * F.min(c)))
    assert profile._percentiles(df, "v", [], (0.5,)).first()["q0"] == 999.5


def test_names_that_clash(spark):
    assert fresh(["A", "a_"], "a", "b", "a") == ["a__", "b", "a___"]
    names = ["part", "inside", "size", "shift", "center", "scale", "ratio", "r_bin", "z_bin", "mean", "log_ratio", "edges", "r_min"]
    rows = [(k, k % 3, 0.1 * k, 0.2 * k, 0.3, 1.0 + k, 2.0, 1.0, *range(len(names))) for k in range(40)]
    df = spark.createDataFrame(rows, "node_id long, g int, x double, y double, z double, density double, temperature double, mass double, " + ", ".join(f"{n} long" for n in names))
    plain = df.drop(*names)
    for f in (
        lambda d: indexing.dense_index(d, ["node_id"], "n"),
        lambda d: profile.robust_apply(d, "density", profile.robust_fit(d, "density", ["g"]), "out", ["g"]),
        lambda d: profile.features(d, ["density", "temperature"], True, 0.5, 0.5),
        lambda d: profile.features(d, ["density"], False),
    ):
        got, want = f(df), f(plain)
        assert set(got.columns) == set(want.columns) | set(names)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert all([r[n] for n in names] == list(range(len(names))) for r in got.collect())


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_display_labels_are_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(shuffled(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        other = [r[0] for r in spark.range(n).select(shuffled(F.col("id"), n, 4)).collect()]
        assert other != got and sum(a == b for a, b in enumerate(got)) < 20
        assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.15  # neighbours differ
    odd = spark.createDataFrame([(None,), (-1,), (0,), (n,)], "v long").select(display_labels(F.col("v"), n, 3)).collect()
    assert [r[0] for r in odd] == [None, None, 0, None]


def test_line_profile_keeps_what_a_plot_shows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(v), float(c)) for k, (x, v, c) in enumerate(zip(rng.integers(0, 50, 500) / 10, rng.normal(0, 1, 500), rng.random(500), strict=True))]
    odd = [(900, None, 1.0, 1.0), (901, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows + odd, "node_id long, x double, v double, c double").repartition(4)
    for limits in (None, (1.0, 3.0)):
        lo, hi = limits or (min(r[1] for r in rows), max(r[1] for r in rows))
        cols = defaultdict(list)
        for r in rows:
            if lo <= r[1] <= hi:
                cols[min(int((r[1] - lo) // ((hi - lo) / 16)), 15)].append((r[1], r[0], r[2], r[3]))
        got = {r["pixel"]: r for r in profile.line_profile(df, "x", F.col("v"), 16, F.col("c"), limits).collect()}
        assert got.keys() == cols.keys()
        for k, members in cols.items():
            v = [m[2] for m in sorted(members)]
            assert (got[k]["n"], got[k]["first"], got[k]["last"], got[k]["least"], got[k]["largest"]) == (len(v), v[0], v[-1], min(v), max(v))
            assert got[k]["color"] == pytest.approx(np.mean([m[3] for m in members]))
    one = profile.line_profile(df.where("node_id = 3"), "x", F.col("v"), 16).collect()
    assert len(one) == 1 and one[0]["pixel"] == 0 and one[0]["color"] is None
    assert profile.line_profile(df.limit(0), "x", F.col("v"), 16).count() == 0
    with pytest.raises(ValueError, match="axis"):
        profile.line_profile(df, "q", F.col("v"), 16)


def test_chunk_store_replaces_and_adds_single_chunks(spark, tmp_path):
    angle = [-math.pi + (k + 0.5) * 2 * math.pi / 80 for k in range(80)]
    points = spark.createDataFrame([(k, math.cos(a), math.sin(a), 1.0) for k, a in enumerate(angle)], "node_id long, x double, y double, w double")
    path = f"{tmp_path}/chunks"
    assert S.list_chunks(spark, path).count() == 0
    S.write_chunks(points.where("node_id < 40"), path, 7, 4, 0.0)
    S.write_chunks(points, path, 8, 2, 0.0)
    at = lambda: {(r["snapshot"], r["section"]): r["n"] for r in S.list_chunks(spark, path).collect()}
    assert at() == {(7, 0): 20, (7, 1): 20, (8, 0): 40, (8, 1): 40}
    S.write_chunks(points, path, 7, 4, 0.0)
    assert at() == {(7, k): 20 for k in range(4)} | {(8, 0): 40, (8, 1): 40}
    S.write_chunks(points.where("node_id BETWEEN 20 AND 24"), path, 7, 4, 0.0, replace=True)
    assert at()[7, 1] == 5 and at()[7, 0] == 20
    assert S.chunks_complete(S.read_chunks(spark, path, 7)) and not S.chunks_complete(S.read_chunks(spark, path, 7).where("chunk <> 2"))
    plan = S.list_chunks(spark, path, 7, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan and {r["section"] for r in S.list_chunks(spark, path, 7, 2).collect()} == {0, 1}


def brute_labels(cells, ahead):
    at, left = {c: k for k, c in enumerate(sorted(cells))}, set(cells)
    steps, out = [*ahead, *[(-y, -x) for y, x in ahead]], {}
    for c in sorted(cells):
        if c not in left:
            continue
        todo = [c]
        left.discard(c)
        while todo:
            y, x = todo.pop()
            out[y, x] = c
            for dy, dx in steps:
                if (y + dy, x + dx) in left:
                    left.discard((y + dy, x + dx))
                    todo.append((y + dy, x + dx))
    assert len(out) == len(at)
    return out


@pytest.mark.parametrize("side", [3, 8, 256])
@pytest.mark.parametrize("ahead", [graph.AHEAD_4, graph.AHEAD_8])
def test_tiles_label_as_a_flood_fill(spark, side, ahead):
    rng = random.Random(side)
    cells = {(y, x) for y in range(-5, 20) for x in range(30) if rng.random() < 0.55}
    cells |= {(y, 0) for y in range(-5, 20)} | {(19, x) for x in range(30)}  # a path through many tiles
    rows = [((y + 5) * 30 + x, y, x) for y, x in cells]
    df = spark.createDataFrame(rows + rows[:5], "node_id long, iy long, ix long").repartition(3)
    got = {r["node_id"]: r["component"] for r in tiles.label(df, ahead, side).collect()}
    assert got == {(y + 5) * 30 + x: (a + 5) * 30 + b for (y, x), (a, b) in brute_labels(cells, ahead).items()}
    assert tiles.label(df.limit(0), ahead, side).count() == 0


def test_union_follows_long_paths():
    n = 5000
    order = np.random.default_rng(3).permutation(n)
    assert (components.union(n, order[:-1], order[1:]) == 0).all()
    assert components.union(4, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("size, sigmas, side", [((9, 7), [1.0, 3.0], 4), ((40, 5), [2.0], 16), ((1, 6), [1.0], 512)])
def test_tiles_smooth_as_whole_lines(spark, size, sigmas, side):
    """Against a direct sum over reflected places, also where the kernel is longer than the raster."""
    h, w = size
    a = np.random.default_rng(4).random(size)
    df = spark.createDataFrame([(y * w + x, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "node_id long, iy long, ix long, v double")
    flip = lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    got = {(r["iy"], r["ix"]): r for r in tiles.smoothed(df, h, w, sigmas, side).collect()}
    assert len(got) == h * w
    for k, s in enumerate(sigmas):
        kern = tiles.kernel(s)
        reach = len(kern) // 2
        rows = sum(kern[d + reach] * a[:, [flip(x + d, w) for x in range(w)]] for d in range(-reach, reach + 1))
        want = sum(kern[d + reach] * rows[[flip(y + d, h) for y in range(h)]] for d in range(-reach, reach + 1))
        assert all(got[y, x][f"s{k}"] == pytest.approx(want[y, x], abs=1e-12) and got[y, x]["v"] == a[y, x] and got[y, x]["node_id"] == y * w + x for y in range(h) for x in range(w))


def test_smoothing_is_one_shuffle(spark):
    grid = raster.full_grid(spark.createDataFrame([(0, 1.0)], "node_id long, v double"), 4, 4)
    plan = raster.composed(grid, [1, 2], (4, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ty") == 1 and plan.count("FlatMapGroupsInArrow") == 1


def plain_lineage(cells, rounds, least):
    """Rounds of components and peeling by sets, 4-connected; outside the raster counts as inside."""
    work, members, parents, levels, last = set(cells), {}, set(), {}, {}
    for k in range(rounds):
        for c in work:
            levels[c] = k + 1
        roots = defaultdict(list)
        for c, r in brute_labels(work, graph.AHEAD_4).items():
            roots[r].append(c)
        comps = [roots[r] for r in sorted(roots) if len(roots[r]) >= least]
        if len(comps) < 2:
            break
        here = {c: i for i, comp in enumerate(comps) for c in comp}
        members |= {(k, i): frozenset(comp) for i, comp in enumerate(comps)}
        parents |= {(k - 1, last[c], k, i) for c, i in here.items() if c in last}
        last = here
        work = {(y, x) for y, x in work if all((y + dy, x + dx) in work or not (0 <= y + dy < 20 and 0 <= x + dx < 20) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        if not work:
            break
    return members, parents, levels


@pytest.mark.parametrize("seed, rounds, least", [(1, 5, 2), (2, 3, 1), (3, 2, 4), (4, 1, 1)])
def test_component_tree_equals_rounds_of_components(spark, seed, rounds, least):
    rng = random.Random(seed)
    cells = {(y, x) for y in range(20) for x in range(20)}
    for _ in range(14):
        y, x = rng.randrange(20), rng.randrange(20)
        cells -= {(y + dy, x + dx) for dy in range(-1, 2) for dx in range(-1, 2)} if rng.random() < 0.3 else {(y, k) for k in range(max(0, x - 6), x + 6)}
    edges = graph.grid_edges(spark, 20, 20, graph.AHEAD_4)
    inner = spark.createDataFrame([(y * 20 + x,) for y, x in cells], "node_id long")
    found = lineage.component_lineage(inner, edges, graph.adjacency(edges), rounds, least)
    members, parents, levels = plain_lineage(cells, rounds, least)
    got = defaultdict(set)
    for r in found.members.collect():
        got[r["iter"], r["cid"]].add((r["node_id"] // 20, r["node_id"] % 20))
    assert dict(got) == members
    assert {tuple(r) for r in found.parents.select("parent_iter", "parent_cid", "iter", "cid").collect()} == parents
    assert {(r["node_id"] // 20, r["node_id"] % 20): r["iter_label"] for r in found.levels.collect()} == levels
    assert {(r["iter"], r["cid"], r["size"]) for r in found.comps.collect()} == {(*k, len(v)) for k, v in members.items()}


def plain_merge(assigned, adj, isolated, edge, threshold, max_size, rounds=30):
    """Rounds as in the established order: decisions on one state, applied by ascending size and id."""
    skip = set(isolated)
    for _ in range(rounds):
        before = set(assigned.values())
        sizes = {g: sum(v == g for v in assigned.values()) for g in before}
        moves = []
        for g in sorted(before - skip, key=lambda g: (sizes[g], g)):
            mine = {n for n, v in assigned.items() if v == g}
            near = {m for n in mine for m in adj[n]} - mine
            touch = [assigned[m] for m in near if m in assigned]
            if not touch or sizes[g] > max_size:
                moves.append((g, None))
            elif (len(touch) + len(mine & edge)) / len(near) >= threshold:
                moves.append((g, min(set(touch), key=lambda t: (-touch.count(t), t))))
            else:
                moves.append((g, g))
        for g, to in moves:
            if to is None:
                skip.add(g)
            elif to != g:
                assigned = {n: to if v == g else v for n, v in assigned.items()}
        if len(set(assigned.values())) >= len(before):
            break
    return assigned


@pytest.mark.parametrize("seed", range(3))
def test_merging_on_contacts_equals_merging_nodes(spark, seed):
    rng = random.Random(seed)
    adj = defaultdict(set)
    for n in range(144):
        for dy, dx in ((0, 1), (1, 0)):
            if n // 12 + dy < 12 and n % 12 + dx < 12:
                m = (n // 12 + dy) * 12 + n % 12 + dx
                adj[n].add(m)
                adj[m].add(n)
    assigned = {n: (n // 12 // 3) * 4 + n % 12 // 3 for n in range(144) if rng.random() < 0.75}
    edge, isolated = {n for n in range(144) if n % 12 == 0}, [5]
    want = plain_merge(assigned, adj, isolated, edge, 0.3, 60)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = merge.merge_groups(
        table(list(assigned.items()), "node_id long, group_id long"), table([(n, m) for n in adj for m in adj[n]], "node long, nbr long"),
        table([(g,) for g in isolated], "group_id long"), table([(n,) for n in edge], "node_id long"), 0.3, 60,
    )
    assert {r["node_id"]: r["group_id"] for r in got.collect()} == want and len(set(want.values())) < len(set(assigned.values()))


def test_full_cells_are_split(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(0, 0.02, (60, 3)), rng.uniform(-1, 1, (80, 3))])
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "node_id long, x double, y double, z double")
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if ((p[i] - p[j]) ** 2).sum() < 0.3**2}
    for most in (graph.CELL_POINTS, 7):
        got = [tuple(r) for r in graph.radius_edges(df, 0.3, cell_points=most).collect()]
        assert len(got) == len(want) and set(got) == want
