"""The network on radius graphs of which no pair is written."""

import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.jobs.queries import QUERIES, RADIUS, TOY
from lacuna.operators import ball, gnn, graph
from lacuna.sources import views
from lacuna.sources.staging import shared_dir


def weights(**more):
    return gnn.Weights.from_dict({**{k: getattr(TOY, k) for k in TOY.__dataclass_fields__}, **more})


def brute(rows, r, w):
    """Outputs by loops over (x, y, z, values) rows."""
    n, width = len(rows), len(rows[0][3])
    far = lambda a, b: any(v is None for v in (*a[:3], *b[:3])) or not sum((p - q) * (p - q) for p, q in zip(a[:3], b[:3], strict=True)) < r * r
    nbrs = [[j for j in range(n) if j != i and not far(rows[i], rows[j])] for i in range(n)]
    hidden, out = [], []
    for i, row in enumerate(rows):
        means = []
        for k in range(width):
            met = [rows[j][3][k] for j in nbrs[i] if rows[j][3][k] is not None]
            means.append(sum(met) / len(met) if met else 0.0)
        if any(v is None for v in row[3]):
            hidden.append(np.zeros(len(w.bias)))
            continue
        h = w.root @ np.array(row[3]) + w.rel @ np.array(means) + w.bias
        hidden.append(np.maximum((h - w.mean) / np.sqrt(w.var + w.eps) * w.gamma + w.beta, 0))
    heads, outs = w.attention.shape
    left, right = ([(m @ h + b).reshape(heads, outs) for h in hidden] for m, b in ((w.left, w.left_bias), (w.right, w.right_bias)))
    for i in range(n):
        each = []
        for h in range(heads):
            sums = [left[j][h] + right[i][h] for j in (i, *nbrs[i])]
            e = np.array([(np.where(s > 0, s, s * w.slope) * w.attention[h]).sum() for s in sums])
            a = np.exp(e - e.max())
            each.append(sum(v * left[j][h] for v, j in zip(a, (i, *nbrs[i]), strict=True)) / a.sum())
        out.append((np.concatenate(each) if w.concat else sum(each) / heads) + w.last)
    return out


def places(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(*rng.normal(0, 0.15, 3).tolist(), rng.normal(1, 1, 2).tolist()) for _ in range(n)]
    rows[5] = (*rows[4][:3], rows[5][3])  # the same place
    for k, at in enumerate([(math.nan, 0.0, 0.0), (None, 0.0, 0.0), (math.inf, 0.0, 0.0), (-math.inf, 0.0, 0.0), (1e300, 0.0, 0.0), (1e300, 0.0, 0.0), (math.inf, 0.0, 0.0)]):
        rows[k + 10] = (*at, rows[k + 10][3])
    return rows


def test_a_radius_equals_its_edges(spark, sf_dir):
    points, names = views.particles(spark, sf_dir), ["density", "temperature"]
    want = {r["node_id"]: (r["o0"], r["o1"]) for r in gnn.forward(points, graph.adjacency(graph.radius_edges(points, RADIUS)), names, TOY).collect()}
    got = {r["node_id"]: (r["o0"], r["o1"]) for r in gnn.forward(points, graph.Within(RADIUS), names, TOY).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    assert gnn.forward(points.limit(0), graph.Within(RADIUS), names, TOY).count() == 0


@pytest.mark.parametrize("kind", ["small", "large", "joined"])
def test_odd_points_in_small_blocks(spark, monkeypatch, kind):
    """Cells in parts and blocks of few points; nulls, no place, equal places, infinite places; logits beyond the powers of float64."""
    monkeypatch.setattr(ball, "BLOCK", 16)
    monkeypatch.setattr(ball, "CELL_POINTS", 40)
    w = {"small": TOY, "large": weights(attention=TOY.attention * 400), "joined": weights(concat=True, last=np.arange(4.0), slope=1.5)}[kind]
    rows = places(300)
    rows[20] = (*rows[20][:3], [None, 1.0])
    rows[21] = (*rows[21][:3], [1.0, None])
    df = spark.createDataFrame([(i, *p[:3], *p[3]) for i, p in enumerate(rows)], "node_id long, x double, y double, z double, u double, v double").repartition(5)
    got = {r["node_id"]: [r[f"o{k}"] for k in range(len(w.last))] for r in ball.forward(df, 0.1, ["u", "v"], w).collect()}
    for i, want in enumerate(brute(rows, 0.1, w)):
        assert np.allclose(got[i], want, rtol=1e-9, atol=1e-12), i


def test_nan_reaches_only_neighbours(spark):
    rows = [(0, 0.0, 0.0, 0.0, math.nan), (1, 0.05, 0.0, 0.0, 1.0), (2, 0.13, 0.0, 0.0, 1.0), (3, 0.5, 0.0, 0.0, 1.0), (4, 0.21, 0.0, 0.0, 2.0), (5, 0.3, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "node_id long, x double, y double, z double, v double")
    got = {r["node_id"]: r["o0"] for r in ball.forward(df, 0.1, ["v"], weights(root=TOY.root[:, :1], rel=TOY.rel[:, :1])).collect()}
    assert [math.isnan(got[k]) for k in range(6)] == [True, True, True, False, False, False]  # two steps: the means, then the attention


@pytest.mark.parametrize("kind", [ball._Powers, ball._Shifted])
def test_senders_by_and_by(monkeypatch, kind):
    """Blocks that meet in many small arrays give the sums of all at once; distances near the radius are exact."""
    monkeypatch.setattr(ball, "CHUNK", 7)
    monkeypatch.setattr(ball, "HELD", 100)
    rng = np.random.default_rng(5)
    pos = np.round(rng.random((3, 500)) * 8) / 32  # many distances of exactly 8 / 32
    values = rng.normal(size=(4, 500))
    blocks = [np.arange(k, k + 125) for k in range(0, 500, 125)]
    blocks = [b[ball._order(pos[:, b], ball.LEAF)] for b in blocks]
    row = lambda b, sent: {"ids": b.astype(np.int64).tobytes(), "pos": pos[:, b].tobytes(), "sent": sent[:, b].tobytes(), "got": values[::-1][:, b].tobytes()}
    closer = ((pos[:, :, None] - pos[:, None]) ** 2).sum(0) < 0.25**2
    np.fill_diagonal(closer, False)
    sent = np.concatenate([values[:2], np.ones((2, 500))])
    for mine in blocks:
        means, attention = ball._Means(row(mine, sent), 0.25, TOY), kind(row(mine, values), 0.25, TOY)
        for b in [mine, *(b for b in blocks if b is not mine)]:
            means.send(row(b, sent))
            attention.send(row(b, values))
        means.meet()
        attention.meet()
        assert np.allclose(means.sums, (closer[mine] @ sent.T)) and (means.sums[:, 2] == closer[mine].sum(1)).all()
        z, s = attention.ended()
        found = s / z[:, None]
        for i, p in enumerate(mine):
            near = np.append(np.flatnonzero(closer[p]), p)
            for h in range(2):
                e = attention.logit(h, values.reshape(2, 2, -1)[h][:, near], values[::-1].reshape(2, 2, -1)[h][:, p, None])
                a = np.exp(e - e.max())
                assert np.allclose(found[h, :, i], (a * values.reshape(2, 2, -1)[h][:, near]).sum(1) / a.sum())


@pytest.mark.parametrize("name", ["classify_particles", "chunk_scores_cached", "classify_chunk_tables", "gnn_softmax"])
def test_no_pair_is_written(spark, tmp_path, name):
    """300 points next to each other have 44,850 pairs; no written table has more than a few rows a point."""
    rng = np.random.default_rng(7)
    rows = [(i, [*(0.02 * rng.random(3) + [0.2, 0.1, 0.1]).tolist(), *(0.1 * rng.normal(size=3)).tolist()]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/lacuna/*"))
    assert QUERIES[name](spark, str(tmp_path)).where(F.col("score") > 0).count() == 300
    tables = [p for p in set(glob.glob(f"{shared_dir(spark)}/lacuna/*")) - before if not p.endswith("_attributes")]
    assert tables and max(spark.read.parquet(p).count() for p in tables) <= 3 * 300
