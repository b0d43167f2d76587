"""Chunk-wise scoring, the FITS source and the chunk store."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.jobs import extract
from lacuna.jobs.config import SnapshotConfig
from lacuna.jobs.queries import RADIUS, TOY
from lacuna.operators import gnn, graph
from lacuna.sources import fits, views
from lacuna.sources.staging import held_settings


def chunk_tables(spark, sf_dir):
    points = views.particles(spark, sf_dir).select("node_id", "id", "x", "y", "z", "density", "temperature", "mass")
    held = points.select(F.explode(F.array(*[F.when(F.pmod("node_id", F.lit(3)) != k, F.lit(k)) for k in range(3)])).alias("chunk"), "node_id").where("chunk IS NOT NULL")
    return points, held, graph.chunk_edges(graph.radius_edges(points, RADIUS), held)


def test_a_chunk_scores_as_its_own_graph(spark, sf_dir):
    """Each chunk by forward() on its own, and the highest chunk of a node."""
    points, held, edges = chunk_tables(spark, sf_dir)
    names, want = ["density", "temperature"], {}
    for k in range(3):
        mine = held.where(f"chunk = {k}").join(points, "node_id")
        adj = graph.adjacency(graph.canonical_edges(edges.where(f"chunk = {k}")))
        for r in gnn.softmax_score(gnn.forward(mine, adj, names, TOY)).collect():
            want[r["node_id"]] = r["score"]
    noisy = edges.unionByName(edges.select("chunk", F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(edges.select("chunk", "src", F.col("src").alias("dst")))
    noisy = noisy.unionByName(edges.select("chunk", "src", F.lit(-5).cast("long").alias("dst")).limit(9))  # repeats, loops and absent ends
    for rows in (gnn.LOCAL_ROWS, 0):  # dealt by chunk, and by chunk and node
        got = {r["node_id"]: r["score"] for r in gnn.score_chunks(points, held.unionByName(held.limit(20)), noisy, names, TOY, rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert gnn.score_chunks(points.limit(0), held, edges, names, TOY).count() == 0


def test_rounds_of_a_chunk_do_not_shuffle(spark, sf_dir):
    points, held, edges = chunk_tables(spark, sf_dir)
    nodes = held.join(points, "node_id").select("chunk", "node_id", "density")
    w = gnn.Weights.from_dict({**{k: getattr(TOY, k) for k in TOY.__dataclass_fields__}, "root": TOY.root[:, :1], "rel": TOY.rel[:, :1]})
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    quiet = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    # Tables without a plan of their own, so that every exchange is the operator's.
    flat = spark.createDataFrame([], "chunk int, node_id long, density double"), spark.createDataFrame([], "chunk int, src long, dst long")
    with held_settings(spark, quiet):
        plan = gnn.forward_in_chunks(*flat, ["density"], w)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(chunk#" in line and "REPARTITION_BY" in line and "node_id" not in line.split("hashpartitioning")[1].split("]")[0] for line in exchanges)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before and nodes.columns


def test_scores_are_saved_and_reused(spark, sf_dir, tmp_path):
    points, held, edges = chunk_tables(spark, sf_dir)
    args = (points, held, edges, ["density"], gnn.Weights.from_dict({**{k: getattr(TOY, k) for k in TOY.__dataclass_fields__}, "root": TOY.root[:, :1], "rel": TOY.rel[:, :1]}))
    config = SnapshotConfig(z_bin_size=0.05, r_bin_size=0.05)
    first = {r["node_id"]: r["score"] for r in extract.classify_chunks(*args, config, f"{tmp_path}/s", {"model": "a"}).collect()}
    none = (points, held.limit(0), edges.limit(0), *args[3:])  # would score 0 everywhere if it were computed
    low = SnapshotConfig(z_bin_size=0.05, r_bin_size=0.05, detection_threshold=-1.0)
    again = extract.classify_chunks(*none, low, f"{tmp_path}/s", {"model": "a"}).collect()
    assert {r["node_id"]: r["score"] for r in again} == first and all(r["inner"] for r in again)
    assert any(first.values())
    forced = extract.classify_chunks(*none, config, f"{tmp_path}/s", {"model": "a"}, force=True).collect()
    assert not any(r["score"] for r in forced)


def fits_file(path, data, extra=(), ext=False):
    """A minimal image by hand: cards, big-endian data, padding."""
    bits = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}[data.dtype.str[1:]]
    cards = [("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)] if ext else []
    out = b""
    if ext:
        out = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards).encode() + b"END"
        out = out.ljust(2880)
    cards = [("XTENSION", "'IMAGE   '") if ext else ("SIMPLE", "T"), ("BITPIX", bits), ("NAXIS", 2), ("NAXIS1", data.shape[1]), ("NAXIS2", data.shape[0]), ("PCOUNT", 0), ("GCOUNT", 1), *extra]
    head = ("".join(f"{k:<8}= {v:>20} / a comment".ljust(80) for k, v in cards) + "END").encode()
    body = data.astype(data.dtype.newbyteorder(">")).tobytes()
    path.write_bytes(out + head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0"))
    return str(path)


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "i8", "f4", "f8"])
@pytest.mark.parametrize("region", [None, np.s_[3:9, 2:5], np.s_[-4:], np.s_[2:2, :], np.s_[:, 30:99]])
def test_fits_regions_are_numpy_slices(spark, tmp_path, kind, region):
    data = np.arange(12 * 40).reshape(12, 40).astype(kind)
    pixels, height, width = fits.read_fits(spark, fits_file(tmp_path / "a.fits", data, ext=kind == "i4"), region)
    want = data[region] if region is not None else data
    assert (height, width) == want.shape
    rows = pixels.collect()
    assert len(rows) == want.size and all(r["v"] == want[r["iy"], r["ix"]] and r["node_id"] == r["iy"] * width + r["ix"] for r in rows)


def test_fits_scale_blank_and_errors(spark, tmp_path):
    path = fits_file(tmp_path / "a.fits", np.array([[1, 2], [3, -9]], "i2"), [("BSCALE", 0.5), ("BZERO", 10.0), ("BLANK", -9)])
    got = {(r["iy"], r["ix"]): r["v"] for r in fits.read_fits(spark, path)[0].collect()}
    assert got[0, 0] == 10.5 and got[1, 0] == 11.5 and math.isnan(got[1, 1])
    with pytest.raises(TypeError, match="slice"):
        fits.read_fits(spark, path, [0, 1])
    with pytest.raises(TypeError, match="steps"):
        fits.read_fits(spark, path, np.s_[::2])
    (tmp_path / "b.fits").write_bytes(b"SIMPLE  =                    T".ljust(80) + b"END".ljust(2800))
    with pytest.raises(ValueError, match="no image"):
        fits.read_fits(spark, f"{tmp_path}/b.fits")
    (tmp_path / "c.fits").write_bytes(b"SIMPLE")
    with pytest.raises(ValueError, match="no end"):
        fits.read_fits(spark, f"{tmp_path}/c.fits")


def test_a_region_reads_only_its_bytes(tmp_path, monkeypatch):
    path = fits_file(tmp_path / "a.fits", np.zeros((500, 300), "f8"))
    size = lambda region, **more: sum(n for p in fits.Reader({"path": path, "region": region, **more}).partitions() for _, n in p.ranges())
    assert size(None) == 500 * 300 * 8 and size("100:110") == 10 * 300 * 8
    assert size("100:110,50:60") < 10 * 300 * 8  # short rows: one run
    monkeypatch.setattr(fits, "WIDE_ROW", 100)
    assert size("100:110,50:60") == 10 * 10 * 8
    parts = fits.Reader({"path": path, "region": "90:410", "partitionbytes": "24000"}).partitions()
    assert [(p.low, p.high) for p in parts] == [(k, k + 10) for k in range(90, 410, 10)]


def test_fits_bands_round_trip(spark, tmp_path):
    rows = [(iy, ix, float(iy * 100 + ix)) for iy in range(23) for ix in range(7) if (iy + ix) % 3 and not 8 <= iy < 14]
    odd = [(-1, 0, 1.0), (0, 99, 1.0), (2, 2, None), (0, 1, -7.0)]  # outside, null, repeated
    pixels = spark.createDataFrame(rows + odd, "iy long, ix long, v double").repartition(5)
    fits.write_fits(pixels, f"{tmp_path}/bands", 23, 7, 5)
    assert len(fits.images(f"{tmp_path}/bands")) == 5
    want = {(iy, ix): v for iy, ix, v in rows}
    got = fits.read_fits(spark, f"{tmp_path}/bands")[0].collect()
    assert len(got) == 23 * 7 and all(r["v"] == want[r["iy"], r["ix"]] if (r["iy"], r["ix"]) in want else math.isnan(r["v"]) for r in got)
    cut, height, width = fits.read_fits(spark, f"{tmp_path}/bands", np.s_[4:11, 1:3])
    assert (height, width, cut.count()) == (7, 2, 14)
    fits.write_fits(pixels.limit(0), f"{tmp_path}/none", 0, 7)
    assert fits.read_fits(spark, f"{tmp_path}/none")[0].count() == 0
