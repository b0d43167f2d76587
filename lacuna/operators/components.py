"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lacuna.sources.staging import discard, stage

#: Edges of a contracted graph that one task may put together at the end (some 4 MB).
FINISH = 200_000


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes 0..n-1 that each can reach over the edges (a, b). Every pass hooks roots to smaller ones and halves them at least."""
    up = np.arange(n)
    while True:
        ra, rb = up[a], up[b]
        hook = ra != rb
        if not hook.any():
            return up
        np.minimum.at(up, np.maximum(ra, rb)[hook], np.minimum(ra, rb)[hook])
        while not np.array_equal(up, nxt := up[up]):
            up = nxt


def _finished(edges: DataFrame) -> DataFrame:
    """(node, component) of a small edge table (a, b), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        a, b = (np.concatenate([h.column(k).to_numpy(zero_copy_only=False) for h in held] or [np.zeros(0, np.int64)]) for k in range(2))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = union(len(ids), at[: len(a)], at[len(a) :])
        for k in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 50_000]), pa.array(ids[up[k : k + 50_000]])], names=["node", "component"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, component long")


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u with the least of itself and its neighbours, joined back to its neighbours.

    The minimum is a map-side combined aggregate; the join back is a plain equi-join, which AQE can
    split where one node has a large share of the edges.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (a, b) with a > b."""
    both = edges.selectExpr("a AS u", "b AS v").unionByName(edges.selectExpr("b AS u", "a AS v"))
    large = _star(both).where("v > u").selectExpr("v AS a", "m AS b")  # repeats go with the last distinct
    small = _star(large.selectExpr("a AS u", "b AS v"))
    kept = small.selectExpr("v AS a", "m AS b").unionByName(small.selectExpr("u AS a", "m AS b"))
    return kept.where("a > b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, finish: int = 0) -> DataFrame:
    """(node, component): component is the least node id that can be reached; only nodes with an edge appear.

    Self-loops, repeated and reversed edges and null ends are ignored; an empty table gives no rows.
    Rounds go on until nothing changes, each written to the shared folder so that lineage stays short. A table
    that has at most finish edges left (of integer nodes) is done in one task.
    """
    a, b = F.col(src), F.col(dst)
    mark, watch = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark"), Observation()
    once = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = stage(once.observe(watch, F.count(F.lit(1)).alias("n"), mark), "edges")
    seen = watch.get
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        if seen["n"] <= finish:
            return _finished(now)
        watch = Observation()
        nxt = stage(_round(now).observe(watch, F.count(F.lit(1)).alias("n"), mark), "edges")
        got = watch.get
        discard(now)
        now = nxt
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
