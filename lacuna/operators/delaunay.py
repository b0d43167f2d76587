"""Delaunay edges of azimuthal chunks: each chunk is tessellated by itself, with a halo of its neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.masks import with_chunks
from lacuna.operators.graph import canonical_edges

_FACES = np.array([[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]])


def _spheres(p: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Circumcentres and squared radii; flat cells get an endless one."""
    a = p[cells[:, 0]]
    m = p[cells[:, 1:]] - a[:, None, :]
    flat = np.abs(np.linalg.det(m)) < 1e-14
    m[flat] = np.eye(3)
    c = np.linalg.solve(2 * m, (m**2).sum(2)[:, :, None])[:, :, 0]
    r2 = (c**2).sum(1)
    r2[flat] = np.inf
    return a + c, r2


def delaunay_edges(points: np.ndarray) -> np.ndarray:
    """Index pairs (i < j) of the Delaunay tetrahedra of points (n, 3), by incremental insertion.

    Exactly repeated points keep the first; under four points all pairs are returned.
    """
    n = len(points)
    if n < 5:
        return np.array([(i, j) for i in range(n) for j in range(i + 1, n)], np.int64).reshape(-1, 2)
    low, span = points.min(0), float(np.ptp(points, axis=0).max()) or 1.0
    scaled = (points - low) / span
    far = 50.0
    p = np.concatenate([scaled, far * np.array([[-1.0, -1, -1], [3, -1, -1], [-1, 3, -1], [-1, -1, 3]]) + 0.5])
    cells = np.array([[n, n + 1, n + 2, n + 3]])
    centre, r2 = _spheres(p, cells)
    for i in np.unique(scaled, axis=0, return_index=True)[1]:
        hit = ((centre - p[i]) ** 2).sum(1) < r2 * (1 + 1e-12)
        faces = np.sort(cells[hit][:, _FACES].reshape(-1, 3), axis=1)
        faces, count = np.unique(faces, axis=0, return_counts=True)
        border = faces[count == 1]
        new = np.concatenate([border, np.full((len(border), 1), i)], axis=1)
        c, r = _spheres(p, new)
        cells, centre, r2 = np.concatenate([cells[~hit], new]), np.concatenate([centre[~hit], c]), np.concatenate([r2[~hit], r])
    real = cells[(cells < n).all(1)]
    pairs = np.concatenate([real[:, [a, b]] for a in range(4) for b in range(a + 1, 4)])
    return np.unique(np.sort(pairs, axis=1), axis=0)


def chunk_edges(points: DataFrame, chunks: int, padding: float = 0.005) -> DataFrame:
    """Canonical edges (src, dst) of all chunks together; an edge of two halo points belongs to another chunk.

    A task holds one chunk with its halo, so chunks must be as many as keep that in its memory.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        e = delaunay_edges(pdf[["x", "y", "z"]].to_numpy())
        own, ids = pdf["own"].to_numpy(), pdf["node_id"].to_numpy()
        e = e[own[e[:, 0]] | own[e[:, 1]]]
        return pd.DataFrame({"src": ids[e[:, 0]], "dst": ids[e[:, 1]]})

    spread = with_chunks(points.select("node_id", "x", "y", "z"), chunks, padding)
    return canonical_edges(spread.groupBy(F.col("chunk")).applyInPandas(build, "src long, dst long"))
