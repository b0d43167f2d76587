"""Rasters by square tiles: what a tile can settle alone is settled in arrays, and only its border or halo is shared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.components import FINISH, connected_components, union
from lacuna.sources.staging import small, stage

#: Side of a tile that is labelled, and of one that is smoothed (its halo, the kernel's reach, comes on top).
LABEL_TILE, SMOOTH_TILE = 256, 512


def _tile(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side)


def _place(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def label(cells: DataFrame, ahead, side: int = LABEL_TILE) -> DataFrame:
    """(node_id, component) of a set of pixels (node_id, iy, ix): component is the least node id that neighbour steps reach.

    ahead: half of the neighbourhood. Each tile is labelled by union-find over its own pixels. Only pixels on tile borders are joined
    with those across, which gives edges between the tiles' components; their components are found on that much smaller graph.
    A tile holds at most side * side places. Repeated pixels keep their rows; an empty set gives none.
    """

    def one(table: pa.Table) -> pa.Table:
        iy, ix, node = (_place(table[c]) for c in ("iy", "ix", "node_id"))
        y, x = iy % side, ix % side
        places, at = np.unique(y * side + x, return_inverse=True)
        y, x = places // side, places % side
        number = np.full(side * side, -1)
        number[places] = np.arange(len(places))
        pairs = []
        for dy, dx in ahead:
            inside = (y + dy >= 0) & (y + dy < side) & (x + dx >= 0) & (x + dx < side)
            there = np.full(len(places), -1)
            there[inside] = number[(y + dy)[inside] * side + (x + dx)[inside]]
            pairs.append(np.stack([np.flatnonzero(there >= 0), there[there >= 0]]))
        up = union(len(places), *np.concatenate(pairs, axis=1))[at]
        least = np.full(len(places), np.iinfo(np.int64).max)
        np.minimum.at(least, up, node)
        return pa.table({"node_id": node, "iy": iy, "ix": ix, "root": least[up]})

    longs = cells.select(*[F.col(c).cast("long").alias(c) for c in ("node_id", "iy", "ix")])
    dealt = longs.groupBy(_tile("iy", side).alias("ty"), _tile("ix", side).alias("tx"))
    local = stage(dealt.applyInArrow(one, "node_id long, iy long, ix long, root long"), "tiles")
    ends = [F.pmod(c, F.lit(side)).isin(0, side - 1) for c in ("iy", "ix")]
    rim = local.where(ends[0] | ends[1])
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ahead])
    moved = rim.select(F.col("root").alias("a"), "iy", "ix", F.explode(shifts).alias("s")).select("a", (F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"), _tile("iy", side).alias("ty"), _tile("ix", side).alias("tx"))
    across = moved.where((_tile("iy", side) != F.col("ty")) | (_tile("ix", side) != F.col("tx")))
    pairs = across.join(rim.select(F.col("root").alias("b"), "iy", "ix"), ["iy", "ix"]).select("a", "b")
    found = stage(connected_components(pairs, "a", "b", finish=FINISH).select(F.col("node").alias("root"), "component"), "components")
    return local.join(small(found), "root", "left").select("node_id", F.coalesce("component", "root").alias("component"))


def kernel(sigma: float) -> np.ndarray:
    """Normalised Gaussian weights out to four sigma."""
    reach = int(4.0 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def _band(w: np.ndarray, first: int, last: int, low: int, high: int, n: int) -> np.ndarray:
    """(high - low, last - first): what each line of low..high gives to those of first..last, half-sample reflected at 0 and n."""
    reach, out = len(w) // 2, np.zeros((high - low, last - first))
    at = np.arange(first, last)
    for k in range(-reach, reach + 1):
        p = (at + k) % (2 * n)
        np.add.at(out, (np.where(p < n, p, 2 * n - 1 - p) - low, at - first), w[k + reach])
    return out


def smoothed(pixels: DataFrame, height: int, width: int, sigmas: list[float], side: int = SMOOTH_TILE) -> DataFrame:
    """(node_id, iy, ix, v, s0, s1, ...) of all pixels of the raster: v as given (absent: 0) and smoothed by each sigma.

    Every pixel is dealt to its own tile and to those whose halo, the largest kernel's reach, it lies in: one shuffle for all
    sigmas, and a task holds a tile with its halo at a time, never a line. Each tile is smoothed by two matrix
    products with the kernel's band, reflection included. v must be there and finite, as in a full grid. Repeated pixels: the last counts.
    """
    kernels = [kernel(s) for s in sigmas]
    reach = max(len(w) // 2 for w in kernels)
    names = ["node_id", "iy", "ix", "v", *[f"s{k}" for k in range(len(sigmas))]]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        (y0, x0) = (int(k.as_py()) * side for k in key)
        y1, x1 = min(y0 + side, height), min(x0 + side, width)
        ylow, yhigh, xlow, xhigh = max(0, y0 - reach), min(height, y1 + reach), max(0, x0 - reach), min(width, x1 + reach)
        a = np.zeros((yhigh - ylow, xhigh - xlow))
        a[_place(table["iy"]) - ylow, _place(table["ix"]) - xlow] = table["v"].to_numpy()
        iy, ix = np.repeat(np.arange(y0, y1), x1 - x0), np.tile(np.arange(x0, x1), y1 - y0)
        out = [iy * width + ix, iy, ix, a[y0 - ylow : y1 - ylow, x0 - xlow : x1 - xlow].ravel()]
        for w in kernels:
            out.append((_band(w, y0, y1, ylow, yhigh, height).T @ (a @ _band(w, x0, x1, xlow, xhigh, width))).ravel())
        return pa.table(dict(zip(names, out, strict=True)))

    def tiles(c: str, n: int) -> Column:
        """Tiles whose lines, or halo, a line is in."""
        last = (n - 1) // side
        return F.sequence(F.greatest(F.floor((F.col(c) - reach) / side), F.lit(0)), F.least(F.floor((F.col(c) + reach) / side), F.lit(last)))

    inside = pixels.where((F.col("iy") >= 0) & (F.col("iy") < height) & (F.col("ix") >= 0) & (F.col("ix") < width))
    rows = inside.select(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.col("v").cast("double").alias("v"))
    dealt = rows.withColumn("ty", F.explode(tiles("iy", height))).withColumn("tx", F.explode(tiles("ix", width)))
    schema = "node_id long, iy long, ix long, " + ", ".join(f"{n} double" for n in names[3:])
    return dealt.groupBy("ty", "tx").applyInArrow(one, schema)
