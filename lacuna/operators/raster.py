"""Raster operators on pixel tables (node_id, iy, ix, v): smoothing, morphology, alignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.masks import clean, is_valid
from lacuna.operators import tiles
from lacuna.operators.graph import AHEAD_4
from lacuna.operators.tiles import smoothed
from lacuna.sources.staging import stage

CROSS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def from_arrays(rows: DataFrame, width: int) -> DataFrame:
    """Pixels of a table (iy, values array): one row of the raster each."""
    return rows.select("iy", F.posexplode("values").alias("ix", "v")).select((F.col("iy") * width + F.col("ix")).cast("long").alias("node_id"), F.col("iy").cast("long"), F.col("ix").cast("long"), "v")


def region(pixels: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """Half-open cut-out, numbered anew from its own corner."""
    inside = pixels.where((F.col("iy") >= top) & (F.col("iy") < bottom) & (F.col("ix") >= left) & (F.col("ix") < right))
    moved = inside.withColumn("iy", F.col("iy") - top).withColumn("ix", F.col("ix") - left)
    return moved.withColumn("node_id", F.col("iy") * (right - left) + F.col("ix"))


def full_grid(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """All pixels of the raster; absent, NaN, infinite and negative values are 0."""
    n = F.col("id")
    grid = pixels.sparkSession.range(height * width).select(n.alias("node_id"), F.floor(n / width).alias("iy"), F.pmod(n, F.lit(width)).alias("ix"))
    return grid.join(pixels.select("node_id", "v"), "node_id", "left").withColumn("v", clean(F.col("v")))


def _size(grid: DataFrame, size: tuple[int, int] | None) -> tuple[int, int]:
    """(height, width) as given, or as the largest places say."""
    if size:
        return size
    last = grid.agg(F.max("iy"), F.max("ix")).first()
    return (last[0] + 1, last[1] + 1) if last[0] is not None else (0, 0)


def gaussian(grid: DataFrame, sigma: float, size: tuple[int, int] | None = None) -> DataFrame:
    """Full grid (of a known (height, width), or as large as its places) with v smoothed out to four sigma, reflected at the borders."""
    return smoothed(grid, *_size(grid, size), [sigma]).select("node_id", "iy", "ix", F.col("s0").alias("v"))


def _over_smoothed(grid: DataFrame, sigmas: list[int], size: tuple[int, int] | None) -> tuple[DataFrame, list]:
    """The pixels with all smoothed values, and the column v over each of them."""
    if not isinstance(sigmas, list) or not all(isinstance(s, int) for s in sigmas):
        raise TypeError("sigmas must be a list of integers")
    wide = smoothed(grid, *_size(grid, size), sigmas)
    return wide, [F.col("v") / (F.col(f"s{k}") + 1e-10) for k in range(len(sigmas))]


def normalized(grid: DataFrame, sigmas: list[int], size: tuple[int, int] | None = None) -> DataFrame:
    """(node_id, iy, ix, sigma, v): the full grid over its smoothed self, for each sigma, in one pass over its tiles."""
    wide, ratios = _over_smoothed(grid, sigmas, size)
    each = F.array(*[F.struct(F.lit(s).alias("sigma"), r.alias("v")) for s, r in zip(sigmas, ratios, strict=True)])
    return wide.select("node_id", "iy", "ix", F.explode(each).alias("e")).select("node_id", "iy", "ix", "e.sigma", "e.v")


def composed(grid: DataFrame, sigmas: list[int], size: tuple[int, int] | None = None) -> DataFrame:
    """Mean over the scales, which a tile takes itself."""
    wide, ratios = _over_smoothed(grid, sigmas, size)
    return wide.select("node_id", "iy", "ix", (sum(ratios[1:], ratios[0]) / len(ratios)).alias("v"))


def shifted(cells: DataFrame, around=CROSS) -> DataFrame:
    """(iy, ix) of all neighbours of cells."""
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around])
    return cells.select("iy", "ix", F.explode(shifts).alias("s")).select((F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"))


def erode(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Cells all of whose four neighbours inside the raster are cells too; outside counts as set."""
    inside = (F.col("iy") >= 0) & (F.col("iy") < height) & (F.col("ix") >= 0) & (F.col("ix") < width)
    holes = shifted(cells).where(inside).join(cells.select("iy", "ix"), ["iy", "ix"], "left_anti").distinct()
    return cells.join(shifted(holes), ["iy", "ix"], "left_anti")


def dilate(cells: DataFrame, height: int, width: int, times: int = 1) -> DataFrame:
    """(iy, ix) within so many steps to a side of cells."""
    steps = [(dy, dx) for dy in range(-times, times + 1) for dx in range(abs(dy) - times, times - abs(dy) + 1)]
    inside = (F.col("iy") >= 0) & (F.col("iy") < height) & (F.col("ix") >= 0) & (F.col("ix") < width)
    return shifted(cells, steps).where(inside).distinct()


def label(cells: DataFrame, ahead=AHEAD_4) -> DataFrame:
    """(node_id, component) of a set of pixels, labelled by tiles; 4-connected unless told otherwise."""
    return tiles.label(cells, ahead)


def fill_small_holes(grid: DataFrame, inner: str = "inner", area: int = 1800) -> DataFrame:
    """grid with inner set in every 4-connected false component of fewer than area pixels."""
    holes = stage(label(grid.where(~F.col(inner))), "holes")
    small = holes.groupBy("component").count().where(F.col("count") < area).select("component")
    filled = holes.join(small, "component").select("node_id", F.lit(True).alias("hole"))
    return grid.join(filled, "node_id", "left").withColumn(inner, F.col(inner) | F.coalesce("hole", F.lit(False))).drop("hole")


def fill_holes(grid: DataFrame, height: int, width: int, inner: str = "inner") -> DataFrame:
    """grid with inner set in every false component that does not touch the border."""
    holes = stage(label(grid.where(~F.col(inner))).join(grid.select("node_id", "iy", "ix"), "node_id"), "holes")
    border = (F.col("iy") == 0) | (F.col("iy") == height - 1) | (F.col("ix") == 0) | (F.col("ix") == width - 1)
    filled = holes.join(holes.where(border).select("component").distinct(), "component", "left_anti").select("node_id", F.lit(True).alias("hole"))
    return grid.join(filled, "node_id", "left").withColumn(inner, F.col(inner) | F.coalesce("hole", F.lit(False))).drop("hole")


def nonzero_box(pixels: DataFrame) -> DataFrame:
    """One row (top, bottom, left, right) of the pixels that are not 0, ends included."""
    return pixels.where("v <> 0").agg(F.min("iy").alias("top"), F.max("iy").alias("bottom"), F.min("ix").alias("left"), F.max("ix").alias("right"))


def moments(cells: DataFrame) -> DataFrame:
    """One row (syy, sxx, sxy): sample covariances of the pixel places."""
    return cells.agg(F.var_samp("iy").alias("syy"), F.var_samp("ix").alias("sxx"), F.covar_samp("iy", "ix").alias("sxy"))


def principal_angle(syy: float, sxx: float, sxy: float) -> float:
    """Angle atan2(row part, column part) of the first principal axis; of its two directions that with a positive column part."""
    return 0.5 * math.atan2(2 * sxy, sxx - syy)


def rotate(grid: DataFrame, height: int, width: int, degrees: float) -> tuple[DataFrame, int, int]:
    """(pixels, height, width) rotated about the centre, bilinear, 0 outside; the raster grows to hold the corners.

    Each output pixel asks for its four sources by an equi-join, and their weighted sum is one aggregate.
    """
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    corners = [(c * y + s * x, -s * y + c * x) for y in (0, height) for x in (0, width)]
    out_h = int(max(p[0] for p in corners) - min(p[0] for p in corners) + 0.5)
    out_w = int(max(p[1] for p in corners) - min(p[1] for p in corners) + 0.5)
    oy, ox = F.floor(F.col("id") / out_w), F.pmod("id", F.lit(out_w))
    dy, dx = oy - (out_h - 1) / 2, ox - (out_w - 1) / 2
    at = grid.sparkSession.range(out_h * out_w).select(
        F.col("id").alias("node_id"),
        oy.alias("oy"),
        ox.alias("ox"),
        (c * dy + s * dx + (height - 1) / 2).alias("y"),
        (-s * dy + c * dx + (width - 1) / 2).alias("x"),
    )
    eps = 1e-9
    inside = at.where((F.col("y") >= -eps) & (F.col("y") <= height - 1 + eps) & (F.col("x") >= -eps) & (F.col("x") <= width - 1 + eps))
    y0, x0 = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - y0, F.col("x") - x0
    taps = F.array(*[F.struct((y0 + j).alias("iy"), (x0 + i).alias("ix"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("w")) for j in (0, 1) for i in (0, 1)])
    asked = inside.select("node_id", F.explode(taps).alias("t")).select("node_id", "t.iy", "t.ix", "t.w").where("w > 0")
    got = asked.join(grid.select("iy", "ix", "v"), ["iy", "ix"]).groupBy("node_id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    out = at.join(got, "node_id", "left").select("node_id", F.col("oy").alias("iy"), F.col("ox").alias("ix"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return out, out_h, out_w


def align(pixels: DataFrame, height: int, width: int) -> tuple[DataFrame, int, int]:
    """(pixels, height, width) turned so that the filled valid area lies along an axis, and cropped to it."""
    grid = stage(full_grid(pixels, height, width), "grid")
    filled = fill_holes(grid.withColumn("inner", F.col("v") != 0), height, width)
    m = moments(filled.where("inner")).first()
    if m["syy"] is None:
        return grid, height, width
    turned, _, _ = rotate(grid, height, width, math.degrees(principal_angle(m["syy"], m["sxx"], m["sxy"])) - 90)
    turned = stage(turned, "turned")
    box = nonzero_box(turned).first()
    return region(turned, box["top"], box["bottom"] + 1, box["left"], box["right"] + 1), box["bottom"] + 1 - box["top"], box["right"] + 1 - box["left"]


def valid(pixels: DataFrame) -> DataFrame:
    return pixels.where(is_valid(F.col("v")))
