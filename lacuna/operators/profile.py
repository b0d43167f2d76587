"""Feature normalisation: mass-weighted (R, z) profiles, robust scaling, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.masks import radius
from lacuna.functions.names import fresh
from lacuna.sources.staging import BROADCAST_ROWS, small, stage

QUANTITIES = ("density", "temperature")


def bin_edges(points: DataFrame, z_size: float = 0.05, r_size: float = 2.0) -> DataFrame:
    """One row (r_min, r_width, r_bins, z_min, z_width, z_bins): equal bins of about the given sizes over the range."""
    r = radius(F.col("x"), F.col("y"))
    lim = points.agg(F.min(r).alias("r_min"), F.max(r).alias("r_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    for a, size in (("r", r_size), ("z", z_size)):
        span = F.col(f"{a}_max") - F.col(f"{a}_min")
        lim = lim.withColumn(f"{a}_bins", F.greatest(F.lit(1), F.ceil(span / size))).withColumn(f"{a}_width", span / F.col(f"{a}_bins"))
    return lim.select("r_min", "r_width", "r_bins", "z_min", "z_width", "z_bins")


def _place(v: Column, a: str, held: str) -> Column:
    """Bin number by the edges in the struct held; the last bin is closed at its upper end, and what lies outside goes to the nearest bin."""
    of = lambda x: F.col(held).getField(f"{a}_{x}")
    at = F.when(of("width") > 0, F.floor((v - of("min")) / of("width"))).otherwise(0)
    return F.greatest(F.lit(0), F.least(at, of("bins") - 1)).cast("long")


def _binned(points: DataFrame, edges: DataFrame, r_bin: str = "r_bin", z_bin: str = "z_bin") -> DataFrame:
    """points with the bin numbers under the given names; edges is one row."""
    (held,) = fresh([*points.columns, r_bin, z_bin], "edges")
    both = points.crossJoin(F.broadcast(edges.select(F.struct("*").alias(held))))
    return both.withColumns({r_bin: _place(radius(F.col("x"), F.col("y")), "r", held), z_bin: _place(F.col("z"), "z", held)}).drop(held)


def with_bins(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points with r_bin and z_bin; edges is one row."""
    return _binned(points, edges)


def profile(points: DataFrame, quantity: str, edges: DataFrame) -> DataFrame:
    """(r_bin, z_bin, mass, mean): mass-weighted mean of a quantity in each bin that has any."""
    if quantity not in QUANTITIES:
        raise ValueError(f"unknown quantity {quantity!r}; known are {', '.join(QUANTITIES)}")
    mass = F.sum("mass")
    return with_bins(points, edges).groupBy("r_bin", "z_bin").agg(mass.alias("mass"), F.try_divide(F.sum(F.col("mass") * F.col(quantity)), mass).alias("mean"))


def corrected(points: DataFrame, quantity: str, edges: DataFrame, means: DataFrame, out: str = "log_ratio") -> DataFrame:
    """points with out: log of the quantity over the mean of its bin; null where either isn't positive.

    A profile has at most r_bins * z_bins rows whatever the number of points; the optimizer broadcasts
    it while it is small.
    """
    rb, zb, mean, ratio = fresh([*points.columns, out], "r_bin", "z_bin", "mean", "ratio")
    joined = _binned(points, edges, rb, zb).join(means.select(F.col("r_bin").alias(rb), F.col("z_bin").alias(zb), F.col("mean").alias(mean)), [rb, zb], "left")
    joined = joined.withColumn(ratio, F.try_divide(F.col(quantity), F.col(mean)))
    return joined.withColumn(out, F.when(F.col(ratio) > 0, F.ln(ratio))).drop(rb, zb, mean, ratio)


def robust_fit(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., center, scale): exact median and interquartile range, interpolated; a scale of 0 becomes 1."""
    got = _percentiles(df, column, by or [], (0.25, 0.5, 0.75))
    iqr = F.col("q2") - F.col("q0")
    return got.select(*(F.col(f"g{k}").alias(c) for k, c in enumerate(by or [])), F.col("q1").alias("center"), F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


#: Rank error of the sketch is at most one in so many; brackets reach twice as far to both sides.
ACCURACY = 10_000


def _percentiles(df: DataFrame, column: str, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(g0, g1, ..., q0, q1, ...), staged: as F.percentile by group, nulls left out; null for a group of nothing else.

    A mergeable sketch brackets each share's value in every group. One count follows: values inside a bracket each for
    itself, and each stretch between brackets with its size and both ends. So the ranks stay exact while only
    a few ten-thousandths of the rows are sorted. Should a rank fall inside a stretch after all, every value is counted.
    """
    g = [f"g{k}" for k in range(len(by))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(by, g, strict=True)), F.col(column).cast("double").alias("v"))
    wide = 2.0 / ACCURACY
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in (-wide, wide)]
    cuts = stage(rows.groupBy(*g).agg(F.percentile_approx("v", asked, ACCURACY).alias("cut"), F.count("v").alias("total")), "cuts")
    for bracketed in (True, False):
        counted = stage(_counted(rows, cuts, g, len(shares), bracketed), "counted")
        found = stage(_ranked(counted, cuts, g, shares), "ranks")
        if not bracketed or not found.where("missed").take(1):
            break
    return found.drop("missed")


def _same(g: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for n in g:
        same = same & F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return same


def _renamed(df: DataFrame, g: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"{prefix}{n}" for n in g})


def _counted(rows: DataFrame, cuts: DataFrame, g: list[str], shares: int, bracketed: bool) -> DataFrame:
    """(g..., key, between, n, low, high): counted values, and the counted stretches after the value key (null: from the start) where between is 1."""
    v = F.col("v")
    rows = rows.where(v.isNotNull())
    if not bracketed:
        return rows.groupBy(*g, v.alias("key"), F.lit(0).alias("between")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    held = small(_renamed(cuts.drop("total"), g, "of_"))
    both = rows.join(held, _same(g, "of_")) if g else rows.crossJoin(F.broadcast(cuts.select("cut")))
    inside, before = F.lit(False), F.lit(None).cast("double")
    for k in range(shares):
        low, high = F.get("cut", F.lit(2 * k)), F.get("cut", F.lit(2 * k + 1))
        inside = inside | ((v >= low) & (v <= high))
        before = F.when(high < v, F.when(before.isNull() | (before < high), high).otherwise(before)).otherwise(before)
    key, between = F.when(inside, v).otherwise(before), F.when(inside, 0).otherwise(1)
    return both.groupBy(*g, key.alias("key"), between.alias("between")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def _ranked(counted: DataFrame, cuts: DataFrame, g: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(g..., q..., missed): the shares' values by rank; missed if a rank lies inside a stretch."""
    order = [F.asc_nulls_first("key"), F.asc("between")]
    if counted.count() <= BROADCAST_ROWS:
        ended = counted.withColumn("end", F.sum("n").over(Window.partitionBy(*g).orderBy(*order)))
    else:  # many values: numbered by ranges, and the ranges shifted, so that no task holds a group
        parts = max(1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ranged = stage(counted.repartitionByRange(parts, *g, *order).withColumn("part", F.spark_partition_id()), "ranged")
        inside = ranged.withColumn("inside", F.sum("n").over(Window.partitionBy("part", *g).orderBy(*order)))
        sizes = _renamed(ranged.groupBy("part", *g).agg(F.sum("n").alias("size")), [*g, "part"], "in_")  # a row for each range and each group in it
        earlier = Window.partitionBy(*(f"in_{n}" for n in g)).orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
        shift = sizes.withColumn("shift", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        ended = inside.join(shift, _same([*g, "part"], "in_")).withColumn("end", F.col("shift") + F.col("inside")).select(*counted.columns, "end")
    totals = small(_renamed(cuts.drop("cut"), g, "of_"))
    ended = ended.join(totals, _same(g, "of_")) if g else ended.crossJoin(F.broadcast(cuts.select("total")))

    def at(rank: Column) -> Column:
        value = F.when((F.col("low") == F.col("high")) | (rank == F.col("end") - F.col("n")), F.col("low")).when(rank == F.col("end") - 1, F.col("high"))
        return F.max(F.when((rank < F.col("end")) & (rank >= F.col("end") - F.col("n")), value))

    picked = []
    for k, share in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(share)
        picked += [at(F.floor(place)).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}")]
    out = _renamed(ended.groupBy(*g).agg(*picked), g, "at_")
    out = cuts.select(*g, "total").join(out, _same(g, "at_"), "left") if g else cuts.select("total").crossJoin(F.broadcast(out))
    values, missed = [], F.lit(False)
    for k, share in enumerate(shares):
        place, lo, hi = (F.col("total") - 1) * F.lit(share), F.col(f"lo{k}"), F.col(f"hi{k}")
        values.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(f"q{k}"))
        missed = missed | ((F.col("total") > 0) & (lo.isNull() | hi.isNull()))
    return out.select(*g, *values, missed.alias("missed"))


def group_medians(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., median): exact and interpolated, nulls left out (null for a group of nothing else); no task holds a group's values."""
    return _percentiles(df, column, by, (0.5,)).select(*(F.col(f"g{k}").alias(c) for k, c in enumerate(by)), F.col("q0").alias("median"))


def robust_apply(df: DataFrame, column: str, scaler: DataFrame, out: str, by: list[str] | None = None) -> DataFrame:
    """df with out, by a fitted scaler: of this table, or of an earlier one that is to be reused. Rows of a group that it doesn't have fall away."""
    center, scale, *keys = fresh([*df.columns, out], "center", "scale", *(by or []))
    named = scaler.select(F.col("center").alias(center), F.col("scale").alias(scale), *(F.col(c).alias(k) for c, k in zip(by or [], keys, strict=True)))
    same = F.lit(True)
    for c, k in zip(by or [], keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    joined = df.join(small(named), same) if by else df.crossJoin(F.broadcast(named))
    scaled = (F.col(column) - F.col(center)) / F.col(scale)
    return joined.withColumn(out, scaled).drop(center, scale, *keys)


def features(points: DataFrame, names: list[str], normalize: bool = True, z_size: float = 0.05, r_size: float = 2.0) -> DataFrame:
    """points with f0, f1, ...: the scaled log of each named quantity, over its profile if normalize."""
    if unknown := set(names) - set(QUANTITIES):
        raise ValueError(f"unknown quantities {sorted(unknown)}; known are {', '.join(QUANTITIES)}")
    edges = bin_edges(points, z_size, r_size)
    (ratio,) = fresh([*points.columns, *(f"f{k}" for k in range(len(names)))], "log_ratio")
    for k, name in enumerate(names):
        if normalize:
            points = corrected(points, name, edges, profile(points, name, edges), ratio)
        else:
            points = points.withColumn(ratio, F.when(F.col(name) > 0, F.ln(name)))
        points = robust_apply(points, ratio, robust_fit(points, ratio), f"f{k}").drop(ratio)
    return points


def fit_features(points: DataFrame, names: list[str], path: str, z_size: float = 0.05, r_size: float = 2.0) -> None:
    """Save the bins, the profile and the scaler of each quantity under path, for features of later snapshots."""
    edges = bin_edges(points, z_size, r_size)
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    for name in names:
        means = profile(points, name, edges)
        means.write.mode("overwrite").parquet(f"{path}/profile_{name}")
        robust_fit(corrected(points, name, edges, means), "log_ratio").write.mode("overwrite").parquet(f"{path}/scaler_{name}")


def saved_features(points: DataFrame, names: list[str], path: str) -> DataFrame:
    """points with f0, f1, ... by the bins, profiles and scalers that fit_features saved; bins without a profile give null."""
    read = points.sparkSession.read.parquet
    edges = read(f"{path}/edges")
    (ratio,) = fresh([*points.columns, *(f"f{k}" for k in range(len(names)))], "log_ratio")
    for k, name in enumerate(names):
        points = corrected(points, name, edges, read(f"{path}/profile_{name}"), ratio)
        points = robust_apply(points, ratio, read(f"{path}/scaler_{name}"), f"f{k}").drop(ratio)
    return points


def histogram_2d(df: DataFrame, x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 500) -> DataFrame:
    """(bx, by, n) of the rows inside both ranges; the last bins are closed."""
    place = lambda v, r: F.least(F.floor((v - r[0]) / ((r[1] - r[0]) / bins)), F.lit(bins - 1)).cast("long")
    inside = df.where((x >= x_range[0]) & (x <= x_range[1]) & (y >= y_range[0]) & (y <= y_range[1]))
    return inside.groupBy(place(x, x_range).alias("bx"), place(y, y_range).alias("by")).agg(F.count("*").alias("n"))


def line_profile(points: DataFrame, axis: str, quantity: Column, pixels: int, color: Column | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """(pixel, n, first, last, least, largest, color): what a plot of a quantity along an axis shows in each of so many pixel columns.

    Of each column the first and last point along the axis (ties by node_id) and the least and largest value are kept, which draw
    the same pixels as all points do, and the mean of color where it is given (else null). points: (node_id, axis, ...), already masked to a line.
    Without limits the axis runs over the points' range; points outside limits, or without a value, are left out. One aggregate.
    """
    if axis not in ("x", "y", "z"):
        raise ValueError(f"unknown axis {axis!r}; known are x, y, z")
    rows = points.select(F.col(axis).cast("double").alias("at"), quantity.cast("double").alias("v"), (F.lit(None) if color is None else color).cast("double").alias("c"), "node_id").where("at IS NOT NULL AND v IS NOT NULL")
    if limits:
        ends = [F.lit(float(e)) for e in limits]
        rows = rows.where(F.col("at").between(*ends))
    else:
        ends = [F.col("from"), F.col("to")]
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min("at").alias("from"), F.max("at").alias("to"))))
    width = (ends[1] - ends[0]) / pixels
    pixel = F.when(width > 0, F.least(F.floor((F.col("at") - ends[0]) / width), F.lit(pixels - 1))).otherwise(0).cast("long")
    turn = F.struct("at", "node_id")
    aggs = [F.count("*").alias("n"), F.min_by("v", turn).alias("first"), F.max_by("v", turn).alias("last"), F.min("v").alias("least"), F.max("v").alias("largest"), F.avg("c").alias("color")]
    return rows.groupBy(pixel.alias("pixel")).agg(*aggs)
