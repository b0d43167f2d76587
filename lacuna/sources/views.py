"""Point, raster and graph views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the rasters that events and line items make.
HOURS, PART_COLUMNS, ORDER_COLUMNS = 24, 64, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, id, x, y, z, density, temperature, mass) of the embedding vectors' first six elements."""
    e = [F.col("embedding")[k].cast("double") for k in range(6)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node_id"),
        F.col("vec_id").alias("id"),
        e[0].alias("x"),
        e[1].alias("y"),
        e[2].alias("z"),
        (1 + e[3]).alias("density"),
        (1 + e[4]).alias("temperature"),
        (1 + F.abs(e[5])).alias("mass"),
    )


def _raster(df: DataFrame, iy: Column, ix: Column, width: int) -> DataFrame:
    cells = df.groupBy(iy.cast("long").alias("iy"), ix.cast("long").alias("ix")).agg(F.count("*").cast("double").alias("v"))
    return cells.select((F.col("iy") * width + F.col("ix")).alias("node_id"), "iy", "ix", "v")


def events_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, iy, ix, v): number of events of each day (since 2024-01-01) and hour."""
    ts = F.col("ts").cast("timestamp")
    return _raster(table(spark, sf_dir, "events"), F.datediff(ts, F.lit("2024-01-01")), F.hour(ts), HOURS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, iy, ix, v): number of line items of each shipping week (since 1992-01-01) and part column."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("timestamp"), F.lit("1992-01-01")) / 7)
    return _raster(table(spark, sf_dir, "lineitem"), week, F.pmod("l_partkey", F.lit(PART_COLUMNS)), PART_COLUMNS)


def orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, iy, ix, v): total price of each order, row by row of ORDER_COLUMNS orders; it grows with the table."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("node_id"), F.floor(n / ORDER_COLUMNS).alias("iy"), F.pmod(n, F.lit(ORDER_COLUMNS)).cast("long").alias("ix"), F.col("o_totalprice").alias("v"))


def calm(grid: DataFrame, size: int = 8, deviations: float = 0.3) -> DataFrame:
    """grid with inner: all cells of the square blocks whose mean is under that of all blocks by so many deviations."""
    by, bx = F.floor(F.col("iy") / size).alias("by"), F.floor(F.col("ix") / size).alias("bx")
    blocks = grid.groupBy(by, bx).agg(F.avg("v").alias("m"))
    level = blocks.agg((F.avg("m") - deviations * F.stddev_pop("m")).alias("level"))
    marked = blocks.crossJoin(F.broadcast(level)).select("by", "bx", (F.col("m") <= F.col("level")).alias("inner"))
    return grid.select("*", by, bx).join(marked, ["by", "bx"]).drop("by", "bx")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): pairs of parts and suppliers that meet in a line item; suppliers are the negative nodes."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))


def quiet(grid: DataFrame, deviations: float = 0.5) -> DataFrame:
    """grid with inner: cells whose value is under the mean by so many standard deviations or more."""
    level = grid.agg((F.avg("v") - deviations * F.stddev_pop("v")).alias("level"))
    return grid.crossJoin(F.broadcast(level)).withColumn("inner", F.col("v") <= F.col("level")).drop("level")
