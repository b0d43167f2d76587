"""Particle sources: raw snapshots in code units, tables given by the caller, and azimuthal chunk tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import masks

REQUIRED = ("x", "y", "z", "density", "temperature", "mass", "id")

# CGS constants (fixed values).
SOLAR_MASS_G, PROTON_MASS_G, BOLTZMANN_ERG_K, KPC_CM, MYR_S = 1.989e33, 1.67262178e-24, 1.38065e-16, 3.085678e21, 3.15576e13
#: Code lengths in a kpc, and the helium abundance where a header has none.
LENGTHS_PER_KPC, HELIUM = 10.0, 0.1


@dataclass
class Header:
    """Units of a snapshot."""

    box_size: float
    mass_g: float
    length_cm: float
    velocity_cm_s: float
    time: float = 0.0
    helium: float = HELIUM

    @property
    def time_myr(self) -> float:
        """Time in code units of 0.1 kpc / (km/s)."""
        return self.time * (KPC_CM / LENGTHS_PER_KPC / 1e5) / MYR_S


def load(raw: DataFrame, header: Header, z_limit: float = 1.0, r_min: float = 7.5, r_max: float = 9.5, pad: float = 1e-4) -> DataFrame:
    """Physical particle columns of a raw table (id, cx, cy, cz, density, energy, mass, h2, hplus) inside the ring.

    Everything is a column expression, so the scan reads only what the caller selects, and the bounds on
    the coordinates are pushed to it. Positions are in kpc from the box centre, density in g/cm3,
    temperature in K, mass in solar masses, volume in cm3.
    """
    half = header.box_size / 2
    x, y, z = ((F.col(f"c{a}") - half) / LENGTHS_PER_KPC for a in "xyz")
    rho = F.col("density") * (header.mass_g / header.length_cm**3)
    energy = F.col("energy") * header.velocity_cm_s**2
    n_h = rho / ((1 + 4 * header.helium) * PROTON_MASS_G)
    n_all = (1 + header.helium - F.col("h2") + F.col("hplus")) * n_h
    mass_g = F.col("mass") * header.mass_g
    temperature = F.try_divide(2 * energy * rho, 3 * n_all * BOLTZMANN_ERG_K)
    return raw.where(masks.in_cylinder(x, y, z, r_min, r_max, z_limit, pad)).select(
        F.col("id").alias("node_id"),
        "id",
        x.alias("x"),
        y.alias("y"),
        z.alias("z"),
        rho.alias("density"),
        temperature.alias("temperature"),
        (mass_g / SOLAR_MASS_G).alias("mass"),
        F.try_divide(mass_g, rho).alias("volume"),
        n_h.alias("n_h"),
    )


def check_particles(df: DataFrame) -> DataFrame:
    """df, if it has all required columns."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"particles need the columns {', '.join(missing)}")
    return df if "node_id" in df.columns else df.withColumn("node_id", F.col("id"))


def write_chunks(points: DataFrame, path: str, snapshot: int, chunks: int, padding: float = 0.005, replace: bool = False) -> None:
    """Azimuthal chunks with their halo under path/snapshot=<n>/chunk=<k>. Chunks that are there stay unless replaced; missing ones are added.

    A replaced chunk takes the place of that chunk alone (dynamic partition overwrite), so chunks can be made anew one by one.
    """
    spread = masks.with_chunks(points, chunks, padding)
    width = 2 * math.pi / chunks
    marked = spread.withColumn("low", F.col("chunk") * width - math.pi).withColumn("high", (F.col("chunk") + 1) * width - math.pi).withColumn("snapshot", F.lit(snapshot))
    if not replace:
        there = [r["section"] for r in list_chunks(points.sparkSession, path, snapshot).select("section").distinct().collect()]  # at most chunks numbers
        marked = marked.where(~F.col("chunk").isin(there)) if there else marked
    # A chunk may be large, so its rows are dealt over tasks by id as well.
    dealt = marked.repartition("chunk", F.pmod(F.xxhash64("node_id"), F.lit(8)))
    dealt.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot", "chunk").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def list_chunks(spark: SparkSession, path: str, snapshot: int | None = None, first: int | None = None) -> DataFrame:
    """(snapshot, section, low, high, files, n) of the stored chunks, by the names of their files; of one snapshot, or its first sections, if asked for.

    Other snapshots and sections aren't opened (partition pruning). A folder that isn't there has no chunks.
    """
    df = _stored(spark, path)
    if df is None:
        return spark.createDataFrame([], "snapshot int, section int, low double, high double, files long, n long")
    if snapshot is not None:
        df = df.where(F.col("snapshot") == snapshot)
    if first is not None:
        df = df.where(F.col("chunk") < first)
    name = F.col("file")
    files = df.select(F.col("_metadata.file_path").alias("file"), "low", "high").groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))
    named = files.select(F.regexp_extract(name, r"/snapshot=(\d+)/", 1).cast("int").alias("snapshot"), F.regexp_extract(name, r"/chunk=(\d+)/", 1).cast("int").alias("section"), "low", "high", "n")
    return named.groupBy("snapshot", "section").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("files"), F.sum("n").alias("n"))


def read_chunks(spark: SparkSession, path: str, snapshot: int, first: int | None = None) -> DataFrame:
    """Rows of a snapshot's chunks; only the first ones if asked for, by partition pruning."""
    df = spark.read.parquet(path).where(F.col("snapshot") == snapshot)
    return df if first is None else df.where(F.col("chunk") < first)


def chunks_complete(chunks: DataFrame, tolerance: float = 1e-6) -> bool:
    """Whether the chunk intervals run from -pi to pi without a gap. One row for each chunk is compared."""
    rows = chunks.select("low", "high").distinct()
    after = F.lead("low").over(Window.orderBy("low"))
    gaps = rows.select("low", "high", F.coalesce(after, F.lit(math.pi)).alias("next"))
    got = gaps.agg(F.min("low"), F.max("high"), F.bool_and(F.abs(F.col("high") - F.col("next")) <= tolerance)).first()
    return bool(got[2]) and abs(got[0] + math.pi) <= tolerance and abs(got[1] - math.pi) <= tolerance
