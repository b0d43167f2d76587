"""Written intermediate tables: they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Decision tables of at most so many rows (a few numbers each, so some MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 250_000


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lacuna-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path for one written table."""
    return f"{shared_dir(spark)}/lacuna/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; count a staged table, not a plan."""
    return F.broadcast(df) if df.count() <= limit else df


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lacuna/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def held_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings for the jobs inside, as they were before afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
