"""Dense numbering in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.names import fresh
from lacuna.sources.staging import stage


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: 0-based place in the order given (unique keys). Ranges are numbered by themselves and then shifted."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part, inside, size, shift = fresh([*df.columns, name], "part", "inside", "size", "shift")
    ranged = stage(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranged")
    numbered = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    sizes = ranged.groupBy(part).agg(F.count("*").alias(size))  # one row for each shuffle partition
    before = F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = numbered.join(F.broadcast(sizes.select(part, before.alias(shift))), part)
    return joined.withColumn(name, (F.col(shift) + F.col(inside) - 1).cast("long")).drop(part, inside, shift)
