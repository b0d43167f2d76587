"""Sharding by proportional stratified interleaving: every shard has as many rows, and every source its share of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.rows import small
from lacuna.operators.indexing import dense_index
from lacuna.sources.staging import discard, stage

SHARDS, SEED = 24, 13


def interleave(keys: DataFrame, stratum: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """keys with shard and slot; order: columns that number the rows of a stratum, unique together.

    Rows are ranked in each stratum, sorted by fractional rank ((rank + 1/2) / rows of the stratum; ties by stratum) and cut
    into shards whose row counts differ by at most one. A shard's rows of a stratum differ from the exact share by less than
    the number of strata plus one. Both numberings range the rows and count each range, so no task holds a stratum.
    """
    ranked = stage(dense_index(keys, [stratum, *order], "at"), "ranked")
    strata = stage(ranked.groupBy(F.col(stratum).alias("of")).agg(F.min("at").alias("start"), F.count("*").alias("n")), "strata")
    total = strata.agg(F.sum("n")).first()[0] or 0
    fraction = (F.col("at") - F.col("start") + F.lit(0.5)) / F.col("n")
    both = ranked.join(small(strata), F.col(stratum).eqNullSafe(F.col("of"))).withColumn("fraction", fraction)
    # at orders the strata as it orders their rows, so it breaks ties.
    placed = dense_index(both.drop("of", "start", "n"), ["fraction", "at"], "place")
    shard = F.expr(f"(place * {shards}) DIV {max(1, total)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")
    cut = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - start)
    return cut.withColumn("shard", F.col("shard").cast("int")).drop("at", "fraction", "place")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list:
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    id_, size, crc = F.col(id_col).cast("long"), F.length(data).cast("long") + 8, F.crc32(data)
    return [
        id_.alias("doc_id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.col(source_col).cast("string").alias("stratum"),
        F.xxhash64(F.lit(seed), id_, size, crc).alias("turn"),
        F.monotonically_increasing_id().alias("row"),
    ]


_ORDER = ["turn", "doc_id", "size", "text_crc32", "row"]


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    Rows of a source are put in the order of a seeded hash of id, size and crc32 of the text, so the result doesn't depend on
    partitions; only rows equal in all three may change places. The law is "rows": shards' counts are at most one apart, and
    slot numbers the rows of a shard from 0. grown_shard belongs to another law and is null. Texts are read once and not shuffled.

    size: UTF-8 bytes of the text, 0 for null, plus 8. A null source is a source of its own, null ids and repeated rows are
    dealt like any other row; an empty table gives no rows, and fewer rows than shards leave shards empty. Other columns are not read.
    """
    keys = stage(docs.select(*_keyed(docs, id_col, text_col, source_col, seed)), "keys")
    out = interleave(keys, "stratum", _ORDER, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """The rows of docs, with all their columns, as Parquet under path/shard=<k>; each file of a shard is a run of slots in order.

    Rows carry a number through the assignment and are joined to it once. A column of docs may have any name
    but shard, by which the folders are named; the assignment is kept in the column that write_shards adds, slot, or,
    where docs has one, in slot_1, slot_2, and so on.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column named shard")
    held = stage(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    flat = held.select(F.col("doc").getField(id_col).alias("i"), F.col("doc").getField(text_col).alias("t"), F.col("doc").getField(source_col).alias("s"), F.col("row").alias("held"))
    keys = stage(flat.select(*_keyed(flat, "i", "t", "s", seed), "held"), "keys")
    placed = stage(interleave(keys, "stratum", _ORDER, shards).select(F.col("held").alias("row"), "shard", "slot"), "places")
    taken, name, k = {c.lower() for c in docs.columns}, "slot", 0
    while name in taken:
        k += 1
        name = f"slot_{k}"
    joined = held.join(placed, "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    joined.select("doc.*", F.col("slot").alias(name), "shard").write.partitionBy("shard").parquet(path)
    discard(held)
