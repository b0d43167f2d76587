"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. Native expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.names import fresh
from lacuna.llm.rows import small
from lacuna.sources.staging import stage

#: Runs of these six characters count as one space.
SPACES = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64


def normal_text(text: F.Column) -> F.Column:
    """Text with each run of white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """(doc_id, n_chars, prefix, text_sha256, keep_id, group_size, kept), one row for each row of docs.

    Refinement: rows whose length no other row has are settled after the first count, rows whose
    (length, prefix hash) is unique after the second, and only the rest are grouped by full hash.
    With digests=False the full content of settled rows is never hashed and text_sha256 is null for
    them; with digests=True every row gets its digest in the one scan.

    Null text is the empty text. The row with the smallest doc_id stays; rows without an id come last.
    Rows that repeat a doc_id with the same text are one document: all of them carry its decision.
    An empty table gives no rows; other columns are not read.
    """
    norm = normal_text(F.col(text_col))
    key = [F.length(norm).alias("n_chars"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix")]
    full = F.sha2(norm.cast("binary"), 256).alias("text_sha256")
    rows = docs.select(F.col(id_col).alias("doc_id"), *key, *([full] if digests else []))
    rows = stage(rows, "lengths")
    # Tables of keys are written before they are joined back, so that a hot key's rows can be split.
    lengths = stage(rows.groupBy("n_chars").count().where("count > 1").select("n_chars"), "lengths")
    prefixes = rows.join(small(lengths), "n_chars", "left_semi").groupBy("n_chars", "prefix").count().where("count > 1").select("n_chars", "prefix")
    prefixes = stage(prefixes, "prefixes")
    if digests:
        open_rows = rows.join(small(prefixes), ["n_chars", "prefix"], "left_semi")
    else:
        again = docs.select(F.col(id_col).alias("doc_id"), *key, norm.alias("norm"))
        hit = small(prefixes.withColumn("open", F.lit(True)))
        rows = again.join(hit, ["n_chars", "prefix"], "left").select("doc_id", "n_chars", "prefix", F.when(F.col("open"), F.sha2(F.col("norm").cast("binary"), 256)).alias("text_sha256"))
        rows = stage(rows, "hashes")
        open_rows = rows.where("text_sha256 IS NOT NULL")
    groups = open_rows.groupBy("n_chars", "prefix", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    same = ["n_chars", "prefix", "text_sha256"]
    out = rows.join(small(stage(groups, "groups")), same, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", *same, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"))


def dedup_exact(docs: DataFrame) -> DataFrame:
    """docs without exact copies: of equal texts the row with the smallest doc_id stays, once; rows without an id stay.

    Refinement as in exact_groups: only rows whose length and prefix another row shares are hashed whole. A
    decision holds for a doc_id with its text, so a doc_id with several texts loses only those that are copies.
    """
    norm = normal_text(F.col("text").cast("string"))
    length, prefix, hashed, open_, keep, again, size = fresh(docs.columns, "length", "prefix", "hashed", "open", "keep", "again", "size")
    near = {length: F.length(norm), prefix: F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))}
    seen = stage(docs.select(*(c.alias(n) for n, c in near.items())).groupBy(*near).agg(F.count("*").alias(size)), "lengths")
    lengths = seen.groupBy(length).agg(F.sum(size).alias(size)).where(F.col(size) > 1).select(length)
    shared = stage(seen.where(F.col(size) > 1).join(lengths, length, "left_semi").select(*near), "prefixes")
    full = F.sha2(norm.cast("binary"), 256)
    met = docs.select("doc_id", "text", *(c.alias(n) for n, c in near.items())).join(small(shared), list(near), "left_semi")
    same = [*near, hashed]
    copies = met.select("doc_id", *near, full.alias(hashed)).groupBy(*same, "doc_id").agg(F.count("*").alias(size))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.col(size).alias("n")))).alias(keep)
    groups = copies.groupBy(*same).agg(least, F.sum(size).alias(size)).where((F.col(size) > 1) & F.col(keep).isNotNull())
    groups = stage(groups.select(*same, F.col(keep).getField("doc_id").alias(keep), (F.col(keep).getField("n") > 1).alias(again)), "groups")
    marked = docs.withColumns(near).join(small(shared.withColumn(open_, F.lit(True))), list(near), "left")
    marked = marked.withColumn(hashed, F.when(F.col(open_), full)).join(small(groups), same, "left")
    kept = marked.where(F.col(keep).isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col(keep)))
    if not groups.where(again).take(1):
        return kept.select(_quoted(docs))
    once = F.coalesce(F.col(again) & F.col("doc_id").isNotNull(), F.lit(False))
    return kept.where(~once).select(_quoted(docs)).unionByName(kept.where(once).dropDuplicates(["doc_id", hashed]).select(_quoted(docs)))


def _quoted(docs: DataFrame) -> list[str]:
    """The columns of docs, whatever characters their names have."""
    return [f"`{c}`" for c in docs.columns]
