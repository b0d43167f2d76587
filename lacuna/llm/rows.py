"""Small helpers that the operators of this package share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Decision tables of at most so many rows (8-byte ids, so a few MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 250_000


#: Rows of an Arrow batch at most: texts are long, and both sides hold whole batches.
ARROW_ROWS = 2_500
#: Bytes of an Arrow batch that are Python objects at once; a longer row is a slice of its own.
SLICE_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were limited to ARROW_ROWS rows where they were larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    return df


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each value: those of texts and binaries, also inside lists and structs; others count as 8."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind):
        inside, at = np.append(0, np.cumsum(row_bytes(column.values))), column.offsets.to_numpy()
        return inside[at[1:]] - inside[at[:-1]] + 8
    if pa.types.is_struct(kind):
        return sum((row_bytes(c) for c in column.flatten()), np.zeros(len(column), np.int64))
    return np.full(len(column), 8, np.int64)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[dict[str, list]]:
    """Column lists of consecutive rows of at most limit bytes together; only a single longer row makes a larger slice."""
    ends = np.cumsum(sum((row_bytes(c) for c in batch.columns), np.zeros(len(batch), np.int64)))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        part = batch.slice(at, to - at)
        yield {n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)}
        at = to


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over column lists: make() runs once a task and returns the function of a slice of rows."""
    ddl = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for rows in slices(batch, limit):
                out = each(rows)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return bound_batches(df).mapInArrow(run, ddl)


def crc_mod(column: str, m: int) -> F.Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def crc_mod_of(doc_id: Any, m: int) -> int:
    """The same for one id in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; count a staged table, not a plan."""
    return F.broadcast(df) if df.count() <= limit else df


def drop_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped (one column, doc_id); rows without an id stay."""
    return docs.join(small(dropped), "doc_id", "left_anti").select([f"`{c}`" for c in docs.columns])


def keep_one_of_repeats(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with one row for each doc_id in repeated (a staged table of the ids that occur more than once).

    Usually repeated is empty and docs is returned as it is; else only the rows with such ids are shuffled.
    """
    if not repeated.take(1):
        return docs
    ids = small(repeated.select("doc_id"))
    again = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return docs.join(ids, "doc_id", "left_anti").unionByName(again).select([f"`{c}`" for c in docs.columns])
