"""Hard-negative mining: exact windowed top-k inner products by the threshold algorithm over sorted lists of each dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.llm.rows import small
from lacuna.llm.vectors import common_length, integers, is_finite
from lacuna.operators.indexing import dense_index
from lacuna.sources.staging import discard, stage

SCALE, POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 256, 5, 10, 30, 90
#: Rows of a block of candidates (places in it fit 16 bits), and anchors that are looked up in one pass over all blocks.
BLOCK, ANCHORS = 4_096, 16_384
#: Entries read from each sorted list at first; each further step reads twice as many.
FIRST = 16
#: Sums of integers under this are exact in float64.
EXACT = 1 << 53
LEAST, MOST = -(1 << 62), 1 << 62

_BLOCKS = "n int, ids array<long>, rows array<long>, labels array<string>, points binary, orders binary"
_FOUND = "anchor int, slot int, score long, id long, row long"


class Lists:
    """A block of candidates with a sorted list for each dimension."""

    def __init__(self, row: dict):
        n = row["n"]
        self.x = np.frombuffer(row["points"], "<i4").reshape(n, -1).astype(np.int64)
        self.floats = self.x.astype(np.float64)
        self.top = int(np.abs(self.x).max(initial=0))
        self.order = np.frombuffer(row["orders"], "<u2").reshape(-1, n)
        self.rows = np.array(row["rows"], np.int64)
        self.known = np.array([i is not None for i in row["ids"]])
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        self.names = {}
        self.labels = np.array([self.names.setdefault(v, len(self.names)) for v in row["labels"]], np.int64)


class Best:
    """The first k rows of one window (low <= score <= high), by score downwards, then id (null last), then row."""

    __slots__ = ("k", "low", "high", "rows")

    def __init__(self, k: int, low: int = LEAST, high: int = MOST):
        self.k, self.low, self.high = k, low, high
        self.rows: list[tuple[int, bool, int, int]] = []  # (-score, id is null, id, row)

    def floor(self) -> int:
        """Scores under this cannot enter any more."""
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low

    def add(self, found: list[tuple[int, bool, int, int]]) -> None:
        self.rows = sorted(self.rows + found)[: self.k]


def threshold_scan(block: Lists, a: np.ndarray, fits: np.ndarray, windows: list[Best]) -> None:
    """Bring the rows of block where fits holds into the windows of the anchor vector a.

    All lists are read from the end that suits the sign of the anchor's component, some entries further at a time. A row
    seen for the first time is scored whole, in integers. No unseen row can score more than the threshold, the sum of
    what the lists' last entries would give, so reading stops once it is strictly under every window's k-th score, or its
    low end. Rows that tie with the k-th score are thus all seen.
    """
    n, d = block.x.shape
    up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
    exact = block.top * int(np.abs(a).max(initial=0)) * d < EXACT
    points, weights = (block.floats, a.astype(np.float64)) if exact else (block.x, a)
    seen = np.zeros(n, bool)
    at, step = 0, FIRST
    while at < n:
        to = min(n, at + step)
        new = np.zeros(n, bool)
        if len(up) + len(down):
            new[block.order[up, n - to : n - at].ravel()] = True
            new[block.order[down, at:to].ravel()] = True
            new &= ~seen
        else:  # a zero vector has no list to read: all rows score 0
            new[:] = True
        seen |= new
        fresh = np.flatnonzero(new & fits)
        if len(fresh):
            scores = (points[fresh] @ weights).astype(np.int64)
            for w in windows:
                hit = (scores >= w.floor()) & (scores <= w.high)
                if hit.any():
                    mine, s = fresh[hit], scores[hit]
                    if len(s) > w.k:  # no more than k of them, and their ties, can enter
                        cut = np.partition(s, len(s) - w.k)[len(s) - w.k]
                        mine, s = mine[s >= cut], s[s >= cut]
                    w.add(list(zip((-s).tolist(), (~block.known[mine]).tolist(), block.ids[mine].tolist(), block.rows[mine].tolist(), strict=True)))
        limit = int((a[up] * block.x[block.order[up, n - to], up]).sum() + (a[down] * block.x[block.order[down, to - 1], down]).sum())
        if all(limit < w.floor() for w in windows) or seen.all():
            return
        at, step = to, 2 * step


def _block_rows(length: int, scale: int):
    """mapInArrow function: rows (id, row, label, vector) to rows of _BLOCKS."""
    schema = to_arrow_schema(T._parse_datatype_string(_BLOCKS))

    def packed(table: pa.Table) -> pa.RecordBatch:
        x = integers(table["vector"].combine_chunks(), length, scale)
        row = {
            "n": len(x),
            "ids": table["id"].to_pylist(),
            "rows": table["row"].to_pylist(),
            "labels": table["label"].to_pylist(),
            "points": x.astype("<i4").tobytes(),
            "orders": np.argsort(x.T, axis=1, kind="stable").astype("<u2").tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                take = BLOCK - sum(map(len, held))
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(map(len, held)) == BLOCK:
                    yield packed(pa.Table.from_batches(held))
                    held = []
        if held:
            yield packed(pa.Table.from_batches(held))

    return run


def _search(blocks: DataFrame, anchors: dict, same: bool, windows: list[list[tuple[int, int, int]]]) -> DataFrame:
    """_FOUND rows: what each task finds in each window (k, low, high) of each anchor, among rows of the same label or of others.

    anchors: vectors, labels and rows of at most ANCHORS anchors. A task keeps its windows over all of
    its blocks, so a later block is read no further than its earlier ones leave a chance.
    """
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, windows))
    schema = to_arrow_schema(T._parse_datatype_string(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = sent.value
        best = [[Best(*w) for w in mine] for mine in windows]
        for batch in batches:
            for at in range(len(batch)):
                block = Lists(batch.slice(at, 1).to_pylist()[0])
                for k, mine in enumerate(best):
                    if mine:
                        alike = block.labels == block.names.get(anchors["labels"][k], -1)
                        fits = (alike & (block.rows != anchors["rows"][k])) if same else ~alike
                        threshold_scan(block, anchors["vectors"][k], fits, mine)
        out = [(k, slot, -s, None if null else i, row) for k, mine in enumerate(best) for slot, w in enumerate(mine) for s, null, i, row in w.rows]
        for at in range(0, len(out), 50_000):
            cols = list(zip(*out[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with rank (from 1): the first k of each anchor's slot over all tasks; Spark keeps k a task before the shuffle."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW_PERCENT,
    high: int = HIGH_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of each anchor and positive.

    Components are floor(scale * x), a score is the integer inner product with the anchor; higher scores come first, ties by the
    smaller id (null last). The first rows of the anchor's label, itself left out, are its positives. For each, the first rows
    of other labels with low <= 100 * negative score / positive score <= high (multiplied out) are its negatives.

    Candidates are blocks of BLOCK rows with a sorted list for each dimension, written once. Anchors are looked up in passes of
    at most ANCHORS over all blocks: first the positives, then the windows they set. Tasks return k rows a window.

    Left out: rows with a null label, null vectors, and those with null or non-finite components; vectors of another length than
    most rows have, empty ones too. Components are held within vectors.largest. Repeated rows are rows of their own: a repeated
    anchor row has its own results, with its copy among its positives. An anchor without a positive, or a positive without a
    negative in its window, gives no row; an empty table gives none. Other columns than the three, and those of is_anchor, are not read.
    """
    vector = F.col(vector_col)
    kept = rows.where(F.col(label_col).isNotNull() & is_finite(vector)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.size(vector).alias("length"), F.monotonically_increasing_id().alias("row")
    )
    kept = stage(kept, "vectors")
    length = common_length(kept, "length")
    kept = kept.where(F.col("length") == length)
    blocks = stage(kept.select("id", "row", "label", "vector").mapInArrow(_block_rows(length, scale), _BLOCKS), "lists")
    asked = stage(dense_index(kept.where("asks").select("id", "row", "label", "vector"), ["id", "row"], "place"), "anchors")
    out = rows.sparkSession.createDataFrame([], _RESULT)
    for at in range(0, asked.count(), ANCHORS):
        table = asked.where(F.col("place").between(at, at + ANCHORS - 1)).withColumn("anchor", (F.col("place") - at).cast("int")).orderBy("anchor").toArrow()
        anchors = {"vectors": integers(table["vector"].combine_chunks(), length, scale), "labels": table["label"].to_pylist(), "rows": table["row"].to_pylist()}
        n = len(anchors["rows"])
        near = stage(_first(_search(blocks, anchors, True, [[(positives, LEAST, MOST)]] * n), positives), "positives")
        windows: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for r in near.orderBy("anchor", "rank").select("anchor", "score").toArrow().to_pylist():
            s = r["score"]
            windows[r["anchor"]].append((negatives, -(-low * s // 100), high * s // 100))
        far = stage(_first(_search(blocks, anchors, False, windows), negatives), "negatives")
        ids = asked.select((F.col("place") - at).cast("int").alias("anchor"), F.col("id").alias("anchor_id"))
        mine = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        got = far.join(F.broadcast(mine), ["anchor", "slot"]).join(small(ids), "anchor")
        out = out.unionByName(got.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    discard(blocks)
    return out
