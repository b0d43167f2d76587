"""Vector code compression: product codes whose codebooks come from dual-tree Lloyd rounds in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.llm.rows import small
from lacuna.llm.vectors import common_length, integers, is_finite
from lacuna.sources.staging import discard, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one block, over whose parts the trees are built, and parts of a leaf at most.
BLOCK, LEAF = 8_192, 64
#: Sums of integers under this are exact in float64.
EXACT = 1 << 53

_BLOCKS = "n int, ids array<long>, groups array<string>, orders binary, points binary"


class Tree:
    """A balanced tree over points (n, d): node k of level l holds the points from k * n >> l to (k + 1) * n >> l of the order.

    Each level has the nodes' boxes and sums. Nodes may be empty where n is small. With an order given, points are in it.
    """

    def __init__(self, points: np.ndarray, levels: int, order: np.ndarray | None = None):
        self.levels, self.n = levels, len(points)
        self.order = self._ordered(points) if order is None else order
        self.points = points[self.order] if order is None else points
        edges = self.edges(levels)
        self.size = [np.diff(self.edges(k)) for k in range(levels + 1)]
        full = np.flatnonzero(self.size[levels])
        low = np.full((1 << levels, points.shape[1]), np.iinfo(np.int64).max >> 1)
        high = -low
        low[full] = np.minimum.reduceat(self.points, edges[full], axis=0)
        high[full] = np.maximum.reduceat(self.points, edges[full], axis=0)
        add = np.zeros_like(low)
        add[full] = np.add.reduceat(self.points, edges[full], axis=0)
        self.low, self.high, self.sums = [low], [high], [add]
        for _ in range(levels):
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
            self.sums.insert(0, self.sums[0][::2] + self.sums[0][1::2])

    def edges(self, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * self.n >> level

    def _ordered(self, points: np.ndarray) -> np.ndarray:
        """Points halved along the widest side of each node, level by level."""
        order = np.arange(self.n)
        for level in range(self.levels):
            edges, finer = self.edges(level), self.edges(level + 1)
            for k in range(1 << level):
                a, mid, b = edges[k], finer[2 * k + 1], edges[k + 1]
                if a < mid < b:
                    mine = points[order[a:b]]
                    side = int(np.argmax(mine.max(0) - mine.min(0)))
                    order[a:b] = order[a:b][np.argpartition(mine[:, side], mid - a)]
        return order


def depth(n: int, leaf: int) -> int:
    """Levels below the root until no node has over leaf points."""
    return max(0, (-(-n // leaf) - 1).bit_length())


def squared(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(len(x), len(e)) squared distances of integer vectors, exact."""
    top = max(np.abs(x).max(initial=0), np.abs(e).max(initial=0))
    kind = np.float64 if 4 * int(top) ** 2 * x.shape[1] < EXACT else np.int64
    x, e = x.astype(kind), e.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)[None, :]).astype(np.int64)


def assign(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in the order of tree, sums, counts): the nearest entry of each point, the lowest of ties, and the points of each entry.

    Pairs of nodes go down both trees at once. A pair falls away where the least distance of its boxes
    is over the greatest distance to some other entries of the same points, so a tie never falls away.
    Points whose node is left with one entry get it together, with the node's cached sum; leaves with
    several are compared one by one, in integers.
    """
    codes = np.empty(tree.n, np.int64)
    sums, counts = np.zeros((entries.n, tree.points.shape[1]), np.int64), np.zeros(entries.n, np.int64)
    p, e, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.iinfo(np.int64).max)
    at_p = at_e = 0
    while True:
        there = (tree.size[at_p][p] > 0) & (entries.size[at_e][e] > 0)
        p, e = p[there], e[there]
        if not len(p):
            return codes, sums, counts
        low, high, elow, ehigh = tree.low[at_p][p], tree.high[at_p][p], entries.low[at_e][e], entries.high[at_e][e]
        gap = np.maximum(np.maximum(low - ehigh, elow - high), 0)
        reach = np.maximum(high - elow, ehigh - low)
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))  # p is in order
        bound[p[first]] = np.minimum(bound[p[first]], np.minimum.reduceat((reach * reach).sum(1), first))
        keep = (gap * gap).sum(1) <= bound[p]
        p, e = p[keep], e[keep]
        if at_e == entries.levels:
            alone = np.bincount(p, minlength=1 << at_p)[p] == 1
            edges = tree.edges(at_p)
            for node, entry in zip(p[alone].tolist(), entries.order[entries.edges(at_e)[e[alone]]].tolist(), strict=True):
                codes[edges[node] : edges[node + 1]] = entry
                sums[entry] += tree.sums[at_p][node]
                counts[entry] += tree.size[at_p][node]
            p, e = p[~alone], e[~alone]
            if at_p == tree.levels:
                break
        if at_p < tree.levels:
            at_p += 1
            p, e, bound = np.repeat(2 * p, 2) + np.tile([0, 1], len(p)), np.repeat(e, 2), np.repeat(bound, 2)
            turn = np.argsort(p, kind="stable")
            p, e = p[turn], e[turn]
        for _ in range(2):  # entries go down faster: only single entries assign nodes
            if at_e < entries.levels:
                at_e += 1
                p, e = np.repeat(p, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e))
    if not len(p):
        return codes, sums, counts
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    edges, single = tree.edges(at_p), entries.order[entries.edges(at_e)[e]]
    values = np.empty_like(entries.points)
    values[entries.order] = entries.points
    for a, b in zip(first.tolist(), np.append(first[1:], len(p)).tolist(), strict=True):
        some, (lo, hi) = np.sort(single[a:b]), edges[p[a] : p[a] + 2]
        mine = tree.points[lo:hi]
        got = some[np.argmin(squared(mine, values[some]), axis=1)]
        codes[lo:hi] = got
        np.add.at(sums, got, mine)
        counts += np.bincount(got, minlength=len(counts))
    return codes, sums, counts


def _block_rows(parts: int, length: int, scale: int):
    """mapInArrow function: rows (id, grp, vector) to rows of _BLOCKS, with a tree order for each part."""
    schema = to_arrow_schema(T._parse_datatype_string(_BLOCKS))

    def packed(table: pa.Table) -> pa.RecordBatch:
        x = integers(table["vector"].combine_chunks(), length, scale)
        orders, points = [], []
        for part in np.split(x, parts, axis=1):
            tree = Tree(part, depth(len(x), LEAF))
            orders.append(tree.order)
            points.append(tree.points)
        row = {
            "n": len(x),
            "ids": table["id"].to_pylist(),
            "groups": table["grp"].to_pylist(),
            "orders": np.array(orders, "<i4").tobytes(),
            "points": np.array(points, "<i4").tobytes(),
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


def _unpacked(row: dict, parts: int) -> list[Tree]:
    n = row["n"]
    orders = np.frombuffer(row["orders"], "<i4").reshape(parts, n)
    points = np.frombuffer(row["points"], "<i4").reshape(parts, n, -1).astype(np.int64)
    return [Tree(points[j], depth(n, LEAF), orders[j]) for j in range(parts)]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; at most parts * entries rows of sums come to the driver."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b, depth(entries, 1)) for b in books]
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                for j, tree in enumerate(_unpacked(row, parts)):
                    _, s, c = assign(tree, trees[j])
                    sums[j] += s
                    counts[j] += c
        j, e = np.nonzero(counts)
        arrays = [pa.array(j, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[j, e]), pa.array(sums[j, e].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", "sums"])

    got = blocks.select("n", "orders", "points").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    after = books.copy()
    for r in got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        after[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(d)]
    return after


def _codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, grp, code, error) of every row under the given codebooks."""
    parts, entries, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b, depth(entries, 1)) for b in books]
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                codes, error = np.zeros((row["n"], parts), np.uint8), np.zeros(row["n"], np.int64)
                for j, tree in enumerate(_unpacked(row, parts)):
                    got, _, _ = assign(tree, trees[j])
                    codes[tree.order, j] = got
                    error[tree.order] += ((tree.points - books[j][got]) ** 2).sum(1)
                text = [c.tobytes().hex() for c in codes]
                arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["groups"], pa.string()), pa.array(text, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "grp", "code", "error"])

    return blocks.mapInArrow(run, "id long, grp string, code string, error long")


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(coded, books): coded has (id, grp, code, error, group_error) for each row that takes part, books is (parts, entries, length of a part).

    Components are floor(scale * x). A part's codebook starts as that part of the rows with the smallest ids
    (null ids last, ties by vector); a round gives every part to its nearest entry (lowest of ties) and replaces
    each entry by the floor of its parts' mean; unused entries stay. code has two hex digits a part, error is the
    squared distance to the entries, group_error its sum over rows of equal group (nulls together).

    Rows are blocks of BLOCK rows with a tree over each part, written once; a round reads the blocks, carries
    the codebooks (fixed size) to the tasks and brings one sum an entry back, whatever the number of rows.

    Left out: null vectors, and those with null or non-finite components. Vectors need one length: that of most rows,
    among multiples of parts; others, empty ones too, are left out. Components are held within vectors.largest.
    Repeated rows and ids are coded each; fewer rows than entries make shorter codebooks; an empty table gives no rows.
    Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold at most 256 entries")
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    vector = F.col(vector_col)
    kept = rows.where(is_finite(vector)).select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), vector.alias("vector"), F.size(vector).alias("length"))
    length = common_length(kept, "length", parts)
    kept = kept.where(F.col("length") == length).select("id", "grp", "vector")
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).toArrow()["vector"].combine_chunks()
    if not length:
        return rows.sparkSession.createDataFrame([], "id long, grp string, code string, error long, group_error long"), np.zeros((parts, 0, 0), np.int64)
    books = np.stack(np.split(integers(first, length, scale), parts, axis=1))
    blocks = stage(kept.mapInArrow(_block_rows(parts, length, scale), _BLOCKS), "blocks")
    for _ in range(rounds):
        books = _round(blocks, books)
    coded = stage(_codes(blocks, books), "codes")
    discard(blocks)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = stage(coded.groupBy(F.col("grp").alias("of")).agg(total.alias("group_error")), "sums")
    return coded.join(small(sums), F.col("grp").eqNullSafe(F.col("of"))).select("id", "grp", "code", "error", "group_error"), books


def digest(books: np.ndarray) -> str:
    """Hex sha256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """coded with vector: the middle of the scale steps that the code's entries name; a null code gives null."""

    @F.pandas_udf("array<double>")
    def look_up(codes):
        return codes.map(lambda c: None if c is None else np.concatenate([(b[k] + 0.5) / scale for b, k in zip(books, bytes.fromhex(c), strict=True)]).tolist())

    return coded.withColumn("vector", look_up(F.col(code_col)))
