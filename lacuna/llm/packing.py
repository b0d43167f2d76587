"""Best-fit packing of token pieces into sequences by hierarchical residual rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.llm.rows import bound_batches, map_rows, slices
from lacuna.llm.tokens import encoder
from lacuna.sources.staging import stage

CAPACITY = 2048
#: A bin with so few free places is emitted; the others go on as items.
NEARLY_FULL = 4
#: How many bins one task packs at once, and how many tasks of a round are merged into one of the next.
TASK_BINS, FAN_IN = 100_000, 8
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBERS = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "offset": "long"}
_BINS = "sequence_id long, size int, done boolean, apart string, " + ", ".join(f"{n} array<{t}>" for n, t in _MEMBERS.items())


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """PIECES rows: the ids of each whole text and the end id, cut into pieces only where they exceed capacity.

    Null or empty text is the end id alone. Repeated rows and rows without an id are packed like any
    other; columns other than doc_id and text are not read.
    """
    return map_rows(_texts(docs), _cut(tokenizer, capacity, end_id), PIECES)


def _texts(docs: DataFrame, apart: str | None = None) -> DataFrame:
    more = [] if apart is None else [F.coalesce(F.col(f"`{apart}`").cast("string"), F.lit("")).alias("apart")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def _cut(tokenizer: str, capacity: int, end_id: int):
    """make() of map_rows: texts to pieces."""
    end = np.array([end_id], "<u4").tobytes()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def make():
        encode = encoder(tokenizer)

        def each(rows):
            out = {n: [] for n in names}
            if "apart" in rows:
                out["apart"] = []
            for row, (doc_id, ids) in enumerate(zip(rows["doc_id"], encode(rows["text"]), strict=True)):
                ids += end
                if "apart" in rows:
                    out["apart"] += [rows["apart"][row]] * -(-len(ids) // (4 * capacity))
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for n, v in zip(names, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[n].append(v)
            return out

        return each

    return make


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of item numbers, one for each bin. Free space is looked up in one bit set."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    bins: list[list[int]] = []
    free = 0  # bit r is set if a bin has r free places
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            open_bins[room].append(at)
            free |= 1 << room
    return bins


def _pack(level: int, capacity: int, slack: int, make=None):
    """Best-fit packing of a partition's items, after make()'s function where it is given."""
    names = list(_MEMBERS)
    schema = to_arrow_schema(T._parse_datatype_string(_BINS))

    def flush(rows: dict[str, list], base: int) -> Iterator[pa.RecordBatch]:
        sizes, apart = rows["size"], rows["apart"]
        alike: dict[str, list[int]] = {}
        for i, v in enumerate(apart):
            alike.setdefault(v, []).append(i)
        bins = [[those[i] for i in members] for those in alike.values() for members in best_fit([sizes[i] for i in those], capacity)]
        for at in range(0, len(bins), 1000):
            out: dict[str, list] = {n: [] for n in ("sequence_id", "size", "done", "apart", *names)}
            for k, members in enumerate(bins[at : at + 1000], at):
                total, joined = 0, {n: [] for n in names}
                for i in members:
                    for n in names[:-1]:
                        joined[n] += rows[n][i]
                    joined["offset"] += [total + o for o in rows["offset"][i]]
                    total += sizes[i]
                out["sequence_id"].append(base + k)
                out["size"].append(total)
                out["apart"].append(apart[members[0]])
                out["done"].append(capacity - total <= slack)
                for n in names:
                    out[n].append(joined[n])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        each = make() if make else lambda rows: rows
        held: dict[str, list] = {}
        for batch in batches:
            for rows in slices(batch):
                got = each(rows)
                if "size" not in got:  # first round: each piece is an item of one member
                    got = {"size": got["length"], "apart": got.get("apart") or [""] * len(got["length"]), **{n: [[v] for v in got[n]] for n in names[:-1]}, "offset": [[0] for _ in got["length"]]}
                for n, v in got.items():
                    held.setdefault(n, []).extend(v)
                if len(held["size"]) >= TASK_BINS:
                    yield from flush(held, base)
                    base, held = base + len(held["size"]), {}
            pa.default_memory_pool().release_unused()
        if held:
            yield from flush(held, base)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = NEARLY_FULL) -> DataFrame:
    """PIECES rows with sequence_id and offset: each sequence holds at most capacity tokens, gapless from 0.

    Every partition is packed best-fit by itself and emits its nearly full bins; the underfull ones are
    items of the next round, in which the tasks are FAN_IN times fewer, down to one, or to as many as
    hold TASK_BINS bins each. Bins in which not even the smallest open one fits are final. Rounds end
    when no two bins fit together; with over TASK_BINS bins that still fit somewhere, when a round of such
    tasks has merged none of them. A bin holds at most capacity members, so every row and task is bounded.
    Rounds are written to the shared folder. An empty table gives no rows.
    """
    first = pieces.select(*[c for c in _MEMBERS if c != "offset"])
    return _rounds(first.mapInArrow(_pack(0, capacity, slack), _BINS), capacity, slack)


def _rounds(first: DataFrame, capacity: int, slack: int, apart: str | None = None) -> DataFrame:
    """The rounds after the first, and the members of all bins."""
    now = stage(first, "bins")
    packed, level, before = [], 0, 0
    tasks = max(1, len(now.inputFiles()))
    while not level or (tasks > 1 and now.count() != before):
        left = now.where("NOT done")
        least = left.groupBy("apart").agg(F.min("size").alias("least"))
        # Bins that fit at least into the smallest open one of their kind; where that is it itself, none.
        some = left.join(F.broadcast(least), "apart").where(F.col("size") + F.col("least") <= capacity)
        kinds = some.groupBy("apart").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n > 1").collect()
        if not kinds:
            break
        room = F.create_map(*[F.lit(v) for r in kinds for v in (r["apart"], capacity - r["least"])])
        fits = F.col("size") <= F.coalesce(room[F.col("apart")], F.lit(-1))
        count = sum(r["n"] for r in kinds)
        least_tasks = -(-count // TASK_BINS)
        tasks, level = max(-(-tasks // FAN_IN), least_tasks), level + 1
        before = count if tasks == least_tasks else 0
        again = left.where(fits).repartition(tasks).mapInArrow(_pack(level, capacity, slack), _BINS)
        packed.append(now.where(F.col("done") | ~fits))
        now = stage(again, "bins")
    out = now
    for more in packed:
        out = out.unionByName(more)
    members = F.explode(F.arrays_zip(*_MEMBERS)).alias("m")
    kind = [] if apart is None else [F.col("apart").alias(apart)]
    return out.select("sequence_id", "apart", members).select(*[F.col(f"m.{n}").alias(n) for n in _MEMBERS if n != "offset"], "sequence_id", F.col("m.offset").alias("offset"), *kind)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = NEARLY_FULL, apart: str | None = None) -> DataFrame:
    """pack(token_pieces(docs)), with both steps in one Python worker.

    With the name of a column of few values as apart, such as a language, no sequence holds two of its values (null
    counts as the empty string), and it is the last column of the result.
    """
    first = bound_batches(_texts(docs, apart)).mapInArrow(_pack(0, capacity, slack, _cut(tokenizer, capacity, END_ID)), _BINS)
    return _rounds(first, capacity, slack, apart)
