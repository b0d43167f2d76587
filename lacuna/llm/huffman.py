"""Token-id files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.rows import map_rows
from lacuna.llm.tokens import encoder
from lacuna.sources.staging import stage, stage_path

END_ID = 0
#: Longest code in bits: more than enough for 2^16 ids, and a decoding table of 2^18 entries.
MAX_BITS = 18
#: Tokens between two checkpoints, and tokens of a block.
LANE, BLOCK = 64, 1 << 16
#: Tokens that one shard aims at.
SHARD_TOKENS = 4_000_000


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of each id under the limit, by package-merge; 0 for ids that don't occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(ids) < 2:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids don't fit into codes of {limit} bits")
    order = ids[np.lexsort((ids, counts[ids]))]
    weight = counts[order].astype(np.float64)
    n = len(order)
    leaves = np.arange(n)
    # Each level holds leaves and packages of two items of the level below, by weight.
    levels: list[np.ndarray] = []
    kinds, weights = leaves, weight
    for _ in range(limit - 1):
        levels.append(kinds)
        pairs = len(weights) // 2
        packed = weights[: 2 * pairs].reshape(pairs, 2).sum(1)
        both = np.concatenate([weight, packed])
        at = np.argsort(both, kind="stable")
        weights, kinds = both[at], np.where(at < n, at, -1)
    levels.append(kinds)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for kinds in reversed(levels):
        chosen = kinds[:take]
        lengths[chosen[chosen >= 0]] += 1
        take = 2 * int((chosen < 0).sum())
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the last plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.int64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    code, last = 0, 0
    for i in ids.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For each window of limit bits: id << 5 | length of the code it starts with."""
    table = np.zeros(1 << limit, np.uint32)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        table[codes[i] << (limit - n) : (codes[i] + 1) << (limit - n)] = i << 5 | n
    return table


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checkpoints): packed codes, and the bit offset of every LANE-th token as little-endian unsigned 32-bit.

    Works through BLOCK tokens at a time, each from a whole byte on, so memory stays bounded in long documents.
    """
    bits, marks, done = [], [], 0
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        n = lengths[part]
        ends = np.cumsum(n)
        starts = ends - n
        # Each code as the top bits of the 64-bit window that begins at its 32-bit word; codes of one word are put together.
        word = starts >> 5
        window = codes[part].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        whole = np.zeros(int(word[-1]) + 2, np.uint64)
        whole[word[first]] = np.bitwise_or.reduceat(window, first)
        out = whole >> np.uint64(32)
        out[1:] |= whole[:-1] & np.uint64(0xFFFFFFFF)
        bits.append(out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8])
        marks.append((starts[::LANE] + 8 * done).astype("<u4").tobytes())
        done += len(bits[-1])
    return b"".join(bits), b"".join(marks)


def decode_block(bits: bytes, checkpoints: bytes, n: int, table: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The n ids of a block; all lanes advance together, one table lookup a step."""
    out = np.zeros((-(-n // LANE), LANE), np.uint32)
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.int64)
    word = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    stop = 8 * len(bits)
    for k in range(LANE):
        got = table[(word[at >> 3] >> (40 - limit - (at & 7))) & ((1 << limit) - 1)]
        out[:, k] = got >> 5
        at = np.minimum(at + (got & 31), stop)
    return out.reshape(-1)[:n]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, n_tokens, used, times): ids with the end id, as little-endian unsigned integers of id_width(tokenizer) bytes.

    The first row of each slice of a task has the slice's counts: used are the ids that occur in it, times their numbers.
    """
    width = id_width(tokenizer)

    def make():
        encode = encoder(tokenizer)

        def each(rows):
            ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(f"<u{width}") for x in encode(rows["text"])]
            times = np.bincount(np.concatenate(ids))
            used = np.flatnonzero(times)
            none = [None] * (len(ids) - 1)
            counts = {"used": [used.astype("<u4").tobytes(), *none], "times": [times[used].astype("<u4").tobytes(), *none]}
            return {"doc_id": rows["doc_id"], "ids": [x.tobytes() for x in ids], "n_tokens": [len(x) for x in ids], **counts}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, ids binary, n_tokens long, used binary, times binary")


def id_width(tokenizer: str) -> int:
    """2 bytes if all ids fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Global count of each id, from the counts of tokenize's slices. The result has one row for each id of the vocabulary."""

    def make():
        def each(rows):
            ids, times = (np.frombuffer(b"".join(rows[c]), "<u4") for c in ("used", "times"))
            n = np.bincount(ids, times).astype(np.int64)
            used = np.flatnonzero(n)
            return {"id": used.tolist(), "n": n[used].tolist()}

        return each

    counted = tokens.select("used", "times").where(F.col("used").isNotNull())
    found = map_rows(counted, make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


_BLOCKS = "inside long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, bits binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of docs in ascending doc_id order under path: blocks/ and codebook/.

    A block is a run of whole documents, closed at BLOCK tokens or more; a longer document has a block
    of its own. Shards are ranges of doc_id of about SHARD_TOKENS tokens; a block knows the tokens
    before it in its shard. Rows with equal doc_id follow each other in order of their ids, rows
    without an id come first, null text is empty. An empty table gives an empty file set.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer)
    tokens = stage(tokenize(docs, tokenizer), "ids")
    lengths = code_lengths(id_counts(tokens))
    codes = canonical_codes(lengths)
    book = spark.sparkContext.broadcast((lengths, codes))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    ranged = tokens.select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")

    def make():
        lengths, codes = book.value
        inside = 0

        def each(rows):
            nonlocal inside
            out = {n: [] for n in ("inside", "doc_ids", "doc_tokens", "checkpoints", "bits")}
            held: list[np.ndarray] = []
            who: list = []
            size, last = 0, len(rows["doc_id"]) - 1
            for k, (doc_id, ids) in enumerate(zip(rows["doc_id"], rows["ids"], strict=True)):
                held.append(np.frombuffer(ids, f"<u{width}"))
                who.append(doc_id)
                size += len(held[-1])
                if size >= BLOCK or k == last:
                    bits, marks = encode_block(np.concatenate(held), lengths, codes)
                    for n, v in zip(out, (inside, who, [len(x) for x in held], marks, bits), strict=True):
                        out[n].append(v)
                    inside += size
                    held, who, size = [], [], 0
            return out

        return each

    blocks = map_rows(ranged, make, _BLOCKS).select(F.spark_partition_id().alias("shard"), "*")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(lengths.astype("u1").tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document with its ids as little-endian unsigned 32-bit, decoded block by block.

    start is the number of ids of all documents before it in the files. Only the sizes of the shards
    (one row for each SHARD_TOKENS ids) are summed on the driver and broadcast.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], "u1").astype(np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    size = F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.groupBy("shard").agg(F.sum(size).alias("n")).collect()
    before, run = {}, 0
    for shard, n in sorted(map(tuple, sums)):
        before[shard] = run
        run += n
    book = spark.sparkContext.broadcast((lengths, before))

    def make():
        lengths, before = book.value
        table = decoding_table(lengths)

        def each(rows):
            out = {n: [] for n in ("doc_id", "start", "ids")}
            for shard, inside, who, sizes, marks, bits in zip(*(rows[c] for c in ("shard", "inside", "doc_ids", "doc_tokens", "checkpoints", "bits")), strict=True):
                ids, at = decode_block(bits, marks, sum(sizes), table), 0
                for doc_id, n in zip(who, sizes, strict=True):
                    for c, v in zip(out, (doc_id, before[shard] + inside + at, ids[at : at + n].astype("<u4").tobytes()), strict=True):
                        out[c].append(v)
                    at += n
            return out

        return each

    return map_rows(blocks.select("shard", "inside", "doc_ids", "doc_tokens", "checkpoints", "bits"), make, "doc_id long, start long, ids binary")


def digests(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_ids rows."""
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """write_ids to a new folder in the shared one, then digests of read_ids."""
    path = stage_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return digests(read_ids(docs.sparkSession, path))
