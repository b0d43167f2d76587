"""SimHash near-dedup: fingerprints, pivot distance tables, and components of the links."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.names import fresh
from lacuna.llm.rows import drop_ids, keep_one_of_repeats, map_rows, small
from lacuna.operators.components import connected_components
from lacuna.sources.staging import stage

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Reference fingerprints, from a fixed seed.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.arange(32, dtype=np.uint64) % np.uint64(2)
#: Bits of the five bands; with 3 or fewer differing bits two bands at least are equal.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints that one task compares at once; a larger band group is dealt in pairs of blocks of this size.
BLOCK = 2_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of a whole text; no words: 0. Null is the empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - SHINGLE + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the fingerprint as a signed long."""

    def make():
        def each(rows):
            return {"doc_id": rows["doc_id"], "fp": np.array([fingerprint(t) for t in rows["text"]], np.uint64).view(np.int64)}

        return each

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, fp long")


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, distances): Hamming distances to the reference fingerprints, one byte each, for each fp row."""

    def make():
        def each(rows):
            x = np.array(rows["fp"], np.int64).view(np.uint64)
            d = np.bitwise_count(x[:, None] ^ PIVOTS[None, :])
            return {"fp": rows["fp"], "distances": [r.tobytes() for r in d]}

        return each

    return map_rows(fps.select("fp"), make, "fp long, distances binary")


def near_pairs(x: np.ndarray, d: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of fingerprints x that differ in at most max_bits bits; d: their pivot distances.

    |d(a, p) - d(b, p)| is at most the distance of a and b for every pivot p. So rows are put in order of
    the first pivot's distance, compared inside its window only, and pairs fall away pivot after pivot
    by their largest coordinate difference; what survives is verified on the fingerprints themselves.
    """
    order = np.argsort(d[:, 0], kind="stable")
    x, d = x[order], d[order].astype(np.int16)
    last = np.searchsorted(d[:, 0], d[:, 0] + max_bits, side="right")
    found = [], []
    step = 256
    for at in range(0, len(x), step):
        rows = np.arange(at, min(at + step, len(x)))
        n = last[rows] - rows - 1
        i = np.repeat(rows, n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + i + 1
        for p in range(1, d.shape[1]):
            near = np.abs(d[i, p] - d[j, p]) <= max_bits
            fewer = np.count_nonzero(near)
            i, j, stop = i[near], j[near], 10 * fewer > 9 * len(near)
            if stop and p >= 4 or not fewer:  # further pivots would hardly discard any
                break
        near = np.bitwise_count(x[i] ^ x[j]) <= max_bits
        found[0].append(order[i[near]])
        found[1].append(order[j[near]])
    empty = np.zeros(0, np.int64)
    return np.concatenate(found[0] or [empty]), np.concatenate(found[1] or [empty])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The links of a spanning forest of n nodes out of the pairs (i, j)."""
    up = list(range(n))
    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = a, b
        while up[ra] != ra:
            up[ra] = ra = up[up[ra]]
        while up[rb] != rb:
            up[rb] = rb = up[up[rb]]
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def band_keys(fp: F.Column) -> list[F.Column]:
    """One key for each choice of two bands: its number and the bits of both."""
    parts, at = [], 0
    for n in BANDS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)))
        at += n
    return [F.lit(k).cast("long") * F.lit(1 << 26) + parts[a] * F.lit(1 << 13) + parts[b] for k, (a, b) in enumerate(combinations(range(len(BANDS)), 2))]


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """(src, dst) links of fingerprints that differ in at most MAX_BITS bits; enough to span each component.

    Fingerprints of one link share two of the five bands, so they meet under one of ten keys. A key's
    group of over BLOCK rows is dealt in blocks, and each pair of blocks is a group of its own: no task
    grows with the group, and no pair is skipped. Inside a group pairs are found by the pivot table and
    only a spanning forest of the verified ones is returned, so large groups don't make all their pairs.
    """
    keyed = distinct_fps.select("fp", F.explode(F.array(*band_keys(F.col("fp")))).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    deal = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    both = deal.withColumn("b", mine).select("fp", "key", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    met = both.select("fp", "key", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"))
    groups = met.join(pivot_table(distinct_fps), "fp").groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("fp", "distances")).alias("rows"))

    def make():
        def each(rows):
            src, dst = [], []
            for group in rows["rows"]:
                group = sorted(group, key=lambda r: r["fp"])
                fps = np.array([r["fp"] for r in group], np.int64)
                d = np.frombuffer(b"".join(r["distances"] for r in group), np.uint8).reshape(len(group), -1)
                for a, b in spanning(len(group), *near_pairs(fps.view(np.uint64), d)):
                    src.append(int(fps[a]))
                    dst.append(int(fps[b]))
            return {"src": src, "dst": dst}

        return each

    return map_rows(groups.select("rows"), make, "src long, dst long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    fingerprint is 16 lowercase hex digits; component_id the smallest doc_id that can be reached over
    links of at most MAX_BITS differing bits. Equal fingerprints (null, empty and space-only texts all
    have zero) form one class before any pair is looked at. Rows without an id get the component's
    smallest id, or null if it has none. Repeated rows repeat; an empty table gives no rows.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(fingerprint_links(classes.select("fp")))
    merged = classes.join(found.withColumnRenamed("node", "fp"), "fp")
    best = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = merged.join(best, "component").select("fp", "component_id")
    # Written before it is joined back, so that the rows of a hot fingerprint can be split.
    named = stage(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return fps.join(small(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate component: that with the smallest doc_id, once. Rows without an id stay.

    A doc_id with several fingerprints (colliding ids) is decided for each of its texts; only such rows are fingerprinted again.
    """
    seen = stage(near_groups(docs).where("doc_id IS NOT NULL"), "near")
    by_id = seen.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"), F.count("*").alias("n"))
    by_id = stage(by_id.where("n > 1"), "repeated")
    dropped = stage(seen.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    if not by_id.where("a <> b").take(1):
        return keep_one_of_repeats(drop_ids(docs, dropped), by_id)
    (own,) = fresh(docs.columns, "fingerprint")
    several = stage(by_id.where("a <> b").select("doc_id"), "several")
    rest = docs.join(small(several), "doc_id", "left_anti")
    plain = keep_one_of_repeats(drop_ids(rest, dropped), by_id.where("a = b"))
    kept = seen.join(small(several), "doc_id", "left_semi").where("doc_id = component_id").select("doc_id", F.col("fingerprint").alias(own)).distinct()

    @F.pandas_udf("string")
    def hex_fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t):016x}" for t in texts], dtype=str)

    mine = docs.join(small(several), "doc_id", "left_semi").withColumn(own, hex_fingerprint(F.col("text").cast("string")))
    return plain.unionByName(mine.join(kept, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own]).select([f"`{c}`" for c in docs.columns]))
