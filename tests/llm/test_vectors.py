"""Vector codes, hard negatives and sharding against brute force, and their odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import codes, negatives, sharding
from lacuna.llm.queries import QUERIES

ODD = "vec_id long, embedding array<float>, label int, length int, vector int, grp int, row int, id int, asks int"


def vectors(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (6, d))
    return (middles[rng.integers(0, 6, n)] + rng.normal(0, spread, (n, d))).astype(np.float32)


def brute_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector) in any order; plain loops over Python integers."""
    d = len(rows[0][1]) // parts
    ints = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    books = [[v[j * d : (j + 1) * d] for _, v in sorted(ints)[:entries]] for j in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            met = defaultdict(list)
            for _, v in ints:
                met[nearest(v[j * d : (j + 1) * d], books[j])[1]].append(v[j * d : (j + 1) * d])
            books[j] = [[sum(c) // len(met[k]) for c in zip(*met[k])] if k in met else e for k, e in enumerate(books[j])]
    out = []
    for i, v in ints:
        got = [nearest(v[j * d : (j + 1) * d], books[j]) for j in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(e for e, _ in got)))
    return out, books


@pytest.mark.parametrize("n, d, spread, block", [(300, 8, 0.3, 8192), (300, 8, 0.0, 97), (5, 4, 0.5, 8192), (700, 12, 0.02, 256)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, n, d, spread, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    monkeypatch.setattr(codes, "LEAF", 8)
    x = vectors(n, d, n, spread)
    rows = [(int(i), v.tolist(), int(i) % 3) for i, v in zip(np.random.default_rng(1).permutation(n) * 3, x)]
    coded, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2, entries=16, rounds=3, scale=64)
    want, want_books = brute_codes([(i, v) for i, v, _ in rows], 2, 16, 3, 64)
    assert books.tolist() == want_books
    got = {r["id"]: r for r in coded.collect()}
    assert len(got) == n and {(i, r["code"], r["error"]) for i, r in got.items()} == set(want)
    total = Counter()
    for i, _, error in want:
        total[str(next(g for k, _, g in rows if k == i))] += error
    assert all(r["group_error"] == total[r["grp"]] for r in got.values())


def test_nodes_are_assigned_whole_where_boxes_decide():
    """Four far clusters: no leaf needs a comparison, and the cached sums are the points'."""
    x = np.concatenate([np.full((50, 3), 1000 * k) + np.arange(150).reshape(50, 3) % 7 for k in range(4)])
    entries = codes.Tree(np.array([[1000 * k] * 3 for k in range(4)]), 2)
    tree = codes.Tree(x, codes.depth(len(x), 8))
    calls, plain = [], codes.squared
    codes.squared = lambda *a: calls.append(1) or plain(*a)
    try:
        got, sums, counts = codes.assign(tree, entries)
    finally:
        codes.squared = plain
    assert not calls or len(calls) < 4  # a leaf across two clusters may be left
    assert got[np.argsort(tree.order)].tolist() == [k for k in range(4) for _ in range(50)]
    assert counts.tolist() == [50] * 4 and sums.tolist() == [x[50 * k : 50 * k + 50].sum(0).tolist() for k in range(4)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    good = [(k, [0.1 * k, -0.2 * k, 0.3, 0.05 * k], k % 2, 9, 9, 9, 9, 9, 9) for k in range(12)]
    bad = [(100, None, 0), (101, [0.1, None, 0.2, 0.3], 0), (102, [nan, 0.0, 0.0, 0.0], 1), (103, [inf, 0.0, 0.0, 0.0], 1), (104, [], 1), (105, [1.0], 0)]
    also = [(None, [0.5, 0.5, 0.5, 0.5], 1), (3, [0.3, -0.6, 0.3, 0.15], 1), (7, [9.0, 9.0, 9.0, 9.0], None), (200, [1e30, -1e30, 0.0, 1.0], 0)]
    return good + [(*r, None, 1, None, 2, None, 3) for r in bad + also]


def test_codes_of_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD)
    coded, books = codes.compress(df, parts=4, entries=4, rounds=2)
    got = coded.collect()
    assert Counter(r["id"] for r in got) == Counter([*range(12), None, 3, 7, 200]) and books.shape == (4, 4, 1)
    assert all(len(r["code"]) == 8 and r["error"] >= 0 for r in got)
    assert {r["grp"] for r in got} == {"0", "1", None}
    empty, none = codes.compress(df.limit(0))
    assert empty.count() == 0 and none.size == 0
    with pytest.raises(ValueError, match="256"):
        codes.compress(df, entries=300)


def test_codes_can_be_decoded(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = codes.compress(df)
    both = codes.decode(coded, books).join(df.withColumnRenamed("vec_id", "id"), "id").select("vector", "embedding", "error").collect()
    for r in both[:50]:
        ints = np.floor(1024 * np.array(r["embedding"], float))
        assert ((np.floor(1024 * np.array(r["vector"])) - ints) ** 2).sum() == r["error"]


def brute_negatives(rows, asks, positives, negatives_, scale, low=30, high=90):
    """rows: (id, label, vector) that take part."""
    x = [[int(np.floor(scale * float(c))) for c in v] for _, _, v in rows]
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i is None or not asks(i):
            continue
        score = [sum(p * q for p, q in zip(x[a], v)) for v in x]
        order = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-score[k], rows[k][0] is None, rows[k][0] or 0))
        for p in [k for k in order if rows[k][1] == label][:positives]:
            inside = [k for k in order if rows[k][1] != label and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(i, rows[p][0], r, rows[k][0], score[p], score[k]) for r, k in enumerate(inside[:negatives_], 1)]
    return out


@pytest.mark.parametrize("block, chunk", [(4096, 16384), (50, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", chunk)
    x = vectors(400, 10, 5).round(1)  # rounded: many ties
    x[::40] = 0.0  # zero anchors too
    rows = [(int(i), int(i) % 4, v.tolist()) for i, v in zip(np.random.default_rng(2).permutation(400), x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, positives=3, negatives=4, scale=16)
    assert sorted(map(tuple, got.collect())) == sorted(brute_negatives(rows, lambda i: i % 20 == 0, 3, 4, 16))


def test_reading_stops_early():
    """One long vector far ahead of the rest: the lists need not be read to their ends."""
    x = np.random.default_rng(3).integers(-10, 10, (4000, 6))
    x[17] = 1000
    row = {"n": 4000, "ids": list(range(4000)), "rows": list(range(4000)), "labels": ["a"] * 4000, "points": x.astype("<i4").tobytes(), "orders": np.argsort(x.T, axis=1, kind="stable").astype("<u2").tobytes()}
    block, best = negatives.Lists(row), negatives.Best(1)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[1], slice):
                read.append(key[1].stop - key[1].start)
            return np.asarray(self)[key]

    block.order = block.order.view(Watched)
    negatives.threshold_scan(block, np.ones(6, np.int64), np.ones(4000, bool), [best])
    assert best.rows[0][3] == 17 and sum(read) < 200


def test_negatives_of_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    kept = [(r[0], r[2], r[1]) for r in odd_rows() if r[2] is not None and r[1] and len(r[1]) == 4 and all(c is not None and np.isfinite(c) for c in r[1])]
    kept = [k for k in kept if k[0] != 200]
    got = negatives.hard_negatives(df.where("vec_id IS NULL OR vec_id <> 200"), F.col("vec_id") % 3 == 0)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_negatives(kept, lambda i: i % 3 == 0, 5, 10, 256)))
    held = negatives.hard_negatives(df, F.col("vec_id") % 3 == 0).collect()  # components of 1e30 are held, not wrapped
    assert held and all(abs(r["negative_score"]) < 1 << 62 for r in held)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0


def check_shards(got, rows, shards):
    """rows: (doc_id, text, source). Whole result, laws, gapless slots and the mixture of each shard."""
    data = [(i, (t or "").encode(), s) for i, t, s in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b, _ in data)
    assert {r["law"] for r in got} <= {"rows"} and {r["grown_shard"] for r in got} <= {None}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


def test_shards_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = QUERIES["op13_sharding"](spark, sf_dir).collect()
    check_shards(got, rows, 24)
    source, total = {i: s for i, _, s in rows}, Counter(s for _, _, s in rows)
    mix = Counter((r["shard"], source[r["doc_id"]]) for r in got)
    assert all(abs(mix[k, s] - n / 24) < len(total) + 1 for s, n in total.items() for k in range(24))
    again = sharding.assign_shards(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    other = sharding.assign_shards(docs, seed=14).collect()
    assert {(r["doc_id"], r["shard"]) for r in got} != {(r["doc_id"], r["shard"]) for r in other}


def test_shards_follow_the_fractional_ranks(spark):
    """By the definition: ranks by the seeded hash in each source, sorted by fractional rank, cut."""
    rows = [(k, f"text {k}", "abc"[0 if k % 10 < 7 else 1 + k % 2]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    data = F.col("text").cast("binary")
    turns = df.select("doc_id", "source", F.xxhash64(F.lit(13), "doc_id", F.length(data).cast("long") + 8, F.crc32(data)).alias("h")).collect()
    strata = defaultdict(list)
    for r in sorted(turns, key=lambda r: r["h"]):
        strata[r["source"]].append(r["doc_id"])
    line = sorted(((k + 0.5) / len(ids), s, i) for s, ids in strata.items() for k, i in enumerate(ids))
    want = {(i, at * 24 // 200) for at, (_, _, i) in enumerate(line)}
    assert {(r["doc_id"], r["shard"]) for r in sharding.assign_shards(df).collect()} == want


def test_shards_of_odd_rows(spark, tmp_path):
    same = [(1, "twin", "a")] * 30
    rows = same + [(None, None, None), (None, "x", "a"), (2, "", "b"), (3, None, "b"), (4, "ä " * 5000, None), (2, "", "b")]
    schema = "doc_id long, text string, source string, slot int, turn string, `a.b` int, row int, doc int"
    df = spark.createDataFrame([(*r, 1, "t", 2, 3, 4) for r in rows], schema).repartition(3)
    check_shards(sharding.assign_shards(df, 5).collect(), rows, 5)
    check_shards(sharding.assign_shards(df.limit(2), 5).collect(), [tuple(r)[:3] for r in df.limit(2).collect()], 5)
    assert sharding.assign_shards(df.limit(0)).count() == 0
    sharding.write_shards(df, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(tuple(r)[:8] for r in back.select(*[f"`{c}`" for c in df.columns], "slot_1", "shard").collect()) == Counter(map(tuple, df.collect()))
    sizes = Counter(r["shard"] for r in back.select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot_1"] for r in back.where(f"shard = {k}").collect()) == list(range(n)) for k, n in sizes.items())


CLASHES = "length prefix hashed open keep again size fingerprint fp component_id kept keep_id group_size held_out score item_id count a b n u v key rows id row _prefix _length _full _open _keep _again _fp text_sha256 n_tokens ids place".split()


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """All stages on odd and empty rows with extra columns: the same documents as without them, every column as it was."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "Null id, some words.", "en", "s", 5), (-1, "", "en", "s", 0), (-2, None, "de", None, None), (-3, "same id, one text", "en", "s", 3), (-3, "same id, other text", "en", "s", 3), (-4, "twin of words", "en", "s", 3), (-4, "twin of words", "en", "s", 3)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    names = [*CLASHES, "a.b", "Text2"]
    wide = docs.select("*", *[F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for k, n in enumerate(names)])
    for name, step in corpus_pipeline.STAGES[:-1]:
        got, want = step(spark, wide, sf_dir), step(spark, docs, sf_dir)
        assert got.columns == wide.columns, name
        rows = got.collect()
        ids = lambda rows: Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
        assert ids(rows) == ids(want.collect()), name
        assert all(r[n] == f"{k}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for k, n in enumerate(names)), name
        assert step(spark, wide.limit(0), sf_dir).count() == 0, name
    name, pack = corpus_pipeline.STAGES[-1]
    few = wide.where("doc_id IS NULL OR doc_id < 20")
    pieces = pack(spark, few, sf_dir).select("doc_id", "length").collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(r["doc_id"] for r in pack(spark, few.select(docs.columns), sf_dir).collect())
    assert pack(spark, wide.limit(0), sf_dir).count() == 0
