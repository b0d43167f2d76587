"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, unedited pieces, exact edit verification."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.rows import drop_ids, map_rows
from lacuna.sources.staging import stage

#: A window is a leak if its word edit distance to the item is at most (1 - SIMILARITY) of the item's words.
SIMILARITY = 0.8
#: Chance to find a window with as many edits as its item allows by sampling alone, in each class of items; it sets how often
#: sampling is repeated, up to MOST_REPEATS. PROBES items are tried in each class.
TARGET_RECALL, MOST_REPEATS, PROBES = 0.9, 60, 200
#: Sampled places: the first ones among the first HEAD steps, the others anywhere in the item's embedding.
HEAD, HEAD_SAMPLES, TAIL_SAMPLES, WALKS = 16, 3, 1, 4
#: Items that are held as one broadcast block; a larger benchmark is worked through block after block.
ITEM_BLOCK = 100_000
SEED = 5
#: Words of documents that are embedded at once.
STEP = 1 << 17

#: Letters and vowel signs of scripts that are written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
ALONE = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf\u1000-\u103f\u1050-\u109d\u1780-\u17d3"
    "\u3005-\u3007\u3041-\u3096\u30a1-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
)
_WORDS = re.compile(r"[^\W_]+").findall
_ALONE, _UNITS = re.compile(f"[{ALONE}]").search, re.compile(f"[{ALONE}]|[^\\W_{ALONE}]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; each character of ALONE is a word of its own. Null is empty."""
    text = (text or "").lower()
    return _WORDS(text) if text.isascii() or not _ALONE(text) else _UNITS(text)


@dataclass
class Repeat:
    """One repetition of the sampling: a walk, the first steps, and for each item length the later steps."""

    walk: int
    head: np.ndarray  # HEAD_SAMPLES steps
    tails: np.ndarray  # (lengths, TAIL_SAMPLES) steps
    heads: np.ndarray  # sorted (head key, length) pairs of the items
    lengths: np.ndarray  # place in tails of each of them
    sieve: np.ndarray  # which head keys modulo its size occur
    keys: np.ndarray  # sorted complete keys of the items
    items: np.ndarray  # item of each of them


@dataclass
class Pieces:
    """Pieces of one length of the items: an item with room for k edits is cut into k + 1, so that a match has one unedited."""

    size: int
    sieve: np.ndarray  # which piece keys modulo its size occur
    keys: np.ndarray  # sorted keys of the pieces
    items: np.ndarray  # item of each of them
    offsets: np.ndarray  # its place in the item


@dataclass
class Index:
    vocabulary: dict[str, int]  # word to id from 1; 0 is any other word
    mixed: np.ndarray  # random number of each word id; the last one, of the pad, is 0
    turns: np.ndarray  # (WALKS, steps) odd factors: a word's coin at a step is the top bit of factor * mixed
    items: list[tuple[int | None, np.ndarray]]
    early: np.ndarray  # (WALKS, words): bit s says that some item has the word at step s of the walk, up to HEAD
    repeats: list[Repeat]
    pieces: list[Pieces]
    sizes: np.ndarray  # words of each item
    members: np.ndarray  # sieve of (item, word)
    recall: dict[int, float]  # share of edited copies that sampling alone finds, by bits of the number of edits

    @property
    def pad(self) -> int:
        return len(self.mixed) - 1


_ODD = np.int64(0x5851F42D4C957F2D)


def _sieve(keys: np.ndarray) -> np.ndarray:
    """Which keys modulo its size, a power of two of at least 16 times their number, occur."""
    out = np.zeros(1 << min(26, max(20, (16 * len(keys)).bit_length())), bool)
    out[keys & (len(out) - 1)] = True
    return out


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a key and one more sampled word; equal keys are verified by edit distance later on."""
    key = (key ^ (word + np.int64(0x2545F491))) * _ODD
    return key ^ (key >> np.int64(29))


def _member(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(np.zeros(len(item), np.int64), item), word)


def _walk(mixed_ids: np.ndarray, at: np.ndarray, turns: np.ndarray, upto: int):
    """Places at each step of the CGK walk from at: a step copies the word and moves on if its coin says so.

    A pad's coin is always 0, so no walk passes one; the last of mixed_ids is a pad's.
    """
    for step in range(upto):
        yield step, at
        coins = mixed_ids.take(at)
        coins *= turns[step]
        coins >>= np.uint64(63)
        at = at + coins.view(np.int64)


def embed(texts: list[np.ndarray], index: Index, walk: int, asked: np.ndarray) -> np.ndarray:
    """(texts, samples): the words of the CGK string of each text at its own asked steps; past its end the pad word."""
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    ids = np.full(int(begins[-1]), index.pad, np.int64)
    for b, x in zip(begins, texts, strict=False):
        ids[b : b + len(x)] = x
    out = np.zeros(asked.size, np.int64)
    order = np.argsort(asked, axis=None, kind="stable")
    upto = int(asked.max(initial=-1)) + 1
    cuts = np.searchsorted(asked.reshape(-1)[order], np.arange(upto + 1))
    for step, at in _walk(index.mixed.take(ids), begins[:-1], index.turns[walk], upto):
        hit = order[cuts[step] : cuts[step + 1]]
        if len(hit):
            out[hit] = ids.take(at[hit // asked.shape[1]])
    return out.reshape(asked.shape)


def _head_key(words: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(words[0]), np.int64)
    for w in words:
        key = _mix(key, w)
    return key


def build_index(items: list[tuple[int | None, str | None]]) -> Index:
    """LSH keys of items; how often the sampling is repeated is set by the recall measured on edited copies of the items."""
    split = [(i, w) for i, t in items if (w := words_of(t))]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
    coded = [(i, np.array([vocabulary[w] for w in ws], np.int64)) for i, ws in split]
    rng = np.random.default_rng(SEED)
    mixed = rng.integers(1, 1 << 63, len(vocabulary) + 2, dtype=np.uint64)
    mixed[-1] = 0
    sizes = sorted({len(x) for _, x in coded})
    turns = rng.integers(0, 1 << 63, (WALKS, max(HEAD, 2 * max(sizes, default=1))), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    texts = [x for _, x in coded]
    owner = np.repeat(np.arange(len(coded)), [len(x) for x in texts])
    members = _sieve(_member(owner, np.concatenate([*texts, np.zeros(0, np.int64)])))
    early = np.zeros((WALKS, len(mixed)), np.uint16)
    index = Index(vocabulary, mixed, turns, coded, early, [], _cut(texts), np.array([len(x) for x in texts], np.int64), members, {})
    if not coded:
        return index
    for walk in range(WALKS):
        for step, words in enumerate(embed(texts, index, walk, np.tile(np.arange(HEAD), (len(texts), 1))).T):
            early[walk, words] |= np.uint16(1 << step)
    samples: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k in range(MOST_REPEATS):
        head = np.sort(rng.choice(HEAD, HEAD_SAMPLES, replace=False))
        draws = np.sort(rng.random(TAIL_SAMPLES))
        tails = np.array([np.maximum(head[-1], draws * 2 * n * 0.6).astype(np.int64) for n in sizes])
        samples.append((k % WALKS, head, tails))
    place = {n: k for k, n in enumerate(sizes)}
    at = np.array([place[len(x)] for x in texts])
    many, index.recall = _repeats(texts, index, place, samples)
    samples = samples[:many]
    words = _sampled(texts, index, at, samples)
    for k, (walk, head, tails) in enumerate(samples):
        mine = words[:, k]
        key = _head_key(list(mine[:, :HEAD_SAMPLES].T))
        pairs = np.unique(np.stack([key, at], 1), axis=0)
        full = _mix(key, at)
        for s in range(HEAD_SAMPLES, mine.shape[1]):
            full = _mix(full, mine[:, s])
        order = np.argsort(full, kind="stable")
        index.repeats.append(Repeat(walk, head, tails, pairs[:, 0], pairs[:, 1], _sieve(pairs[:, 0]), full[order], order))
    return index


def _sampled(texts: list[np.ndarray], index: Index, lengths: np.ndarray, samples: list) -> np.ndarray:
    """(texts, repetitions, samples): words of the texts' embeddings, sampled as for items of the given lengths (places in tails)."""
    out = np.zeros((len(texts), len(samples), HEAD_SAMPLES + TAIL_SAMPLES), np.int64)
    for walk in range(WALKS):
        mine = [k for k, s in enumerate(samples) if s[0] == walk]
        if mine:
            steps = np.stack([np.concatenate([np.repeat(samples[k][1][None], len(texts), 0), samples[k][2][lengths]], 1) for k in mine], 1)
            out[:, mine] = embed(texts, index, walk, steps.reshape(len(texts), -1)).reshape(steps.shape)
    return out


def _repeats(texts: list[np.ndarray], index: Index, place: dict[int, int], samples: list) -> tuple[int, dict[int, float]]:
    """(repetitions, recall of each class then) after which copies with all edits that their items allow are found at TARGET_RECALL in each class of items.

    Classes are powers of two of the number of edits. Where MOST_REPEATS aren't enough, which the recall shows, pieces find the rest.
    """
    rng = np.random.default_rng(SEED + 1)
    classes: dict[int, list[np.ndarray]] = {}
    for k in rng.permutation(len(texts)).tolist():
        held = classes.setdefault(slack_of(len(texts[k])).bit_length(), [])
        if len(held) < PROBES:
            held.append(texts[k])
    probes = [x for held in classes.values() for x in held for _ in range(max(1, PROBES // len(held) if len(held[0]) < 1000 else 1))]
    kind = np.array([slack_of(len(x)).bit_length() for x in probes])
    lengths = np.array([place[len(x)] for x in probes])
    edited = [_edit(x, slack_of(len(x)), rng) for x in probes]
    found = (_sampled(probes, index, lengths, samples) == _sampled(edited, index, lengths, samples)).all(2)
    found = np.logical_or.accumulate(found, axis=1)
    recall: dict[int, float] = {}
    for k in range(len(samples)):
        recall = {c: float(found[kind == c, k].mean()) for c in sorted(classes)}
        if all(p - math.sqrt(p * (1 - p) / (kind == c).sum()) >= TARGET_RECALL for c, p in recall.items()):  # less what chance may have added
            return k + 1, recall
    return len(samples), recall


def slack_of(length: int) -> int:
    """Edits that an item of so many words may have."""
    return int(length * (1 - SIMILARITY) + 1e-9)


def _cut(items: list[np.ndarray]) -> list[Pieces]:
    """The items' pieces by length; all are at most five words."""
    cut: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    for k, x in enumerate(items):
        many = slack_of(len(x)) + 1
        ends = [len(x) * i // many for i in range(many + 1)]
        for a, b in zip(ends, ends[1:], strict=False):
            cut.setdefault(b - a, []).append((x[a:b], k, a))
    out = []
    for size, rows in sorted(cut.items()):
        key = _head_key(list(np.array([p for p, _, _ in rows]).T))
        order = np.argsort(key, kind="stable")
        out.append(Pieces(size, _sieve(key), key[order], np.array([k for _, k, _ in rows])[order], np.array([a for _, _, a in rows])[order]))
    return out


def seeded(ids: np.ndarray, index: Index) -> np.ndarray:
    """Rows (place, item number, the place's offset in the item) wherever a piece of an item stands in ids: every match has such a row."""
    out = [np.zeros((0, 3), np.int64)]
    for p in index.pieces:
        many = len(ids) - p.size + 1
        if many < 1:
            continue
        key = _head_key([ids[s : s + many] for s in range(p.size)])
        alive = np.flatnonzero(p.sieve.take(key & (len(p.sieve) - 1)))
        w, k = _spans(p.keys, key[alive])
        out.append(np.stack([alive[w], p.items[k], p.offsets[k]], 1))
    return np.concatenate(out)


def _spans(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, place in sorted_keys) of all equal pairs."""
    lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
    n = hi - lo
    return np.repeat(np.arange(len(keys)), n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def candidates(ids: np.ndarray, index: Index) -> np.ndarray:
    """Rows (window start, item number) whose sampled words agree in some repetition, as often as they do; ids may hold many texts apart.

    All windows walk together. Those that have a word where no item has it at that step, or whose first sampled words
    together are no item's, fall away; the rest walk
    on alone, so what is found is what complete sampling of every window finds.
    """
    out = [np.zeros((0, 2), np.int64)]
    pad = index.pad
    ids = np.append(ids, pad)
    mixed = index.mixed.take(ids)
    starts = np.flatnonzero((ids > 0) & (ids < pad))  # a first word that is in no item can match none
    for walk in sorted({r.walk for r in index.repeats}):
        mine = [r for r in index.repeats if r.walk == walk]
        seen, may = {}, {}
        turns = index.turns[walk]
        wanted = {int(s) for r in mine for s in r.head}
        for step, at in _walk(mixed, starts, turns, max(wanted) + 1):
            if step in wanted:
                seen[step] = ids.take(at)
                may[step] = index.early[walk].take(seen[step]) & np.uint16(1 << step) > 0
        for r in mine:
            alive = np.flatnonzero(np.logical_and.reduce([may[int(s)] for s in r.head]))
            key = _head_key([seen[int(s)].take(alive) for s in r.head])
            hit = np.flatnonzero(r.sieve.take(key & (len(r.sieve) - 1)))
            alive, key = alive[hit], key[hit]
            w, k = _spans(r.heads, key)
            if not len(w):
                continue
            origin, size, head = starts[alive[w]], r.lengths[k], key[w]
            full = _mix(head, size)
            steps = r.tails[size]
            walkers, back = np.unique(origin, return_inverse=True)
            words = np.zeros((TAIL_SAMPLES, len(origin)), np.int64)
            asked = set(np.unique(steps).tolist())
            for step, at in _walk(mixed, walkers, turns, int(steps.max()) + 1):
                if step in asked:
                    now = ids.take(at)
                    for s in range(TAIL_SAMPLES):
                        hit = np.flatnonzero(steps[:, s] == step)
                        words[s, hit] = now[back[hit]]
            for s in range(TAIL_SAMPLES):
                full = _mix(full, words[s])
            a, b = _spans(r.keys, full)
            out.append(np.stack([origin[a], r.items[b]], 1))
    return np.concatenate(out)


def _edit(x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """x after so many replacements, insertions or removals at random places."""
    out = x.tolist()
    for _ in range(edits):
        at = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[at] = 0
        elif kind == 1:
            out.insert(at, 0)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.int64)


def _costs(item: np.ndarray, text: np.ndarray, anywhere: bool) -> np.ndarray:
    """Least edit distance of the whole item to a stretch of text that ends at each place; it begins anywhere, or at the first word."""
    up = np.arange(len(item) + 1)
    cost = up.copy()
    out = np.empty(len(text) + 1, np.int64)
    out[0] = cost[-1]
    for j, word in enumerate(text, 1):
        now = np.minimum(cost + 1, np.append(0 if anywhere else j, cost[:-1] + (item != word)))
        if anywhere:
            now[0] = 0
        cost = np.minimum.accumulate(now - up) + up
        out[j] = cost[-1]
    return out


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): least word edit distance of the whole item to any window of text, the leftmost end and shortest window of ties."""
    item, text = np.asarray(item), np.asarray(text)
    ends = _costs(item, text, True)
    end = int(ends.argmin())
    back = _costs(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(back.argmin()), end


def leaks_of(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start word, end word, edits) for each item that a window of a text matches, the best window of each."""
    get, pad = index.vocabulary.get, index.pad
    out: list[tuple[int, int, int, int, int]] = []
    held: list[np.ndarray] = []
    first, size = 0, 0
    for k, text in enumerate(texts):
        words = words_of(text)
        held.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        size += len(words)
        if size >= STEP or k == len(texts) - 1:
            out += [(first + t, *rest) for t, *rest in _verified(held, pad, index)]
            held, first, size = [], k + 1, 0
    return out


def _verified(texts: list[np.ndarray], pad: int, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Exact edit distance in the candidate windows, with room for the edits on both sides; overlapping windows of an item are one."""
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    joined = np.full(int(begins[-1]), pad, np.int64)
    for b, t in zip(begins, texts, strict=False):
        joined[b : b + len(t)] = t
    hashed = candidates(joined, index)
    piece = seeded(joined, index)
    # (text's word, item, place of the item's start) once each, as one number.
    many, widest = len(index.items) + 1, int(index.sizes.max(initial=0)) + 1
    at = np.concatenate([hashed[:, 0], piece[:, 0]])
    start = at - np.concatenate([np.zeros(len(hashed), np.int64), piece[:, 2]])
    begin = np.searchsorted(begins, at, side="right") - 1
    key = np.unique((begin * many + np.concatenate([hashed[:, 1], piece[:, 1]])) * (len(joined) + widest) + start + widest)
    rest, start = np.divmod(key, len(joined) + widest)
    owner, number = np.divmod(rest, many)
    start -= widest
    size = index.sizes[number]
    slack = (size * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    lo, hi = np.maximum(begins[owner], start - slack), np.minimum(begins[owner + 1] - 1, start + size + slack)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    windows: list[list[int]] = []  # (text, item, from, to)
    for k in np.flatnonzero(_common(joined, number, lo, hi, index) >= size - slack).tolist():
        t, item = int(owner[k]), int(number[k])
        a, z = int(lo[k] - begins[t]), int(hi[k] - begins[t])
        if windows and windows[-1][:2] == [t, item] and a <= windows[-1][3]:
            windows[-1][3] = z
        else:
            windows.append([t, item, a, z])
    for t, item, lo, hi in windows:
        x = index.items[item][1]
        slack = slack_of(len(x))
        best = found.get((t, item), (slack + 1, 0, 0))
        if best[0] == 0:
            continue
        edits, a, b = best_window(x, texts[t][lo:hi])
        if edits <= slack and (edits, lo + a) < best[:2]:
            found[t, item] = (edits, lo + a, lo + b)
    return sorted((t, k, a, b, e) for (t, k), (e, a, b) in found.items())


def _common(ids: np.ndarray, items: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: Index) -> np.ndarray:
    """How many words of each window lo to hi are the item's, or rarely more; a match has all but its edits. Some 4 million words at once."""
    n = np.maximum(hi - lo, 0)
    out = np.zeros(len(n), np.int64)
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + 1, 1 << 22), side="left")
    for a, z in zip(cuts, np.append(cuts[1:], len(n)), strict=True):
        many = n[a:z]
        row = np.repeat(np.arange(a, z), many)
        at = np.arange(len(row)) + np.repeat(lo[a:z] - np.cumsum(many) + many, many)
        hit = index.members.take(_member(items[row], ids.take(at)) & (len(index.members) - 1))
        out[a:z] = np.bincount(row[hit] - a, minlength=z - a)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits, similarity): one row for each document and item found in it.

    Texts are compared as lower-cased words of letters and digits (in scripts without spaces, as characters); an item is found where a window's
    word edit distance to it is at most 20 % of the item's words (similarity of 0.8 or more). None is
    missed: k edits leave one of an item's k + 1 pieces as it is, and all places of all pieces are looked at. Items
    without a word match nothing, nor do null or empty texts. An item_id with several texts is found where
    one of them is, with the most similar; items without an id are found with a null one. Repeated rows of
    docs repeat their rows; an empty table on either side gives no rows. Items are broadcast in blocks of ITEM_BLOCK rows; a larger
    benchmark takes one pass for each block.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word int, end_word int, edits int, similarity double"
    out = None
    for b in range(blocks):  # all texts of an item_id are in one block
        mine = items.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.xxhash64("text"))), F.lit(blocks)) == b).orderBy("item_id", "text")
        index = docs.sparkSession.sparkContext.broadcast(build_index([(r[0], r[1]) for r in mine.collect()]))

        def make(index=index):
            def each(rows):
                out = {n: [] for n in ("doc_id", "item_id", "start_word", "end_word", "edits", "similarity")}
                if not index.value.items:
                    return out
                best: dict = {}
                for t, k, a, z, edits in leaks_of(rows["text"], index.value):
                    item, x = index.value.items[k]
                    row = (1 - edits / len(x), -a, z, edits)
                    best[t, item] = max(row, best.get((t, item), row))
                for (t, item), (similarity, a, z, edits) in best.items():
                    for n, v in zip(out, (rows["doc_id"][t], item, -a, z, edits, similarity), strict=True):
                        out[n].append(v)
                return out

            return each

        part = map_rows(rows, make, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which an item is found. Rows without an id stay."""
    hits = stage(find_leaks(docs, benchmark).where("doc_id IS NOT NULL").select("doc_id"), "leaks")
    return drop_ids(docs, stage(hits.distinct(), "leaks"))
