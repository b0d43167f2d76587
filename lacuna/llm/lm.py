"""LM scoring: unigram base, and a gated recurrent language model with class-factored softmax, in numpy."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lacuna.llm.rows import bound_batches, crc_mod, map_rows, slices
from lacuna.sources.staging import discard, stage

#: Words of the model's own vocabulary (the most frequent ones), their classes, and the sizes of embedding and state.
VOCABULARY, CLASSES, EMBED, HIDDEN = 4096, 32, 16, 24
#: Documents that advance together at most, in training and in scoring; steps of a window, where gradients are truncated and the
#: state is carried on; tokens after which training begins anew with an empty state (scoring never does).
LANES, SCORE_LANES, WINDOW, SEGMENT = 512, 512, 16, 1024
#: Epochs over all training documents (each ends in an average over all tasks) and step size.
EPOCHS, RATE = 1, 0.06
#: Training tokens of one task, about.
TASK_TOKENS = 4_000_000
FOLDS, HELD_OUT, SEED = 5, 1, 8
#: Words whose counts are broadcast to the encoding tasks at most; the others are looked up by a join.
HEAD_WORDS, LONGEST_HEAD = 200_000, 64
#: Tokens of a text that waits for others of its kind to be scored together, and bytes of ids (two a token) that may wait in a task.
LONG_TEXT, HELD_BYTES = 1024, 16 << 20
#: Distinct words that a task counts before it passes them on, and weights that one task of an averaging round adds up.
COUNTED, FAN_IN = 400_000, 32


def words_of(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8, A-Z in lower case; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def training(docs: DataFrame) -> F.Column:
    return crc_mod("doc_id", FOLDS) != HELD_OUT


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): counts of all words of the training rows. Tasks count by themselves first; words are shuffled once."""

    def counted(batches):
        got: Counter = Counter()
        for batch in batches:
            for rows in slices(batch):
                for text in rows["text"]:
                    got.update(words_of(text))
                if len(got) >= COUNTED:
                    yield from passed(got)
                    got = Counter()
            pa.default_memory_pool().release_unused()
        yield from passed(got)

    def passed(got):
        words, n = list(got), list(got.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(n[at : at + 50_000], pa.int64())], names=["word", "n"])

    return bound_batches(docs.where(training(docs)).select("text")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Sums over the training tokens, and the frequent words by rank with their counts; the first ones are the model's own."""

    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int
    words: list[bytes]
    counts: np.ndarray

    def __post_init__(self):
        self.own = min(len(self.words), VOCABULARY - 2)

    @property
    def unk(self) -> int:
        return VOCABULARY - 2

    @property
    def end(self) -> int:
        return VOCABULARY - 1

    @property
    def other_mass(self) -> float:
        """Sum of count + 0.5 of all words outside the model, and 0.5 for those never seen."""
        outside = self.tokens - self.ends - int(self.counts[: self.own].sum())
        return outside + 0.5 * (self.distinct - (self.ends > 0) - self.own) + 0.5


def lexicon(docs: DataFrame, counts: DataFrame) -> Lexicon:
    """Lexicon of the counted words.

    Words are frequent from the least count on that no more than HEAD_WORDS of them reach. Counts are looked
    at exactly up to 1024 and in 256 steps an octave beyond, so the histogram stays small and the number of
    words that reach the driver is bounded by HEAD_WORDS whatever the corpus.
    """
    n = F.col("n")
    level = F.when(n < 1024, n).otherwise(F.floor(F.log2(n.cast("double")) * 256) + 1_000_000)
    ends = docs.where(training(docs)).count()
    sizes = sorted(map(tuple, counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut, reach = 1 << 40, 0
    for at, many in sizes:
        reach += many
        if reach > HEAD_WORDS:
            break
        cut = at
    frequent = counts.where((level >= cut) & (F.length("word") <= LONGEST_HEAD)).collect()
    by_rank = sorted(((r["n"], bytes(r["word"])) for r in frequent), key=lambda x: (-x[0], x[1]))
    return Lexicon(total + ends, distinct + (ends > 0), ends, [w for _, w in by_rank], np.array([n for n, _ in by_rank], np.int64))


def _softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of choice at of each row of h, exponentials by choice and row, their sums); scores over 60 count as 60 instead of a row's shift."""
    e = w @ h.T
    e += b[:, None]
    if e.max() > 60:
        np.minimum(e, 60, out=e)
    out = e[at, rows]
    np.exp(e, out=e)
    total = e.sum(0)
    return out - np.log(total), e, total


def class_starts(lex: Lexicon) -> np.ndarray:
    """First id of each class, and the end: words in runs of about equal sums of root counts, then a class of unk and end.

    Frequent words so stand in small classes, and the most tokens cost little.
    """
    share = np.sqrt(np.append(lex.counts[: lex.own], np.ones(VOCABULARY - 2 - lex.own)) + 0.5).cumsum()
    cuts = np.searchsorted(share, share[-1] * np.arange(1, CLASSES - 1) / (CLASSES - 1)) + 1
    at = np.arange(CLASSES - 2)
    cuts = np.maximum.accumulate(cuts - at) + at  # no class is empty
    return np.concatenate([[0], np.minimum(cuts, VOCABULARY - CLASSES + 1 + at), [VOCABULARY - 2, VOCABULARY]])


def keep_freed_memory() -> None:
    """Freeing one large block raises the allocator's threshold, so that a window's arrays aren't handed back and mapped anew each time."""
    block = np.empty(30 << 20, np.uint8)
    del block


class Gru:
    """h' = (1 - z) n + z h with gates z and r; the output is a softmax over classes times one inside the class."""

    def __init__(self, lex: Lexicon):
        rng = np.random.default_rng(SEED)
        self.starts = class_starts(lex)
        self.cls = np.repeat(np.arange(CLASSES, dtype=np.uint8), np.diff(self.starts))
        v, h = VOCABULARY, HIDDEN
        scale = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        # The biases start at the unigram frequencies.
        n = np.full(v, 1e-3)
        n[: lex.own] = lex.counts[: lex.own] + 0.5
        n[lex.unk] = lex.other_mass
        n[lex.end] = lex.ends + 0.5
        per_class = np.add.reduceat(n, self.starts[:-1])
        self.p = {
            "emb": (0.3 * rng.standard_normal((v, EMBED))).astype(np.float32),
            "wx": scale(EMBED, 3 * h),
            "b": np.zeros(3 * h, np.float32),
            "wh": scale(h, 3 * h),
            "wc": np.zeros((h, CLASSES), np.float32),
            "bc": np.log(per_class / n.sum()).astype(np.float32),
            "wo": np.zeros((v, h), np.float32),
            "bo": np.log(n / per_class[self.cls]).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what the gradient needs; gates: the input's part of them. A column is a lane, so each gate is a whole block."""
        k = HIDDEN
        u = self.p["wh"].T @ h
        zr = gates[: 2 * k] + u[: 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        z, r = zr[:k], zr[k:]
        n = r * u[2 * k :]
        n += gates[2 * k :]
        np.tanh(n, out=n)
        out = h - n
        out *= z
        out += n
        return out, z, r, n, u[2 * k :]

    def output(self, h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(natural log probability of each target, gradient of the loss by h if grads are to be filled); a row of h is a token's state."""
        p, starts = self.p, self.starts
        cls = self.cls[target]
        # Tokens in order of their class, so that each class is one run of rows.
        order = np.argsort(cls, kind="stable")
        cls, target, h = cls[order], target[order], h[order]
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        rows, ones = np.arange(len(h)), np.ones(len(h), h.dtype)
        out, e, total = _softmax(h, p["wc"].T, p["bc"], cls, rows)
        dh = None
        if grads is not None:
            e /= total
            e[cls, rows] -= 1
            grads["wc"] = (e @ h).T
            grads["bc"] = e @ ones
            dh = e.T @ p["wc"].T
        for c in range(CLASSES):
            a, z = cuts[c], cuts[c + 1]
            if a == z:
                continue
            first, last = starts[c], starts[c + 1]
            if last - first == 1:
                continue
            w, mine, inside = p["wo"][first:last], h[a:z], target[a:z] - first
            got, e, total = _softmax(mine, w, p["bo"][first:last], inside, rows[: z - a])
            out[a:z] += got
            if grads is not None:
                e /= total
                e[inside, rows[: z - a]] -= 1
                grads["wo"][first:last] = e @ mine
                grads["bo"][first:last] = e @ ones[: z - a]
                dh[a:z] += e.T @ w
        back = np.empty_like(order)
        back[order] = rows
        return out[back], None if dh is None else dh[back]

    def score(self, texts: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of each id sequence. The state runs through the whole text; each text begins after an end."""
        out = np.zeros(len(texts))
        emb, wx, b = self.p["emb"], np.ascontiguousarray(self.p["wx"].T), self.p["b"][:, None]
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for a in range(0, len(order), SCORE_LANES):
            lanes = order[a : a + SCORE_LANES]
            sizes = np.array([len(texts[i]) for i in lanes])
            h = np.zeros((HIDDEN, len(lanes)), np.float32)
            before = np.full(len(lanes), end)
            sums = np.zeros(len(lanes))
            held, states, targets, size = [], [], [], 0
            block: np.ndarray | None = None
            for t in range(int(sizes[0])):
                if t % 256 == 0:  # ids of the next steps, lane by lane, so padding stays small
                    block = np.full((256, len(lanes)), end)
                    for k, i in enumerate(lanes):
                        part = texts[i][t : t + 256]
                        block[: len(part), k] = part
                live = int(np.searchsorted(-sizes, -t, side="left"))
                now = block[t % 256, :live]
                h = self.step(wx @ emb[before[:live]].T + b, h[:, :live])[0]
                held.append(live)
                states.append(h)
                targets.append(now)
                before = now
                size += live
                if size >= 8192 or t == sizes[0] - 1:
                    got = self.output(np.concatenate(states, axis=1).T, np.concatenate(targets))[0].astype(np.float64)
                    at = 0
                    for n in held:
                        sums[:n] += got[at : at + n]
                        at += n
                    held, states, targets, size = [], [], [], 0
            out[lanes] = sums
        return out

    def squares(self) -> dict[str, np.ndarray]:
        """Adagrad's sums of squared gradients, before the first step."""
        return {k: np.full_like(x, 1e-6) for k, x in self.p.items()}

    def learn(self, texts: list[np.ndarray], end: int, rate: float = RATE, seen: dict[str, np.ndarray] | None = None) -> int:
        """One pass of truncated backpropagation with Adagrad steps, carrying on from seen if given; returns the number of tokens."""
        seen = self.squares() if seen is None else seen
        parts = [(end if at == 0 else int(x[at - 1]), x[at : at + SEGMENT]) for x in texts for at in range(0, len(x), SEGMENT)]
        parts.sort(key=lambda p: -len(p[1]))
        lanes = min(LANES, max(16, len(parts) // 8))
        total = 0
        # Groups of about equal lengths, in an order that doesn't follow length.
        for g in np.random.default_rng(SEED).permutation(-(-len(parts) // lanes)).tolist():
            group = parts[g * lanes : (g + 1) * lanes]
            sizes = np.array([len(x) for _, x in group])
            ids = np.full((int(sizes[0]), len(group)), -1)
            for k, (_, x) in enumerate(group):
                ids[: len(x), k] = x
            h, before = np.zeros((len(group), HIDDEN), np.float32), np.array([b for b, _ in group])
            for t in range(0, len(ids), WINDOW):
                live = int(np.searchsorted(-sizes, -t, side="left"))
                grads, h, before, n = self.gradients(h[:live], before[:live], ids[t : t + WINDOW, :live])
                self.descend(grads, seen, rate)
                total += n
        return total

    def gradients(self, h: np.ndarray, before: np.ndarray, part: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, int]:
        """(mean gradients over a window's tokens, last state, last words, tokens); part: (steps, lanes) ids, -1 past a text's end."""
        p, k = self.p, HIDDEN
        steps, lanes = part.shape
        inputs = np.concatenate([before[None, :], np.where(part[:-1] >= 0, part[:-1], before[None, :])])
        x = p["emb"][inputs.reshape(-1)]
        # From here on a column is a token: (number, step, lane).
        gates = (p["wx"].T @ x.T + p["b"][:, None]).reshape(3 * k, steps, lanes)
        came, hs, z, r, n, u = (np.empty((k, steps, lanes), h.dtype) for _ in range(6))
        h = h.T
        for t in range(steps):
            came[:, t] = h
            h, z[:, t], r[:, t], n[:, t], u[:, t] = self.step(gates[:, t], h)
            hs[:, t] = h
        flat = part.reshape(-1)
        real = np.flatnonzero(flat >= 0)
        grads = {"wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
        _, dh = self.output(np.ascontiguousarray(hs.reshape(k, -1).T)[real], flat[real], grads)
        every = np.zeros((steps * lanes, k), h.dtype)
        every[real] = dh
        every = np.ascontiguousarray(every.T).reshape(k, steps, lanes)
        # What the steps back need, for all of them at once.
        to_n = (1 - z) * (1 - n * n)
        to_z = (came - n) * z * (1 - z)
        to_r = u * r * (1 - r)
        du, dns = np.empty((3 * k, steps, lanes), h.dtype), np.empty_like(came)
        back = np.zeros_like(came[:, 0])
        for t in range(steps - 1, -1, -1):
            back += every[:, t]
            dn, b = dns[:, t], du[:, t]
            np.multiply(back, to_n[:, t], out=dn)
            np.multiply(back, to_z[:, t], out=b[:k])
            np.multiply(dn, to_r[:, t], out=b[k : 2 * k])
            np.multiply(dn, r[:, t], out=b[2 * k :])
            back *= z[:, t]
            back += p["wh"] @ b
        du, dns = du.reshape(3 * k, -1), dns.reshape(k, -1)
        zr, ones = du[: 2 * k], np.ones(steps * lanes, h.dtype)
        by_input = zr.T @ p["wx"][:, : 2 * k].T + dns.T @ p["wx"][:, 2 * k :].T
        grads |= {"wh": came.reshape(k, -1) @ du.T, "b": np.append(zr @ ones, dns @ ones), "wx": np.vstack([zr @ x, dns @ x]).T, "emb": np.zeros_like(p["emb"])}
        order = np.argsort(inputs.reshape(-1).astype(np.uint16), kind="stable")
        words = inputs.reshape(-1)[order]
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        grads["emb"][words[first]] = np.add.reduceat(by_input[order], first, axis=0)
        many = len(real)
        for g in grads.values():
            g /= max(1, many)
        return grads, h.T, np.where(part[-1] >= 0, part[-1], before), many

    def descend(self, grads: dict[str, np.ndarray], seen: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step; gradients of a norm over 5 are shrunk to it."""
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        for name, g in grads.items():
            if norm > 5:
                g *= np.float32(5 / norm)
            seen[name] += g * g
            g /= np.sqrt(seen[name])
            g *= np.float32(rate)
            self.p[name] -= g


def mean_weights(parts: DataFrame) -> np.ndarray | None:
    """Mean of the (n, w) rows' weights w, weighted by n; None without rows. Rounds of FAN_IN rows a task, tree-wise."""

    def mean(batches):
        total, n = None, 0
        for batch in batches:
            for k, w in zip(batch["n"].to_pylist(), batch["w"].to_pylist(), strict=True):
                part = np.frombuffer(w, "<f4").astype(np.float64) * k
                total, n = part if total is None else total + part, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()])], names=["n", "w"])

    parts = stage(parts, "weights")
    count = parts.count()
    while count > 1:
        count = -(-count // FAN_IN)
        last, parts = parts, stage(parts.repartition(count).mapInArrow(mean, "n long, w binary"), "weights")
        discard(last)
    row = parts.first()
    discard(parts)
    return None if row is None else np.frombuffer(row["w"], "<f4")


def train(coded: DataFrame, lex: Lexicon, epochs: int = EPOCHS) -> Gru:
    """GRU fitted by all tasks at once on the ids of training rows of encode(); the weights are averaged by tokens.

    All training documents give gradients, and a task carries its weights on from slice to slice. A task
    hands over one row with all its weights; rows are averaged tree-wise, and one reaches the driver.

    Rows are dealt by a hash of id and ids to as many tasks as the corpus has TASK_TOKENS, each in the order of that hash. So
    the model depends on the documents alone, not on how the table is split, and averaging always joins tasks of like size.
    """
    spark = coded.sparkSession
    model = Gru(lex)
    shared_lex = spark.sparkContext.broadcast(lex)
    tasks = max(1, -(-lex.tokens // TASK_TOKENS))
    turned = coded.where("NOT held_out").select("ids", F.xxhash64("doc_id", "ids").alias("turn"))
    picked = turned.repartition(tasks, "turn").sortWithinPartitions("turn").select("ids")
    for epoch in range(epochs):
        now = spark.sparkContext.broadcast(model.flat())

        def learned(batches, now=now, rate=RATE / (1 + 2 * epoch)):
            keep_freed_memory()
            lex = shared_lex.value
            gru = Gru(lex).load(now.value)
            seen, n = gru.squares(), 0
            for batch in batches:
                for rows in slices(batch):
                    n += gru.learn([np.frombuffer(x, "<u2").astype(np.int64) for x in rows["ids"]], lex.end, rate, seen)
                pa.default_memory_pool().release_unused()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([gru.flat().astype("<f4").tobytes()])], names=["n", "w"])

        mean = mean_weights(bound_batches(picked).mapInArrow(learned, "n long, w binary"))
        if mean is not None:
            model.load(mean)
    return model


def encode(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """One row for each of rows: its model ids, its sums over frequent words, and its other words with their numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    def make():
        lex = shared.value
        ranks = dict(zip(lex.words, range(len(lex.words)), strict=True)).get
        logs = np.log10(lex.counts + 0.5)
        own, unk, end, end_log = lex.own, lex.unk, lex.end, math.log10(lex.ends + 0.5)

        def each(rows):
            out = {n: [] for n in ("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "outer", "n_outer", "ids", "words", "times")}
            for row, doc_id, held_out, text in zip(rows["row"], rows["doc_id"], rows["held_out"], rows["text"], strict=True):
                words = words_of(text)
                rank = np.fromiter(map(ranks, words, repeat(-1)), np.int64, len(words))
                rare = Counter([words[i] for i in np.flatnonzero(rank < 0)])
                known = rank[rank >= 0]
                outer = logs[known[known >= own]]
                ids = np.append(np.where((rank >= 0) & (rank < own), rank, unk), end).astype("<u2")
                n_outer = len(outer) + len(words) - len(known)
                values = (row, doc_id, held_out, len(words) + 1, len(known) + (lex.ends > 0), float(logs[known].sum()) + end_log, float(outer.sum()), n_outer, ids.tobytes(), list(rare), list(rare.values()))
                for c, v in zip(out.values(), values, strict=True):
                    c.append(v)
            return out

        return each

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~training(rows)).alias("held_out"), "text")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, outer double, n_outer long, ids binary, words array<binary>, times array<int>"
    return stage(map_rows(numbered, make, schema), "encoded")


def score_documents(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    base_score is the unigram log10 probability; score that of the GRU, in which a word outside its
    vocabulary costs the class of such words and then its own smoothed frequency among them. Counts are
    those of all training rows. Words outside the HEAD_WORDS frequent ones are looked up by a join, each
    once for each document. Null and empty texts are one end; repeated rows repeat; rows without an id
    count as id ''. Without training rows each token has base probability 1. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stage(count_words(rows), "words")
    lex = lexicon(rows, counts)
    coded = encode(rows, lex)
    model = train(coded, lex, epochs)
    shared = docs.sparkSession.sparkContext.broadcast((lex, model.flat()))
    plain = ("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "outer", "n_outer")

    ddl = T._parse_datatype_string("row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, outer double, n_outer long, model double")
    schema = to_arrow_schema(ddl)

    def run(batches):
        keep_freed_memory()
        lex, flat = shared.value
        gru = Gru(lex).load(flat)

        def scored(rows):
            got = gru.score([np.frombuffer(x, "<u2").astype(np.int64) for x in rows["ids"]], lex.end) / math.log(10)
            columns = {**{c: rows[c] for c in plain}, "model": got.tolist()}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        # Long texts wait for each other, so that they advance together too.
        held: dict[str, list] = {c: [] for c in (*plain, "ids")}
        size = 0
        for batch in batches:
            for rows in slices(batch):
                is_long = [len(x) > 2 * LONG_TEXT for x in rows["ids"]]
                yield scored({c: [v for v, late in zip(rows[c], is_long, strict=True) if not late] for c in held})
                for c in held:
                    held[c] += [v for v, late in zip(rows[c], is_long, strict=True) if late]
                size += sum(len(x) for x, late in zip(rows["ids"], is_long, strict=True) if late)
                if size >= HELD_BYTES:
                    yield scored(held)
                    held, size = {c: [] for c in held}, 0
            pa.default_memory_pool().release_unused()
        if size:
            yield scored(held)

    scored = bound_batches(coded.select(*plain, "ids")).mapInArrow(run, ddl)
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    looked = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("logs") + rare_logs - F.col("n_tokens") * math.log10(lex.tokens + 0.5 * (lex.distinct + 1))
    score = F.col("model") + F.col("outer") + rare_logs - F.col("n_outer") * math.log10(lex.other_mass)
    return scored.join(looked, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
    )
