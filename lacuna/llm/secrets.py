"""Secret scans: base patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.rows import map_rows
from lacuna.sources.staging import stage

# Base patterns (fixed values). Shorter matches than the least length are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the least length can be part of the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: maximal runs of the characters of common encodings.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Alphabets from which an encoding is inferred: the first that has all characters of a candidate (fixed values).
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"),
)
#: Lengths from which a new stratum begins; false discoveries are controlled in each by itself.
STRATA = (16, 20, 24, 32, 48, 80)
#: False-discovery rate, least p-value of each test under uniform randomness, bins for one power of ten, and their number.
FDR, UNIFORM_ALPHA, PER_TEN, BINS = 0.001, 0.001, 10, 400

_CLASS = np.zeros(128, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/=_-"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_FOLD = np.full(128, -1, np.int64)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(26)
_KNOWN = [(a, set(a)) for _, a in ALPHABETS]


def _upper(z: float) -> float:
    """Upper tail of the normal distribution, never 0."""
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-40)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping in each kind, by start and kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


@dataclass
class Ordinary:
    """Ordinary text: counts of ASCII characters, how often neighbours change between letters and others, and in case, and letter pairs.

    pairs is (26, 26), case aside; without it tokens aren't tested against identifiers.
    """

    counts: np.ndarray
    kind_change: float
    case_change: float
    pairs: np.ndarray | None = None

    def __post_init__(self):
        self.names = None if self.pairs is None else name_costs(self.pairs)


#: An identifier, stamp or path: a new part begins after a character with this probability; of new parts, the shares of
#: words, numbers and separators; a word begins or goes on in capitals with these probabilities.
NEW_PART, PART_SHARES, CAPITAL, CAPITALS = 0.2, (0.5, 0.25, 0.25), 0.5, 0.5


def name_costs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, next): -ln probability of a first character, and of each character after another, in names made of parts.

    Parts are words, in lower case, with a capital or in capitals, whose letters follow the corpus' letter pairs, numbers of any
    digits, and separators. Each row is a distribution over the characters of candidates.
    """
    alone = pairs.sum(0) + 1.0
    alone = 0.65 * alone / alone.sum() + 0.35 / 26
    after = 0.55 * (pairs + 0.1) / (pairs + 0.1).sum(1, keepdims=True) + 0.45 * alone
    low, up, digits, signs = (np.array([ord(c) for c in x]) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/=_-"))
    word, number, sign = PART_SHARES
    first = np.zeros(128)
    first[low], first[up], first[digits], first[signs] = word * (1 - CAPITAL) * alone, word * CAPITAL * alone, number / 10, sign / 5
    table = np.tile(NEW_PART * first, (128, 1))
    table[np.ix_(low, low)] += (1 - NEW_PART) * after
    table[np.ix_(up, low)] += (1 - NEW_PART) * (1 - CAPITALS) * after
    table[np.ix_(up, up)] += (1 - NEW_PART) * CAPITALS * after
    table[np.ix_(digits, digits)] += (1 - NEW_PART) / 10
    table[signs] = first  # a separator ends its part
    table /= table.sum(1, keepdims=True)
    return -np.log(np.maximum(first, 1e-300)), -np.log(np.maximum(table, 1e-300))


def kind_changes(c: np.ndarray) -> tuple[int, int]:
    """(neighbours of encoding characters, those of which one is a letter and the other a digit or sign)."""
    k = _CLASS[c]
    both = (k[1:] > 0) & (k[:-1] > 0)
    other = k > 2
    return int(both.sum()), int((both & ((other[1:] != other[:-1]) | (other[1:] & (k[1:] != k[:-1])))).sum())


def case_changes(c: np.ndarray) -> tuple[int, int]:
    """(neighbouring letters after another letter, those of which differ in case); a word's capital doesn't count."""
    k = _CLASS[c]
    letter = (k == 1) | (k == 2)
    three = letter[2:] & letter[1:-1] & letter[:-2]
    return int(three.sum()), int((three & (k[2:] != k[1:-1])).sum())


def letter_pairs(c: np.ndarray) -> np.ndarray:
    """Counts of the 26 * 26 pairs of neighbouring letters, case aside."""
    k = _FOLD[c]
    first, second = k[:-1], k[1:]
    both = (first >= 0) & (second >= 0)
    return np.bincount(first[both] * 26 + second[both], minlength=26 * 26)


def battery(tokens: list[str], text: Ordinary) -> np.ndarray:
    """p-value of each token against ordinary text, 1 where it isn't random in its inferred encoding.

    Against identifiers, stamps and paths, whose parts a uniform source would hardly make, counts the likelihood ratio of both
    sources: under the former its inverse exceeds 1 / p with a probability of at most p. The larger of both p-values is returned.
    Against ordinary text count chi-squared uniformity (drawn from the corpus' frequencies inside the
    alphabet it is larger) and two numbers of runs, of letters and of others, and of one case (they are
    smaller); three times the least of their p-values is returned. Against a uniform source none of chi-squared,
    runs about the middle of the alphabet, and serial correlation may have a p-value under UNIFORM_ALPHA.
    """
    out = np.ones(len(tokens))
    for i, token in enumerate(tokens):
        chars = set(token)
        alphabet = next(a for a, known in _KNOWN if chars <= known)
        out[i] = _one(np.frombuffer(token.encode("ascii"), np.uint8).astype(np.int64), alphabet, text)
    return out


def _one(c: np.ndarray, alphabet: str, text: Ordinary) -> float:
    n, a = len(c), len(alphabet)
    place = np.full(128, -1)
    order = [ord(x) for x in alphabet]
    place[order] = np.arange(a)
    v = place[c]
    seen = np.bincount(v, minlength=a)
    chi = float((seen * seen).sum()) * a / n - n
    # Uniform source: mean a - 1, variance 2 (a - 1)(n - 1) / n.
    z_chi = (chi - (a - 1)) / math.sqrt(max(1e-9, 2 * (a - 1) * (n - 1) / n))
    above = v >= a / 2
    up = int(above.sum())
    mean = 1 + 2 * up * (n - up) / n
    runs = 1 + int((above[1:] != above[:-1]).sum())
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = abs(runs - mean) / math.sqrt(var) if var > 1e-9 else 40.0
    d = v - v.mean()
    spread = float((d * d).sum())
    z_serial = abs(float((d[:-1] * d[1:]).sum()) / spread + 1 / n) * math.sqrt(n) if spread else 40.0
    if min(_upper(z_chi), 2 * _upper(z_runs), 2 * _upper(z_serial)) < UNIFORM_ALPHA:
        return 1.0
    q = text.counts[order] + 0.5
    q = q / q.sum()
    s2, s3 = float((q * q).sum()), float((q**3).sum())
    text_mean = a * ((n - 1) * s2 + 1) - n
    text_var = max(1e-9, a * a / (n * n) * (4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - s2 * s2)))
    p_chi = _upper((text_mean - chi) / math.sqrt(text_var))
    pairs, changed = kind_changes(c)
    p_kinds = _binomial_tail(changed, pairs, text.kind_change)
    pairs, changed = case_changes(c)
    p_cases = _binomial_tail(changed, pairs, text.case_change)
    p = min(1.0, 3 * min(p_chi, p_kinds, p_cases))
    if text.names is None or p == 1.0:
        return p
    first, after = text.names
    return max(p, math.exp(min(0.0, n * math.log(a) - float(first[c[0]] + after[c[:-1], c[1:]].sum()))))


def _binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), by its first terms; an upper bound of them is enough below 1."""
    if k <= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (n - k) * p / ((k + 1) * (1 - p))
    return min(1.0, math.exp(max(log, -90)) / max(1e-3, 1 - ratio))


def corpus_characters(docs: DataFrame) -> Ordinary:
    """Character counts, the shares of neighbours that change, and letter pairs, of all texts."""

    def make():
        def each(rows):
            out = np.zeros(132 + 26 * 26, np.int64)
            for text in rows["text"]:
                b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                b = b[b < 128]
                out[:128] += np.bincount(b, minlength=128)
                out[128:130] += kind_changes(b)
                out[130:132] += case_changes(b)
                out[132:] += letter_pairs(b)
            hit = np.flatnonzero(out)
            return {"k": hit.tolist(), "n": out[hit].tolist()}

        return each

    sums = dict(map(tuple, map_rows(docs.select("text"), make, "k int, n long").groupBy("k").agg(F.sum("n")).collect()))
    share = lambda k: min(0.5, (sums.get(k + 1, 0) + 1) / (sums.get(k, 0) + 2))
    pairs = np.array([sums.get(132 + k, 0) for k in range(26 * 26)], np.int64).reshape(26, 26)
    return Ordinary(np.array([sums.get(k, 0) for k in range(128)], np.int64), share(128), share(130), pairs)


def _p_bin(p: np.ndarray) -> np.ndarray:
    """Bin of a p-value: its edge 10^(-bin / PER_TEN) is never less than it."""
    return np.minimum(BINS, np.floor(-np.log10(np.maximum(p, 1e-60)) * PER_TEN + 1e-9)).astype(np.int64)


def discoveries(tests: dict[tuple[int, int], int], fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg in each length stratum, on binned p-values: the least bin that is still a discovery."""
    out = {}
    for stratum in {s for s, _ in tests}:
        total, above = sum(n for (s, _), n in tests.items() if s == stratum), 0
        for b in range(BINS, -1, -1):
            above += tests.get((stratum, b), 0)
            if above and 10 ** (-b / PER_TEN) * total <= fdr * above:
                out[stratum] = b
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), one row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; the method's are of
    kind random and never inside a base span. Null and empty texts have none (the digest is that of the
    empty string). Character statistics and the tests that false-discovery control counts are those of
    all documents; repeated rows count and repeat. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(corpus_characters(rows))

    def make():
        ordinary = model.value

        def each(rows):
            out = {n: [] for n in ("doc_id", "base", "starts", "ends", "strata", "bins", "tests")}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                text = text or ""
                spans = base_spans(text)
                found = _outside(text, spans)
                bins = _p_bin(battery([m[0] for m in found], ordinary))
                strata = [max(s for s in STRATA if len(m[0]) >= s) for m in found]
                keep = [i for i in range(len(found)) if bins[i] >= PER_TEN]
                tests = dict.fromkeys(strata, 0)
                for i, s in enumerate(strata):
                    tests[s] += bins[i] < PER_TEN
                values = (doc_id, [f"{k}:{a}:{z}" for a, z, k in spans], [found[i].start() for i in keep], [found[i].end() for i in keep], [strata[i] for i in keep], [int(bins[i]) for i in keep], [[s, int(n)] for s, n in tests.items()])
                for n, v in zip(out, values, strict=True):
                    out[n].append(v)
            return out

        return each

    schema = "doc_id long, base array<string>, starts array<int>, ends array<int>, strata array<int>, bins array<int>, tests array<array<int>>"
    tested = stage(map_rows(rows, make, schema), "tested")
    dull = tested.select(F.explode("tests").alias("t")).groupBy(F.col("t")[0].alias("s"), F.lit(0).alias("b")).agg(F.sum(F.col("t")[1]).alias("n"))
    odd = tested.select(F.explode(F.arrays_zip("strata", "bins")).alias("t")).groupBy(F.col("t.strata").alias("s"), F.col("t.bins").alias("b")).agg(F.count("*").alias("n"))
    tests = {(r["s"], r["b"]): r["n"] for r in dull.unionByName(odd).collect()}
    least = docs.sparkSession.sparkContext.broadcast(discoveries(tests))

    def finish():
        def each(rows):
            out = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
            for doc_id, base, starts, ends, strata, bins in zip(*(rows[c] for c in ("doc_id", "base", "starts", "ends", "strata", "bins")), strict=True):
                spans = [(int(a), int(z), k) for k, a, z in (s.split(":") for s in base)]
                more = [(a, z, "random") for a, z, s, b in zip(starts, ends, strata, bins, strict=True) if b >= least.value.get(s, BINS + 1)]
                n = [sum(k == kind for _, _, k in spans) for kind in KINDS[:3]]
                every = sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))
                values = (doc_id, *n, hashlib.sha256(written(spans).encode()).hexdigest(), written(every), len(more))
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
            return out

        return each

    return map_rows(tested.drop("tests"), finish, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def _outside(text: str, spans: list[tuple[int, int, str]]) -> list[re.Match]:
    """Candidates that are inside no base span: of the spans that begin before one, the furthest end decides."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][0] <= m.start():
            reach = max(reach, spans[k][1])
            k += 1
        if m.end() > reach:
            out.append(m)
    return out
