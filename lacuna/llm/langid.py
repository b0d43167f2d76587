"""Language ID by a blended-spectrum string kernel with Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.rows import bound_batches, crc_mod, map_rows

#: Buckets of the hashed n-grams (presence of 1- to 3-grams), and texts of one matrix product.
DIM, BATCH = 1 << 14, 64
#: The model is fitted on at most so many labelled rows of each language, its floors on so many more, and it has so many landmarks in all.
TRAIN_ROWS, FLOOR_ROWS, LANDMARKS = 300, 150, 96
RIDGE, SHARPNESS = 1e-2, 4.0
FOLDS = 5
#: A text is known if it shares with some landmark at least so much of the least share that other labelled rows have;
#: of so many rows at least, else nothing is rejected for it.
FAMILIAR, LEAST_ROWS = 0.85, 25
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_TEXT_STEP = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(text: str, row: np.ndarray) -> None:
    """Set in row the buckets of all 1- to 3-grams of the lower-cased text; runs of other characters count as one space."""
    text = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    all_codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(all_codes), _TEXT_STEP):
        c = all_codes[at : at + _TEXT_STEP + 2]
        h = c * _MIX[0]
        for n in range(3):
            if n:
                h = h[:-1] * _MIX[1] + c[n:] * _MIX[2]
            row[((h ^ (h >> np.uint32(15))) * _MIX[0]) >> np.uint32(18)] = 1


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised presence kernel: common buckets over the geometric mean of both counts."""
    nx, ny = np.sqrt(np.maximum(x.sum(1), 1)), np.sqrt(np.maximum(y.sum(1), 1))
    return (x @ y.T) / nx[:, None] / ny[None, :]


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # (m, DIM) presence
    weights: np.ndarray  # (m, languages)
    floor: float = 0.0  # least share of a known text's n-grams that one landmark has


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """Kernel ridge regression in the Nystroem space of landmarks that are spread evenly over the languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros((0, 0)))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    each = max(1, LANDMARKS // len(names))
    at = [i for b in names for i in [k for k, a in enumerate(langs) if a == b][:each]]
    marks = rows[at].astype(np.float32)
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([kernel(rows[k : k + BATCH].astype(np.float32), marks) for k in range(0, len(rows), BATCH)]) @ root
    # Each language has the same weight as a whole.
    share = np.array([1.0 / langs.count(a) for a in names])[y.argmax(1)]
    left = phi.T @ (phi * share[:, None]) + RIDGE * np.eye(phi.shape[1])
    return Model(names, marks, root @ np.linalg.solve(left, phi.T @ (y * share[:, None])))


def shares(x: np.ndarray, m: Model) -> np.ndarray:
    """Largest share of each presence row that a landmark has in common with it, of the smaller of both."""
    y = m.landmarks
    return ((x @ y.T) / np.minimum(np.maximum(x.sum(1), 1)[:, None], np.maximum(y.sum(1), 1)[None, :])).max(1)


def set_floor(m: Model, rows: np.ndarray) -> Model:
    """m with the floor that follows from presence rows of known languages that aren't its landmarks."""
    if len(rows) >= LEAST_ROWS and m.langs:
        m.floor = FAMILIAR * float(np.concatenate([shares(rows[k : k + BATCH].astype(np.float32), m) for k in range(0, len(rows), BATCH)]).min())
    return m


def train(docs: DataFrame, folds: int = FOLDS) -> Model:
    """Fit on rows with a language whose crc32 of the id is not 0 modulo folds: at most TRAIN_ROWS of each language.

    The sample is that of smallest hashes of id and text in each language, so that many rows of one id don't make it
    larger; the next FLOOR_ROWS set the floor. Tasks turn texts into presence bits, and only these (DIM / 8 bytes a
    row) and the labels reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", folds) != 0))
    order = F.xxhash64(F.lit("langid"), F.col("doc_id"))
    sizes = known.groupBy("lang").count().collect()
    many = TRAIN_ROWS + FLOOR_ROWS
    unit = (order / F.lit(2.0**64)) + F.lit(0.5)
    if not sizes:
        return fit(np.zeros((0, DIM), np.uint8), [])
    # A fraction that gives TRAIN_ROWS with a margin, so that few texts are read; the rest is cut by rank.
    part = F.coalesce(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * many / r["count"] + 20 / r["count"])))])[F.col("lang")], F.lit(0.0))

    def make():
        def each(rows):
            bits = np.zeros((len(rows["text"]), DIM), np.uint8)
            for i, t in enumerate(rows["text"]):
                presence(t or "", bits[i])
            return {"lang": rows["lang"], "place": rows["place"], "bits": [r.tobytes() for r in np.packbits(bits, axis=1)]}

        return each

    first = Window.partitionBy("lang").orderBy("rank", "more")
    picked = known.where(unit <= part).select("lang", order.alias("rank"), F.col("text").cast("string").alias("text"))
    picked = picked.withColumn("more", F.xxhash64("text")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= many)
    got = map_rows(picked.select("lang", "place", "text"), make, "lang string, place int, bits binary").collect()
    got.sort(key=lambda r: (r["lang"], r["place"]))
    bits = lambda rows: np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    fitted, more = [r for r in got if r["place"] <= TRAIN_ROWS], Counter(r["lang"] for r in got if r["place"] > TRAIN_ROWS)
    model = fit(bits(fitted), [r["lang"] for r in fitted])
    # Shares are those of landmarks alone, so in languages of few rows the others of the fitted ones are as good.
    marks = max(1, LANDMARKS // len(model.langs))
    other = [r for r in got if r["place"] > (TRAIN_ROWS if more[r["lang"]] >= LEAST_ROWS else marks)]
    return set_floor(model, bits(other)) if other else model


def _rows(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(x, texts, strict=True):
        presence(text, row)
    return x


def values(texts: list[str], m: Model) -> np.ndarray:
    """(text, language) regression values, by one matrix product for the kernel and one for the regression."""
    return kernel(_rows(texts), m.landmarks) @ m.weights


def scores(texts: list[str], m: Model) -> np.ndarray:
    """(text, language) scores in 0 to 1."""
    s = SHARPNESS * values(texts, m)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def label(texts: list[str | None], m: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
    for a in range(0, len(todo), BATCH):
        part = todo[a : a + BATCH]
        e = scores([texts[i] for i in part], m)
        for i, best, p in zip(part, e.argmax(1), e.max(1), strict=True):
            lang[i], score[i] = m.langs[best], float(p)
    return lang, score


def predict(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs.

    Null text or text without a letter: und, score 0. Only text decides; equal texts get equal
    predictions and ties go to the first language by name. Without a labelled row everything is und.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(rows):
            lang, score = label(rows["text"], shared.value)
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": lang, "score": score}

        return each

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(cols, make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """train, then predict."""
    return predict(docs, train(docs))


def languages(texts: list[str | None], m: Model) -> list[str | None]:
    """Language of each text; None without a letter, or where no landmark has enough in common with it."""
    out: list[str | None] = [None] * len(texts)
    ny = np.maximum(m.landmarks.sum(1), 1)
    todo = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
    for a in range(0, len(todo), BATCH):
        part = todo[a : a + BATCH]
        x = _rows([texts[i] for i in part])
        both, nx = x @ m.landmarks.T, np.maximum(x.sum(1), 1)[:, None]
        known = (both / np.minimum(nx, ny)).max(1) >= m.floor
        best = ((both / np.sqrt(nx) / np.sqrt(ny)) @ m.weights).argmax(1)
        for i, ok, b in zip(part, known, best, strict=True):
            if ok:
                out[i] = m.langs[b]
    return out


def keep_known(docs: DataFrame) -> DataFrame:
    """docs with the language of each text as lang, without those of no known language: texts without a letter, or that no landmark of a language resembles.

    What counts as resembling is set on labelled rows that are no landmarks, so it doesn't depend on the number of
    languages. A given lang is only learned from: it is a claim, which may be wrong or missing. All other columns stay
    as they are; without a labelled row nothing is known.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        return pd.Series(languages(texts.tolist(), model.value), dtype=object)

    # Not deterministic for the optimizer, which would else read each text once for the column and once for the filter.
    return bound_batches(docs).withColumn("lang", language.asNondeterministic()(F.col("text").cast("string"))).where(F.col("lang").isNotNull())
