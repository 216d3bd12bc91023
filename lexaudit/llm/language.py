"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three letters (all other characters count as one space) are hashed to a fixed
number of buckets. Document frequencies cover all training rows. The model is trained, one example
at a time, by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of them,
and its scores are calibrated by a temperature fitted on a part of the sample kept apart.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .base import quoted, small_batches, tidy, total

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    longest: int = 3
    #: Training rows that the model is fitted on, and the share of them kept for the temperature.
    sample: int = 4000
    kept_apart: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def buckets(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of a text's n-grams and their counts; None if it has no letter."""
    codes = folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return None
    keep = np.ones(len(codes) + 2, dtype=bool)
    padded = np.zeros(len(codes) + 2, dtype=np.uint32)
    padded[1:-1] = codes
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # runs of other characters count once
    padded = padded[keep]
    found, shift = [], np.uint32(32 - s.bits)
    gram = np.zeros(len(padded), dtype=np.uint32)
    for n in range(1, s.longest + 1):
        if len(padded) < n:
            break
        gram = (gram[: len(padded) - n + 1] * np.uint32(0x9E3779B1)) ^ (padded[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n))
        spread = gram ^ (gram >> np.uint32(15))
        found.append((spread * np.uint32(0x2C1B3C6D)) >> shift)
    counts = np.bincount(np.concatenate(found), minlength=1 << s.bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.names, self.weights, self.bias, self.idf, self.temperature = names, weights, bias, idf, temperature

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(at, counts, self.idf) @ self.weights[at] + self.bias


def train(examples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, s: Settings) -> Model:
    """FTRL-Proximal with per-coordinate rates; the constant is not penalised."""
    names = sorted({x[2] for x in examples})
    number = {n: i for i, n in enumerate(names)}
    apart = int(len(examples) * s.kept_apart) if len(examples) >= 20 else 0
    used, kept = examples[apart:], examples[:apart]
    z = np.zeros((len(idf) + 1, len(names)))
    squares = np.zeros_like(z)

    def weights_at(rows: np.ndarray) -> np.ndarray:
        l1 = np.where(rows == len(idf), 0.0, s.l1)[:, None]
        l2 = np.where(rows == len(idf), 0.0, s.l2)[:, None]
        return np.where(np.abs(z[rows]) <= l1, 0.0, -(z[rows] - np.sign(z[rows]) * l1) / ((s.beta + np.sqrt(squares[rows])) / s.alpha + l2))

    for _ in range(s.epochs):
        for at, counts, name in used:
            rows = np.append(at, len(idf))
            x = np.append(weighted(at, counts, idf), 1.0)
            w = weights_at(rows)
            wrong = _softmax(x @ w)
            wrong[number[name]] -= 1
            gradient = np.outer(x, wrong)
            rate = (np.sqrt(squares[rows] + gradient**2) - np.sqrt(squares[rows])) / s.alpha
            z[rows] += gradient - rate * w
            squares[rows] += gradient**2
    final = weights_at(np.arange(len(idf) + 1))
    model = Model(names, final[:-1], final[-1], idf, 1.0)
    if kept:
        logits = np.array([model.logits(at, counts) for at, counts, _ in kept])
        truth = np.array([number[n] for _, _, n in kept])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(kept)), truth] + 1e-12).mean()
        model.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))
    return model


def fit(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> Model | None:
    """The model from the rows where trained_on is true and the language is known; None if there are none with letters."""
    small_batches(docs.sparkSession)
    rows = docs.where(trained_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("order"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << s.bits) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = buckets(text, s)
                if found:
                    df[found[0]] += 1
                    df[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], names=["df"])

    df = total(rows.select("text").mapInArrow(frequencies, "df binary"), "df")
    if df is None or not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    last = rows.select("order").orderBy("order").limit(s.sample).agg(F.max("order")).first()[0]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, lang, order in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = buckets(text, s)
                if found:
                    for column, x in zip(out, (lang, order, found[0].astype(np.int32).tobytes(), found[1].astype(np.int32).tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "order", "at", "counts"])

    sample = rows.where(F.col("order") <= F.lit(last)).mapInArrow(look, "lang string, order long, at binary, counts binary").orderBy("order", "lang", "at").limit(s.sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(c, np.int32).astype(np.int64), lang) for b in batches for lang, a, c in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True)]
        if examples:
            m = train(examples, idf, s)
            yield pa.RecordBatch.from_arrays([pa.array([m.names], pa.list_(pa.string())), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary()), pa.array([m.temperature])], names=["names", "weights", "bias", "temperature"])

    row = sample.repartition(1).sortWithinPartitions("order", "lang", "at").mapInArrow(learn, "names array<string>, weights binary, bias binary, temperature double").first()
    if row is None:
        return None
    shape = (1 << s.bits, len(row.names))
    return Model(list(row.names), np.frombuffer(row.weights).reshape(shape), np.frombuffer(row.bias), idf, row.temperature)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The columns of keep, lang_pred and score for each row; keep must not hold these two names.

    A null text, or one without a letter, is 'und' with score 0, as is all text if there is no model.
    Equal probabilities go to the language first in alphabetical order.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets times languages: its size does not grow with the rows
    names = keep if text_col in keep else [*keep, text_col]
    rows, text_at = docs.select(*quoted(*names)), names.index(text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found_names, scores = [], []
            for text in batch.column(text_at).to_pylist():
                found = buckets(text, s) if text and m else None
                if found is None:
                    found_names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = _softmax(m.logits(*found) / m.temperature)
                    i = int(p.argmax())
                    found_names.append(m.names[i])
                    scores.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found_names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        tidy()

    return rows.mapInArrow(rate, StructType([*rows.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score (0 to 1).

    The model learns from text and language of the rows where held_out is false; a null held_out
    counts as false. Repeated rows count and are judged each. An empty table gives an empty one;
    other columns are ignored. For texts without letters and null ones see predict().
    """
    held = F.coalesce(held_out, F.lit(False))
    model = fit(docs, ~held, id_col, text_col, lang_col, s)
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col))
    return predict(rows, model, [id_col, "held_out"], text_col, s)
