"""Quality classifier learnt from trusted positives and unlabelled text, with a non-negative risk.

Features of a text are cut into bins of fixed edges, and a document is the set of bins that it falls
in. With the squared loss, the risk on positives and on unlabelled text is a function of two matrices
of pair counts of bins; those are summed over all documents, and the fit itself is a small problem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Words, discard, small_batches, stored, total, word_chunks

_SHARE = (0.0, 0.002, 0.01, 0.03, 0.08, 0.2, 0.5)
#: Feature names and the upper edges of their bins but the last. Parameters.
FEATURES: dict[str, tuple[float, ...]] = {
    "words": (0, 5, 20, 60, 200, 1000),
    "word_bytes": (2, 3, 4, 5, 6, 8, 12),
    "upper": (0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6),
    "digit": _SHARE,
    "mark": _SHARE,
    "exclamation": _SHARE,
    "symbol": _SHARE,
    "pipe": _SHARE,
    "wide": (0.0, 0.01, 0.05, 0.1, 0.2, 0.4),
    "line": (0.0, 0.001, 0.005, 0.02, 0.1),
    "again": (0.0, 0.01, 0.05, 0.15, 0.4, 0.7),
    "distinct": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9),
    "repeated": (0.0, 0.02, 0.06, 0.15, 0.3, 0.6),
    "capitals": (0.0, 0.02, 0.06, 0.12, 0.3, 0.7),
}
WIDTHS = np.array([len(v) + 1 for v in FEATURES.values()])
STARTS = np.append(0, np.cumsum(WIDTHS))
SIZE = int(STARTS[-1]) + 1  # and a constant

UPPER, LOWER, DIGIT, MARK, EXCLAMATION, SYMBOL, PIPE, WIDE, LINE, OTHER = range(10)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER)
    out[65:91], out[97:123], out[48:58], out[128:], out[10] = UPPER, LOWER, DIGIT, WIDE, LINE
    for c in b".,;:?'\"()-":
        out[c] = MARK
    for c in b"#*$%&<>@^~_=+\\/[]{}`":
        out[c] = SYMBOL
    out[33], out[124] = EXCLAMATION, PIPE
    return out


CLASS = _classes()


def bins(words: Words) -> np.ndarray:
    """For each document of a chunk, the bin of each feature: a row of small numbers."""
    n = len(words.count)
    size = np.diff(words.bounds)
    kinds = np.bincount(np.repeat(np.arange(n) * 10, size) + CLASS[words.data], minlength=10 * n).reshape(n, 10)
    share = kinds / np.maximum(size, 1)[:, None]
    many = np.maximum(words.count, 1)
    doc = np.repeat(np.arange(n), words.count)

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        return np.bincount(owner[order][new], minlength=n)

    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])) if len(doc) > 1 else np.zeros(0, np.int64)
    triples = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    in_triples = np.bincount(doc[triples], minlength=n)
    first = CLASS[words.data[words.start]] if len(doc) else np.zeros(0, np.int64)
    values = {
        "words": words.count, "word_bytes": np.bincount(doc, words.end - words.start, minlength=n) / many,
        "upper": share[:, UPPER], "digit": share[:, DIGIT], "mark": share[:, MARK], "exclamation": share[:, EXCLAMATION],
        "symbol": share[:, SYMBOL], "pipe": share[:, PIPE], "wide": share[:, WIDE], "line": share[:, LINE],
        "again": np.bincount(doc[same], minlength=n) / many, "distinct": distinct(words.hash, doc) / many,
        "repeated": 1 - (distinct(words.windows(triples, 3), doc[triples]) if len(triples) else np.zeros(n)) / np.maximum(in_triples, 1) - (in_triples == 0),
        "capitals": np.bincount(doc[first == UPPER], minlength=n) / many,
    }
    return np.stack([np.searchsorted(edges, values[name]) for name, edges in FEATURES.items()], axis=1).astype(np.uint8)


def design(found: np.ndarray) -> np.ndarray:
    """One-hot rows of bins, and a constant."""
    out = np.zeros((len(found), SIZE))
    np.put_along_axis(out, found.astype(np.int64) + STARTS[:-1], 1, axis=1)
    out[:, -1] = 1
    return out


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array([x.tobytes() for x in bins(w)], pa.binary())], names=["id", "bins"])

    return rows.mapInArrow(look, "id long, bins binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(FEATURES))


def pair_counts(rows: DataFrame) -> np.ndarray:
    """SIZE x SIZE: in how many documents two bins meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SIZE, SIZE))
        for batch in batches:
            x = design(_matrix(batch.column(0)))
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.int64).tobytes()], pa.binary())], names=["sums"])

    found = total(rows.select("bins").mapInArrow(count, "sums binary"), "sums")
    return (np.zeros((SIZE, SIZE)) if found is None else found.reshape(SIZE, SIZE).astype(float))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights that minimise the non-negative risk prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]),
    with l(z) = (1 - z)^2 / 4, from the pair counts of positives and of unlabelled documents."""
    if not positive[-1, -1] or not unlabelled[-1, -1]:
        return np.zeros(SIZE)
    p, u = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
    mean_p, mean_u = p[-1], u[-1]
    curve = u + ridge * np.eye(SIZE)
    weights = np.linalg.solve(curve, 2 * prior * mean_p - mean_u)  # the minimum of the unbiased risk
    loss = lambda m, g, w, sign: (1 - 2 * sign * (m @ w) + w @ g @ w) / 4
    slope = lambda m, g, w, sign: (g @ w - sign * m) / 2
    best, least = weights, np.inf
    for _ in range(steps):
        negative = loss(mean_u, u, weights, -1) - prior * loss(mean_p, p, weights, -1)
        risk = prior * loss(mean_p, p, weights, 1) + max(0.0, negative) + ridge * weights @ weights / 4
        if risk < least - 1e-12:
            best, least = weights, risk
        down = slope(mean_u, u, weights, -1) - prior * slope(mean_p, p, weights, -1)
        # where the negatives' risk has gone below nothing, the step takes it back up
        gradient = prior * slope(mean_p, p, weights, 1) + down + ridge * weights / 2 if negative >= 0 else -down
        weights = weights - 0.5 * np.linalg.solve(curve, gradient)
    return best


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """An upper bound of the share of positives in unlabelled text: the least ratio of a bin's frequency there
    to that among positives."""
    if not positive[-1, -1] or not unlabelled[-1, -1]:
        return 0.5
    p, u = np.diag(positive) / positive[-1, -1], np.diag(unlabelled) / unlabelled[-1, -1]
    common = p > 0.2
    return float(min(max(np.min(u[common] / p[common]), 0.02), 0.98))


#: Scores are counted in so many steps.
STEPS = 200


def scores(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((design(found) @ weights + 1) / 2, 0, 1)


def score_counts(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """How many documents score in each step from 0 to 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(STEPS, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(np.minimum((scores(_matrix(batch.column(0)), weights) * STEPS).astype(np.int64), STEPS - 1), minlength=STEPS)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    found = total(rows.select("bins").mapInArrow(count, "sums binary"), "sums")
    return np.zeros(STEPS, dtype=np.int64) if found is None else found


def refined_prior(positive: np.ndarray, unlabelled: np.ndarray, first: float) -> float:
    """The same bound over the sets of documents that score above a step: where hardly any negatives are, it is
    nearly the share itself. Only sets that hold half of all positives count, so that chance does not lower it."""
    if not positive.sum() or not unlabelled.sum():
        return first
    p, u = (np.cumsum(x[::-1]) / x.sum() for x in (positive, unlabelled))
    enough = p >= 0.5
    return float(min(max(min(first, np.min(u[enough] / p[enough])), 0.02), 0.98))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold).

    labels has id_col and label_col; only those that say 1 are learnt from. Labels of rows where held_out (a condition on id_col) is true are
    not used; nor are null labels, nor ids with contradictory ones. All documents count as unlabelled
    text. A null text is scored as an empty one. Without any positive label all scores are 0.5.
    Repeated rows are scored each and count each; a null id is neither held out nor labelled. An
    empty table gives an empty one; other columns are ignored.
    """
    held = F.coalesce(held_out, F.lit(False))
    rows = stored(features(docs, id_col, text_col), "quality")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held).groupBy(F.col(id_col).cast("long").alias("id"))
    good = known.agg(F.min(label_col).alias("least"), F.max(label_col).alias("most")).where("least = most and least = 1").select("id")
    trusted = stored(rows.join(good, "id", "left_semi"), "trusted")
    positive, unlabelled = pair_counts(trusted), pair_counts(rows)
    prior = estimated_prior(positive, unlabelled)
    first = fit(positive, unlabelled, prior)
    weights = fit(positive, unlabelled, refined_prior(score_counts(trusted, first), score_counts(rows, first), prior))
    discard(trusted)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(_matrix(batch.column(1)), weights))], names=["id", "score"])

    rated = rows.mapInArrow(rate, "id long, score double").withColumnRenamed("id", id_col)
    return rated.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
