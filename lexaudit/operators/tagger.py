"""Training of the sequence labeller from rows with marked names: an averaged perceptron in every part of the rows,
mixed after each epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tagging import BITS, Tagger, decode, windows
from .reduction import SCHEMA, pieces, summed
from .scratch import discard, stored

#: Texts that are decoded at once, if those before them turn out right.
AHEAD = 256


def marked(texts: list[str], names: list[list[dict]], kinds: tuple[str, ...]) -> np.ndarray:
    """The labels of all characters; of names that overlap, the first holds."""
    start = np.append(0, np.cumsum([len(t) for t in texts]))
    out = np.zeros(start[-1], dtype=np.int64)
    for d, found in enumerate(names):
        for x in sorted(found or [], key=lambda x: (x["start"], -x["stop"])):
            a, b = start[d] + x["start"], start[d] + x["stop"]
            if x["kind"] in kinds and a < b <= start[d + 1] and not out[a:b].any():
                out[a:b] = 2 + 2 * kinds.index(x["kind"])
                out[a] -= 1
    return out


def learn(texts: list[str], gold: np.ndarray, features: np.ndarray, follow: np.ndarray, mean: tuple[np.ndarray, np.ndarray], steps: int) -> int:
    """One pass over texts, one after another: a wrong sequence moves the weights, in place; mean gathers what averaging needs.

    Texts whose sequences are right move nothing, so many are decoded together up to the first wrong one;
    those behind it are decoded again with the weights that it has moved.
    """
    start = np.append(0, np.cumsum([len(t) for t in texts]))
    for low in range(0, len(texts), AHEAD):
        some = texts[low : low + AHEAD]
        buckets, at = windows(some)
        truth = gold[start[low] : start[low] + at[-1]]
        lo, size = 0, 1
        while lo < len(some):
            hi = min(lo + size, len(some))
            a = at[lo]
            said = decode(buckets[a : at[hi]], at[lo : hi + 1] - a, features, follow)
            off = np.flatnonzero(said != truth[a : at[hi]])
            if not len(off):
                steps += hi - lo
                lo, size = hi, 2 * size
                continue
            d = int(np.searchsorted(at, a + off[0], side="right")) - 1
            size = d - lo + 1
            steps += size
            begin, end = at[d], at[d + 1]
            _move(buckets[begin:end], truth[begin:end], said[begin - a : end - a], features, follow, mean, steps)
            lo = d + 1
    return steps


def _move(buckets: np.ndarray, truth: np.ndarray, said: np.ndarray, features: np.ndarray, follow: np.ndarray, mean: tuple[np.ndarray, np.ndarray], steps: int) -> None:
    wrong = np.flatnonzero(said != truth)
    for labels, sign in ((truth, 1.0), (said, -1.0)):
        which, label = buckets[wrong].ravel(), np.repeat(labels[wrong], buckets.shape[1])
        change = np.zeros_like(follow)
        np.add.at(change, (labels[:-1], labels[1:]), sign)
        for weights, times in ((features, 1.0), (mean[0], float(steps))):
            np.add.at(weights, (which, label), sign * times)
        follow += change
        mean[1][:] += change * steps


def train(rows: DataFrame, kinds: tuple[str, ...], text_col: str = "text", names_col: str = "names", epochs: int = 4, shards: int = 8) -> Tagger:
    """The tagger from rows with names, an array of (kind, start, stop) in a column, offsets in characters from 0.

    Rows are dealt into shards by a digest of the text; in each epoch every shard's perceptron starts from
    the mean of all, and the result is the mean of their averages over the last epoch. Shards read their
    rows as a stream. Weights have 65,536 features for each label, whatever the rows. Null texts and names
    of other kinds are left out; without rows all weights are 0, and nothing is a name.
    """
    spark = rows.sparkSession
    labels = 1 + 2 * len(kinds)
    size = (1 << BITS) * labels
    held = rows.select(F.col(text_col).alias("text"), F.col(names_col).alias("names")).where(F.col("text").isNotNull())
    held = stored(held.repartition(shards, F.xxhash64("text")).sortWithinPartitions("text"), "marked")
    features, follow = np.zeros((1 << BITS, labels)), np.zeros((labels, labels))
    result = Tagger(kinds, features, follow)
    try:
        for epoch in range(epochs):
            shared = spark.sparkContext.broadcast((features, follow))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                w, f = (x.copy() for x in shared.value)
                mean, steps = (np.zeros_like(w), np.zeros_like(f)), 0
                for batch in batches:
                    texts = batch.column(0).to_pylist()
                    steps = learn(texts, marked(texts, batch.column(1).to_pylist(), kinds), w, f, mean, steps)
                if steps:  # the mean of the weights after each step
                    average = [x - (m - (x - x0)) / steps for x, m, x0 in zip((w, f), mean, shared.value, strict=True)]
                    yield pieces(np.concatenate([[1.0], w.ravel(), f.ravel(), average[0].ravel(), average[1].ravel()]))

            found = summed(held.mapInArrow(run, SCHEMA))
            shared.unpersist()
            if found is None:
                break
            found = found[1:] / found[0]
            cut = np.split(found, np.cumsum([size, labels * labels, size]))
            features, follow = cut[0].reshape(features.shape), cut[1].reshape(follow.shape)
            result = Tagger(kinds, cut[2].reshape(features.shape).astype(np.float32), cut[3].reshape(follow.shape))
    finally:
        discard(held)
    return result
