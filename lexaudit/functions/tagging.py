"""A sequence labeller of characters: windows of characters score the labels, Viterbi finds the best sequence.

Labels are 0 for none, and for each kind of name its beginning and its inside. All texts of an Arrow
batch are decoded at once, place by place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from .kernels import Span, over_texts

BITS = 16
#: Places, relative to a character, whose characters make a feature together.
WINDOWS = ((0,), (-1,), (1,), (-2, -1), (-1, 0), (0, 1), (1, 2), (-2,), (2,))


@dataclass(frozen=True)
class Tagger:
    """Kinds of names in order; weights of features by label, and of a label after another."""

    kinds: tuple[str, ...]
    features: np.ndarray
    follow: np.ndarray

    @property
    def labels(self) -> int:
        return 1 + 2 * len(self.kinds)


def allowed(labels: int) -> np.ndarray:
    """0 where a label may follow another, else minus infinity: an inside follows its own kind only."""
    out = np.zeros((labels, labels))
    for inside in range(2, labels, 2):
        out[:, inside] = -np.inf
        out[[inside - 1, inside], inside] = 0
    return out


def windows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each character's features, and where each text's characters begin; two blanks part texts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer(("\0\0" + "".join(t + "\0\0" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.append(0, np.cumsum(lengths))
    at = np.arange(start[-1]) + 2 + 2 * np.repeat(np.arange(len(texts)), lengths)
    out = np.empty((len(at), len(WINDOWS)), dtype=np.int64)
    for k, window in enumerate(WINDOWS):
        h = np.full(len(at), 0x9E3779B1 * (k + 1) & 0xFFFFFFFF, dtype=np.uint32)
        for place in window:
            h = (h ^ codes[at + place]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out[:, k] = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    return out, start


def decode(buckets: np.ndarray, start: np.ndarray, features: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The label of each character on its text's best sequence; of equal ones that with the smaller labels.

    Places are dealt by their number in the text, so that a step's are a slice; which label came before is
    asked on the way back, of the best sequence alone.
    """
    n = features.shape[1]
    may = follow + allowed(n)
    lengths = np.diff(start)
    order = np.argsort(-lengths, kind="stable")
    begin, many = start[:-1][order], np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")  # texts longer than t
    off = np.append(0, np.cumsum(many))
    nth = np.arange(off[-1]) - np.repeat(off[:-1], many)
    place = begin[nth] + np.repeat(np.arange(len(many)), many)
    shown = features[buckets[place, 0]]
    for k in range(1, buckets.shape[1]):
        shown += features[buckets[place, k]]
    shown = np.ascontiguousarray(shown.T)
    score = np.empty((n, off[-1]))
    first = np.zeros((n, 1))
    first[2::2] = -np.inf
    for t, m in enumerate(many):
        here = shown[:, off[t] : off[t + 1]]
        if t == 0:
            np.add(here, first, out=score[:, :m])
        else:
            before = score[:, off[t - 1] : off[t - 1] + m]
            np.add((before[:, None, :] + may[:, :, None]).max(axis=0), here, out=score[:, off[t] : off[t + 1]])
    out, label = np.zeros(len(place), dtype=np.int64), np.zeros(0, dtype=np.int64)
    for t in range(len(many) - 1, -1, -1):
        now, m = score[:, off[t] : off[t + 1]], len(label)
        said = np.empty(many[t], dtype=np.int64)
        said[:m] = (now[:, :m] + may[:, label]).argmax(axis=0)  # what stands before the labels of those that go on
        said[m:] = now[:, m:].argmax(axis=0)
        out[off[t] : off[t + 1]] = label = said
    labels = np.empty_like(out)
    labels[place] = out
    return labels


def spans_of(labels: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) of the names that labels mark."""
    inside = labels > 0
    opens = np.flatnonzero(labels % 2 == 1)
    edge = np.zeros(len(labels) + 1, dtype=bool)
    edge[start] = True
    goes_on = np.append(inside[1:] & (labels[1:] % 2 == 0) & ~edge[1:-1], False) if len(labels) else np.zeros(0, dtype=bool)
    stops = np.flatnonzero(inside & ~goes_on) + 1
    text = np.searchsorted(start, opens, side="right") - 1
    return list(zip(text.tolist(), ((labels[opens] - 1) // 2).tolist(), (opens - start[text]).tolist(), (stops - start[text]).tolist(), strict=True))


def finder(tagger: Tagger, rank: int = 6) -> Callable[[list[str]], list[list[Span]]]:
    """A function from texts to the names of each in order, as spans of the tagger's kinds."""

    def find(texts: list[str]) -> list[list[Span]]:
        buckets, start = windows(texts)
        out: list[list[Span]] = [[] for _ in texts]
        for d, kind, a, b in spans_of(decode(buckets, start, tagger.features, tagger.follow), start):
            out[d].append((texts[d][a:b], tagger.kinds[kind], a, b, rank + kind))
        return out

    return find


def names(text: Column, tagger: Tagger, rank: int = 6) -> Column:
    """The names of each text in order; null and empty texts have none."""
    return over_texts(finder(tagger, rank))(text)
