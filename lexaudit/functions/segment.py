"""Segmentation of text without spaces: the likeliest path through a word graph, and a hidden Markov model for what no word covers.

All words of the dictionary that begin at a place are edges of a graph over a run of ideographs; the path
with the greatest sum of weights wins. Weights are logarithms of frequencies in millionths, as integers:
sums are exact, and of equal sums the longer word wins. Neighbouring characters that the path leaves
single are cut again by a model of how words begin, go on and end, if there is one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column

from .kernels import over_text

#: Ideographs, Latin words, or any other character by itself.
PIECE = re.compile(r"[一-鿿]+|[^\W_一-鿿]+|.", re.DOTALL)
SCALE = 1_000_000
BEGIN, MIDDLE, END, SINGLE = "B", "M", "E", "S"
#: What may follow what within a text.
NEXT = {BEGIN: (MIDDLE, END), MIDDLE: (MIDDLE, END), END: (BEGIN, SINGLE), SINGLE: (BEGIN, SINGLE)}


def weight(count: int, total: int) -> int:
    return round(SCALE * math.log(count / total))


@dataclass(frozen=True)
class Shapes:
    """Log-probabilities of a hidden Markov model over the places of characters in words."""

    first: Mapping[str, float]
    follow: Mapping[tuple[str, str], float]
    shown: Mapping[tuple[str, str], float]
    unseen: Mapping[str, float]

    def cut(self, run: str) -> list[str]:
        """The words of the likeliest states; a word that the run's end leaves open ends there."""
        show = lambda s, c: self.shown.get((s, c), self.unseen[s])
        score = {s: self.first[s] + show(s, run[0]) for s in (BEGIN, SINGLE)}
        back: list[dict[str, str]] = []
        for c in run[1:]:
            new: dict[str, float] = {}
            came: dict[str, str] = {}
            for s in NEXT:
                ways = [(score[p] + self.follow[p, s], p) for p in score if s in NEXT[p]]
                if ways:
                    best, came[s] = max(ways)
                    new[s] = best + show(s, c)
            score = new
            back.append(came)
        state = max((v, s) for s, v in score.items() if s in (END, SINGLE))[1] if len(run) > 1 else SINGLE
        states = [state]
        for came in reversed(back):
            states.append(came[states[-1]])
        out, word = [], ""
        for c, s in zip(run, reversed(states), strict=True):
            word += c
            if s in (END, SINGLE):
                out.append(word)
                word = ""
        return [*out, word] if word else out


@dataclass(frozen=True)
class Dictionary:
    """Words and their counts; total is the count of all words, known or not."""

    counts: Mapping[str, int]
    total: int
    weights: dict[str, int] = field(init=False, repr=False)
    starts: frozenset[str] = field(init=False, repr=False)
    unknown: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "weights", {w: weight(n, self.total) for w, n in self.counts.items() if n > 0})
        object.__setattr__(self, "starts", frozenset(w[:i] for w in self.weights for i in range(1, len(w) + 1)))
        object.__setattr__(self, "unknown", weight(1, max(self.total, 1)))

    def best_path(self, run: str) -> list[str]:
        n, weights, starts = len(run), self.weights, self.starts
        best, take = [0] * (n + 1), [1] * n
        for i in reversed(range(n)):
            most, size = weights.get(run[i], self.unknown) + best[i + 1], 1
            j = i + 1
            while j < n and run[i : j + 1] in starts:
                j += 1
                w = weights.get(run[i:j])
                if w is not None and w + best[j] >= most:
                    most, size = w + best[j], j - i
            best[i], take[i] = most, size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + take[i]])
            i += take[i]
        return out

    def cut(self, text: str, shapes: Shapes | None = None) -> list[str]:
        """The words of a text; Latin words and single other characters are words as they stand."""
        out: list[str] = []
        for piece in PIECE.findall(text):
            if not "一" <= piece[0] <= "鿿":
                out.append(piece)
                continue
            path = self.best_path(piece)
            if shapes is None:
                out += path
                continue
            loose = ""
            for word in [*path, ""]:
                if len(word) == 1:
                    loose += word
                    continue
                if loose:
                    out += shapes.cut(loose) if len(loose) > 1 and loose not in self.weights else [loose]
                    loose = ""
                if word:
                    out.append(word)
        return out


def segment(text: Column, dictionary: Dictionary, shapes: Shapes | None = None) -> Column:
    """The words of each text, in order; a null text has none. The dictionary goes to all tasks: see
    operators.dictionary for its bound."""
    return over_text(lambda t: dictionary.cut(t, shapes), "array<string>", pa.list_(pa.string()))(text)
