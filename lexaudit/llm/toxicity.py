"""Toxicity: texts are restored from disguised spelling by a noisy channel, then scored.

The channel writes a letter as itself, as a look-alike digit or symbol, three times or more, or puts
single letters apart. What may have passed it, a span, is a lattice: each place may be some letters, a
break between words, or nothing. The best path under a trigram model of characters, counted over all
documents, is found by Viterbi's algorithm, many spans at once. All other text has one path only, which
is the text itself. The score rests on the restored words: how strongly each word, or how it begins,
is tied to toxic documents, and how many such words a document has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reduction import SCHEMA, pieces, summed
from .base import discard, mix, prefix_sums, small_batches, span_hashes, stored, tidy, total, utf8
from .language import folding

#: What look-alikes may stand for, two letters at most. Parameters.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: What may stand between single letters of one word.
SEPARATORS = " .-*~"
#: Costs (negative logarithms) of the channel: a look-alike, a letter meant twice where it stands more often, no
#: break where a separator stands, a break there, and a look-alike that is a symbol after all.
ALIKE_COST, TWICE_COST, DROP_COST, BREAK_COST, SYMBOL_COST = 1.0, 2.5, 0.0, 1.0, 1.5

#: Characters of the model: 0 a break, 1-26 a-z, 27-59 U+00DF-U+00FF, 60 any other letter.
BITS = 6
SIZE = 1 << BITS
OTHER = 60
#: Letters and lengths that a place of the lattice offers at most.
OFFERS = 4
#: Places of spans that are decoded at once, and spans that a task remembers.
PLACES, MOST_REMEMBERED = 50_000, 200_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: Labelled rows that are learnt from, those of the smallest digests of their ids.
    sample: int = 200_000
    #: Bytes that a word may begin with to count as a feature, besides the whole word.
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    #: Standard deviations that a feature's log-odds are lowered by, and toxic documents that it needs.
    doubt: float = 2.0
    least: int = 3
    #: A document's words are counted by how strong they are.
    levels: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0)
    ridge: float = 1.0
    steps: int = 12


# ---------------------------------------------------------------- the language model


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """By code point, the character of the model."""
    low = folding()
    out = np.where(low > 0, OTHER, 0).astype(np.uint8)
    latin = (low >= 97) & (low <= 122)
    out[latin] = low[latin] - 96
    wide = (low >= 0xDF) & (low <= 0xFF)
    out[wide] = low[wide] - 0xDF + 27
    return out


def trigrams(text: str) -> np.ndarray:
    """The numbers of a text's trigrams; a break counts twice, so that words begin and end without memory."""
    codes = np.append(_codes()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)], 0)
    times = np.ones(len(codes), dtype=np.int64)
    blank = codes == 0
    times[blank] = 2
    times[1:][blank[1:] & blank[:-1]] = 0
    x = np.repeat(codes, times).astype(np.int64)
    return (x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:]


def count_characters(texts: DataFrame) -> np.ndarray:
    """Trigram counts over all rows of the one column, SIZE x SIZE x SIZE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros(SIZE**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(trigrams(text))
                    size += len(text)
                if size > 1 << 20:
                    sums += np.bincount(np.concatenate(held), minlength=SIZE**3)
                    held, size = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=SIZE**3)
        yield pieces(sums)

    found = summed(texts.mapInArrow(count, SCHEMA))
    return (np.zeros(SIZE**3) if found is None else found).astype(np.int64).reshape(SIZE, SIZE, SIZE)


def model(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log-probabilities of a character after two others; rare pairs lean on the last character, then on none."""
    n = counts.astype(float)
    one = n.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    two = n.sum(axis=0)
    p2 = (two + weight * p1) / (two.sum(axis=1, keepdims=True) + weight)
    p3 = (n + weight * p2) / (n.sum(axis=2, keepdims=True) + weight)
    return np.log(p3).astype(np.float32)


# ---------------------------------------------------------------- lattices

_RUN = r"\w" + "".join(map(re.escape, (c for c in LOOK_ALIKES if not c.isalnum())))
_ALIKE = "".join(map(re.escape, LOOK_ALIKES))
SPAN = re.compile(
    rf"(?<![{_RUN}])[{_RUN}](?:[{re.escape(SEPARATORS)}]{{1,2}}[{_RUN}]){{2,}}(?![{_RUN}])"  # single letters apart
    rf"|(?<![{_RUN}])(?=[^\W\d]*[{_ALIKE}])[{_RUN}]+"  # with look-alikes
    rf"|(?<![{_RUN}])(?=\w*?(\w)\1\1)[{_RUN}]+"  # with repetition
)


def offers(span: str) -> list[tuple[list[tuple[str, int, float]], float | None, float | None]]:
    """The places of a span: (letter, times, cost) offered, and the costs of a break and of nothing (None: not offered).
    Pieces of neither letters nor look-alikes are separators. A letter twice is plain spelling."""
    out = []
    for c, run in groupby(span):
        n = sum(1 for _ in run)
        if c in LOOK_ALIKES:
            found = [(x, 1, ALIKE_COST) for x in LOOK_ALIKES[c]]
            if n > 1:
                found += [(x, 2, ALIKE_COST + TWICE_COST) for x in LOOK_ALIKES[c]]
            out.append((found, SYMBOL_COST, None))
        elif c.isalpha():
            out.append(([(c, 1, 0.0), (c, 2, TWICE_COST)] if n > 2 else [(c, n, 0.0)], None, None))
        else:
            out.append(([], BREAK_COST, DROP_COST if c in SEPARATORS else None))
    return out


def _code(c: str) -> int:
    return int(_codes()[ord(c)])


def decode(spans: list[str], lm: np.ndarray) -> list[str]:
    """The best path of each span; breaks are spaces."""
    order = sorted(range(len(spans)), key=lambda i: len(spans[i]))
    out, lo = [""] * len(spans), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo) * len(spans[order[hi]]) < PLACES:
            hi += 1
        some, lo = order[lo:hi], hi
        for i, x in zip(some, _decode([offers(spans[i]) for i in some], lm), strict=True):
            out[i] = x
    return out


def _decode(lattices: list[list], lm: np.ndarray) -> list[str]:
    """Viterbi. State p * OFFERS + q: the last letter is offer q of its place, the one before it offer p - 1 of its own,
    or a break if p is 0; the last state is that after a break. A place without letters leaves the states as they are, or breaks."""
    n, length = len(lattices), max(map(len, lattices))
    value = np.zeros((length, n, OFFERS), dtype=np.int64)
    twice = np.zeros((length, n, OFFERS), dtype=bool)
    cost = np.full((length, n, OFFERS), np.inf, dtype=np.float32)
    pause = np.full((length, n), np.inf, dtype=np.float32)
    skip = np.zeros((length, n), dtype=np.float32)
    letters, over = np.zeros((length, n), dtype=bool), np.ones((length, n), dtype=bool)
    for i, places in enumerate(lattices):
        over[: len(places), i] = False
        for t, (found, a_break, nothing) in enumerate(places):
            for r, (c, times, price) in enumerate(found):
                value[t, i, r], twice[t, i, r], cost[t, i, r] = _code(c), times == 2, price
            letters[t, i] = bool(found)
            pause[t, i] = np.inf if a_break is None else a_break
            skip[t, i] = np.inf if nothing is None else nothing
    rows, wide = np.arange(n), (OFFERS + 1) * OFFERS
    state = np.full((n, OFFERS + 1, OFFERS), -np.inf, dtype=np.float32)
    first = np.zeros((n, OFFERS + 1, OFFERS), dtype=np.int64)  # the letter before last of each state
    last = np.zeros((n, OFFERS), dtype=np.int64)
    apart = np.zeros(n, dtype=np.float32)
    back = np.empty((length, n, wide + 1), dtype=np.int8)

    def ended() -> tuple[np.ndarray, np.ndarray]:
        done = (state + lm[first, last[:, None, :], 0]).reshape(n, -1)
        where = done.argmax(axis=1)
        return done[rows, where], where

    for t in range(length):
        v, w, here = value[t], twice[t], letters[t][:, None, None]
        closed, where = ended()
        closed, still = closed - pause[t], apart - np.minimum(pause[t], np.where(letters[t], np.inf, skip[t]))
        step = state[:, :, :, None] + lm[first[:, :, :, None], last[:, None, :, None], v[:, None, None, :]]  # p, q, r
        best = step.argmax(axis=1)
        moved, new_first = np.empty_like(state), np.empty_like(first)
        moved[:, 1:] = np.take_along_axis(step, best[:, None], axis=1)[:, 0] + np.where(w[:, None, :], lm[last[:, :, None], v[:, None, :], v[:, None, :]], 0) - cost[t][:, None, :]
        moved[:, 0] = apart[:, None] + lm[0, 0, v] + np.where(w, lm[0, v, v], 0) - cost[t]
        new_first[:, 1:] = np.where(w[:, None, :], v[:, None, :], last[:, :, None])
        new_first[:, 0] = np.where(w, v, 0)
        back[t, :, :wide] = np.arange(wide)
        from_letters = np.concatenate([np.full((n, 1, OFFERS), wide), best * OFFERS + np.arange(OFFERS)[:, None]], axis=1).reshape(n, wide)
        back[t, :, :wide] = np.where(letters[t][:, None], from_letters, back[t, :, :wide])
        back[t, :, wide] = np.where(over[t] | (still >= closed), wide, where)
        state = np.where(here, moved, state - skip[t][:, None, None]).astype(np.float32)
        first, last = np.where(here, new_first, first), np.where(letters[t][:, None], v, last)
        apart = np.where(over[t], apart, np.maximum(closed, still)).astype(np.float32)
    closed, where = ended()
    now = np.where(closed > apart, where, wide)
    said: list[list[str]] = [[] for _ in lattices]
    for t in reversed(range(length)):
        came = back[t, rows, now]
        for i in np.flatnonzero(~over[t] & (now < wide) & letters[t]):
            c, times, _ = lattices[i][t][0][now[i] % OFFERS]
            said[i].append(c * times)
        for i in np.flatnonzero((now == wide) & (came < wide)):
            said[i].append(" ")
        now = came
    return ["".join(reversed(x)).strip() for x in said]


# ---------------------------------------------------------------- restored texts

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[[b for c in LOOK_ALIKES if ord(c) < 128 for b in c.encode()]] = True
_WORD_BASE = 0x9FB21C651E98DF25


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a document, lower-cased UTF-8 from an offset to the next, can hold a span at all."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, dtype=bool)
    letter, odd = _LETTER[data], _ODD[data]
    hit = np.zeros(len(data), dtype=bool)
    hit[1:] |= odd[1:] & letter[:-1]
    hit[:-1] |= odd[:-1] & letter[1:]
    hit[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    hit[1:] |= (data[1:] >= 128) & (data[:-1] >= 128)  # such letters, and look-alikes beyond ASCII, may do anything
    single = letter | odd
    single[1:] &= ~(letter | odd)[:-1]
    single[:-1] &= ~(letter | odd)[1:]
    hit[2:] |= single[2:] & single[:-2]
    hit[3:] |= single[3:] & single[:-3]
    upto = np.append(0, np.cumsum(hit))
    return upto[offsets[1:]] > upto[offsets[:-1]]


class Restorer:
    """Remembers spans that it has decoded."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm, {}

    def restore(self, texts: list[str | None]) -> list[str]:
        """Lower-cased texts with every span in its best reading; null is empty."""
        low = [(t or "").lower().replace("_", "-") for t in texts]
        may = suspects(*utf8(pa.array(low, pa.large_string())))
        found = {i: [m.span() for m in SPAN.finditer(low[i]) if any(map(str.isalpha, m.group()))] for i in np.flatnonzero(may)}
        if len(self.known) > MOST_REMEMBERED:
            self.known = {}
        new = list({low[i][a:b] for i, spans in found.items() for a, b in spans} - self.known.keys())
        self.known.update(zip(new, decode(new, self.lm), strict=True))
        for i, spans in found.items():
            if spans:
                text, parts, at = low[i], [], 0
                for a, b in spans:
                    parts += [text[at:a], self.known[text[a:b]]]
                    at = b
                low[i] = "".join([*parts, text[at:]])
        return low


def word_features(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, bucket) of each feature of each word: how it begins, and the whole word. Words, runs of a-z and
    of characters beyond ASCII, are numbered through all texts."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # where one text ends and the next begins
    edge[offsets] = True
    before, after = np.append(False, letter[:-1]) & ~edge[:-1], np.append(letter[1:], False) & ~edge[1:]
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    owner = np.searchsorted(offsets, start, side="right") - 1
    sums = prefix_sums(mix(data.astype(np.uint64) + np.uint64(1)), _WORD_BASE)
    words, buckets, shift = [], [], np.uint64(64 - s.bits)
    for k in (0, *s.prefixes):
        some = np.flatnonzero(end - start >= k)
        to = start[some] + k if k else end[some]
        words.append(some)
        buckets.append((mix(span_hashes(sums, start[some], to, _WORD_BASE, len(data)) + np.uint64(k + 1)) >> shift).astype(np.int64))
    words = np.concatenate(words)
    return owner[words], words, np.concatenate(buckets)


def parts_of(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list[str | None]]]:
    """Some texts at a time: (from, to, texts)."""
    _, offsets = utf8(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1, len(texts)))
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


# ---------------------------------------------------------------- learning and scoring


def half_of(texts: list[str]) -> np.ndarray:
    """0 or 1 by the text: copies fall in the same half."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t.encode()) & 1 for t in texts], dtype=np.int64)


def evidence(counts: np.ndarray, totals: np.ndarray, s: Settings) -> np.ndarray:
    """By bucket, how far a feature's log-odds in toxic against other documents surely exceed those of chance."""
    other, toxic = counts.astype(float)
    w = np.log((toxic + 0.5) / (totals[1] + 1)) - np.log((other + 0.5) / (totals[0] + 1))
    w -= s.doubt * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return np.where((w > 0) & (toxic >= s.least), w, 0).astype(np.float32)


def summary(owner: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """Rows of a constant and, for each level, how many words reach it, and how many of a thousand."""
    n_words = np.zeros(n)
    strength = np.zeros(int(word.max(initial=-1)) + 1, dtype=np.float32)
    np.maximum.at(strength, word, weight)
    of = np.zeros(len(strength), dtype=np.int64)
    of[word] = owner
    present = np.zeros(len(strength), dtype=bool)
    present[word] = True
    np.add.at(n_words, of[present], 1)
    out = [np.ones(n)]
    for level in s.levels:
        reached = np.bincount(of[strength >= level], minlength=n).astype(float)
        out += [np.log1p(reached), np.log1p(1000 * reached / (n_words + 20))]
    return np.stack(out, axis=1)


def fit(rows: DataFrame, width: int, s: Settings) -> np.ndarray:
    """Weights of a logistic regression with ridge, by Newton's steps; sums come from all tasks, added up in two steps."""
    weights = np.zeros(width)
    for _ in range(s.steps):

        def part(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width * (width + 1))
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, width)
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                sums[:width] += x.T @ (p - batch.column(1).to_numpy())
                sums[width:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        found = total(rows.select("cross", "toxic").mapInArrow(part, "sums binary"), "sums", kind=np.float64)
        if found is None:
            return weights
        ridge = s.ridge * np.append(0, np.ones(width - 1))
        step = np.linalg.solve(found[width:].reshape(width, width) + np.diag(ridge + 1e-6), found[:width] + ridge * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """One row per input row: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold).

    labels has id_col and label_col (0 or 1). Labels of rows where held_out (a condition on id_col) is
    true are not used; nor are null labels, nor ids with contradictory ones. Characters are counted over
    all documents; labelled ones are learnt from up to Settings.sample. A null text is scored as an empty
    one. Unless there are labels of both kinds, all scores are 0. Repeated rows are scored each and count
    each; a null id is neither held out nor labelled. An empty table gives an empty one; other columns
    are ignored. A text is held whole by its task, with some 100 bytes a character while it is worked on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(F.min(label_col).alias("least"), F.max(label_col).alias("toxic")).where("least = toxic and toxic in (0, 1)")
    known = stored(known.select("id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(s.sample), "labels")
    lm = spark.sparkContext.broadcast(model(count_characters(rows.select("text"))))
    counts = _count_features(rows.join(F.broadcast(known), "id").select("text", "toxic"), lm, s)
    halves, totals = counts[:, :, :-1], counts[:, :, -1]
    both = totals.sum(axis=0)
    width = 1 + 2 * len(s.levels)
    if not both.all():
        return docs.select(F.col(id_col).cast("long").alias(id_col), held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"))
    # what a labelled document's own half says of its words would flatter it
    tables = np.stack([evidence(halves[1], totals[1], s), evidence(halves[0], totals[0], s), evidence(halves.sum(axis=0), both, s)])
    shared = spark.sparkContext.broadcast(tables)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, tables = Restorer(lm.value), shared.value
        for batch in batches:
            for lo, hi, texts in parts_of(batch.column(1)):
                low = restorer.restore(texts)
                owner, word, bucket = word_features(low, s)
                half = half_of([t or "" for t in texts])
                told = (summary(owner, word, w, hi - lo, s) for w in (tables[2][bucket], tables[half[owner], bucket]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in told)], names=["id", "whole", "cross"])
        tidy()

    judged = stored(rows.mapInArrow(look, "id long, whole binary, cross binary"), "toxicity")
    trained = stored(judged.join(F.broadcast(known), "id").select("cross", "toxic"), "trained")
    weights = fit(trained, width, s)
    discard(trained)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], names=["id", "score"])

    rated = judged.select("id", "whole").mapInArrow(rate, "id long, score double").withColumnRenamed("id", id_col)
    return rated.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _count_features(labelled: DataFrame, lm, s: Settings) -> np.ndarray:
    """By half, label and bucket: how many labelled documents hold it; last, how many documents there are. The tasks'
    counts, 8 MB each, are added up by ranges over executors; the driver gets one vector."""
    wide = (1 << s.bits) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, sums = Restorer(lm.value), None
        for batch in batches:
            for lo, hi, texts in parts_of(batch.column(0)):
                sums = np.zeros(4 * wide, dtype=np.int64) if sums is None else sums
                owner, _, bucket = word_features(restorer.restore(texts), s)
                group = 2 * half_of([t or "" for t in texts]) + batch.column(1).slice(lo, hi - lo).to_numpy()
                distinct = np.unique(owner * wide + bucket)
                sums += np.bincount(group[distinct // wide] * wide + distinct % wide, minlength=4 * wide)
                sums[wide - 1 :: wide] += np.bincount(group, minlength=4)
        if sums is not None:
            yield pieces(sums)
        tidy()

    found = summed(labelled.mapInArrow(count, SCHEMA))
    return (np.zeros(4 * wide) if found is None else found).astype(np.int64).reshape(2, 2, wide)


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text of each row, lower-cased and restored under the model of all rows' characters; null gives ''."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lm = docs.sparkSession.sparkContext.broadcast(model(count_characters(rows.select("text"))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(lm.value)
        for batch in batches:
            for lo, hi, texts in parts_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(restorer.restore(texts), pa.string())], names=["id", "text"])

    return rows.mapInArrow(look, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
