"""Keywords of documents by TF-IDF and by graph ranking. Input: a frame with an id and a column of tokens."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import opened
from ..functions.kernels import _sliced as sliced
from ..functions.kernels import over_list


#: Rows of a batch that are worked at once.
SLICE = 1024


def term_counts(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, word, cnt, first_pos, n_tokens), one row for each word of a document, which is a row.

    A document's words are counted in its own row: nothing is shuffled, and no task holds more than a slice of a batch.
    """
    rows = docs.select(id_col, tokens_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                lists = batch.column(1)
                known = lists.flatten().dictionary_encode()
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                row, pos = np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                size = max(len(known.dictionary), 1)
                is_word = known.indices.is_valid().to_numpy(zero_copy_only=False)
                key = row[is_word] * size + known.indices.drop_null().to_numpy()
                found, first, cnt = np.unique(key, return_index=True, return_counts=True)
                of = found // size
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), known.dictionary.take(pa.array(found % size)), pa.array(cnt, pa.int64()), pa.array(pos[is_word][first], pa.int32()), pa.array(lengths[of], pa.int32())], names=[id_col, "word", "cnt", "first_pos", "n_tokens"])

    return rows.mapInArrow(count, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, word string, cnt long, first_pos int, n_tokens int")


def fit_idf(docs: DataFrame, max_features: int | None = 5000, smooth: bool = True, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(word, df, idf) of the most frequent words by document frequency, ties by word. Documents without tokens don't count."""
    words = opened(docs, F.array_distinct(tokens_col), "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        words = words.orderBy(F.desc("df"), "word").limit(max_features)
    n = docs.where(F.size(tokens_col) > 0).agg(F.count(F.lit(1)).alias("n_docs"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1.0 if smooth else F.log(F.col("n_docs") / F.col("df"))
    return words.join(F.broadcast(n)).select("word", "df", idf.alias("idf"))  # one row on the right


def score_tfidf(docs: DataFrame, idf: DataFrame, sublinear: bool = False, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, word, score, first_pos); words outside the vocabulary have none, but count in a document's length."""
    counts = term_counts(docs, id_col, tokens_col)
    tf = F.log(1.0 + F.col("cnt")) if sublinear else F.col("cnt") / F.col("n_tokens")
    return counts.join(idf, "word").select(id_col, "word", (tf * F.col("idf")).alias("score"), "first_pos")


def top_words(scores: DataFrame, n: int = 10, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """(id, rank, word, score): ties in the rounded score go to the word met first."""
    rounded = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "first_pos"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= n).select(id_col, "rank", "word", "score")


def tfidf(docs: DataFrame, n: int = 10, max_features: int | None = 5000, smooth: bool = True, sublinear: bool = False, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    idf = fit_idf(docs, max_features, smooth, id_col, tokens_col)
    if max_features is not None:
        idf = F.broadcast(idf)  # max_features rows at most
    return top_words(score_tfidf(docs, idf, sublinear, id_col, tokens_col), n, id_col)


def near_pairs(tokens: list[str], window: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order of their first place, and (src, dst, weight) of the different ones that
    stand within the window, both ways."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(t, len(number)) for t in tokens], dtype=np.int64)
    steps = range(1, min(window, len(ids) - 1) + 1)
    a = np.concatenate([ids[:0], *(ids[:-d] for d in steps)])
    b = np.concatenate([ids[:0], *(ids[d:] for d in steps)])
    a, b = a[(keep := a != b)], b[keep]
    n = max(len(number), 1)
    edges, weight = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    return list(number), edges // n, edges % n, weight


def cooccurrence(docs: DataFrame, window: int = 3, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, src, dst, weight): how often two different words of a document, a row, stand within the window, both ways.

    A document's pairs are counted in its own row: nothing is shuffled.
    """
    rows = docs.select(id_col, tokens_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tokens in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words, src, dst, weight = near_pairs([t for t in tokens or () if t is not None], window)
                said = pa.array(words, pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(key, len(src)), said.take(pa.array(src)), said.take(pa.array(dst)), pa.array(weight, pa.int64())], names=[id_col, "src", "dst", "weight"])

    return rows.mapInArrow(work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, src string, dst string, weight long")


def rank_graph(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, damping: float = 0.85, most: int = 100, tolerance: float = 1e-4) -> np.ndarray:
    """Scores of the nodes of a weighted graph given both ways. The restart term is 1 - damping for each node,
    and what nodes without edges hold goes to all alike; stops once a sweep changes less than tolerance in all."""
    if n <= 1:
        return np.ones(n)
    out = np.bincount(src, weight, minlength=n)
    share = weight / out[src] if len(src) else weight
    loose = out == 0
    score = np.full(n, 1.0 / n)
    for _ in range(most):
        new = (1 - damping) + damping * (np.bincount(dst, share * score[src], minlength=n) + score[loose].sum() / n)
        change = np.abs(new - score).sum()
        score = new
        if change < tolerance:
            break
    return score


def rank_tokens(tokens: list[str], window: int, damping: float, most: int, tolerance: float) -> tuple[list[str], np.ndarray]:
    """Distinct tokens in order of their first place, and their scores."""
    words, src, dst, weight = near_pairs(tokens, window)
    if len(words) < 2:
        return words, np.ones(len(words))
    return words, rank_graph(len(words), src, dst, weight.astype(float), damping, most, tolerance)


def textrank(docs: DataFrame, n: int = 10, window: int = 3, damping: float = 0.85, most: int = 100, tolerance: float = 1e-4, digits: int = 6, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, rank, word, score) by graph ranking of each document's words: a row at a time, nothing is shuffled."""
    rows = docs.select(id_col, tokens_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rank, word, score = [], [], [], []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, scores = rank_tokens([t for t in tokens or () if t is not None], window, damping, most, tolerance)
                scores = np.round(scores, digits)
                for r, i in enumerate(np.argsort(-scores, kind="stable")[:n], 1):
                    ids.append(key)
                    rank.append(r)
                    word.append(words[i])
                    score.append(float(scores[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(rank, pa.int32()), pa.array(word, pa.string()), pa.array(score, pa.float64())], names=[id_col, "rank", "word", "score"])

    return rows.mapInArrow(work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, rank int, word string, score double")


def rank_lists(lists: list[list[str]], window: int = 3, damping: float = 0.85, most: int = 100, tolerance: float = 1e-4) -> list[tuple[list[str], np.ndarray]]:
    """rank_tokens() of many documents, with the same scores: their graphs lie side by side and are swept
    together; each leaves when it would have stopped by itself. Of two different words or more, none is without an edge."""
    numbers, ids, base = [], [], 0
    for said in lists:
        number: dict[str, int] = {}
        ids.append(np.fromiter((base + number.setdefault(t, len(number)) for t in said), np.int64, len(said)))
        base += len(number)
        numbers.append(number)
    at, of = np.concatenate([np.zeros(0, np.int64), *ids]), np.repeat(np.arange(len(lists)), [len(x) for x in ids])
    steps = range(1, min(window, len(at) - 1) + 1)
    inside = [(at[:-d] != at[d:]) & (of[:-d] == of[d:]) for d in steps]
    a = np.concatenate([at[:0], *(at[:-d][k] for d, k in zip(steps, inside, strict=True))])
    b = np.concatenate([at[:0], *(at[d:][k] for d, k in zip(steps, inside, strict=True))])
    edges, weight = np.unique(np.concatenate([a * max(base, 1) + b, b * max(base, 1) + a]), return_counts=True)
    src, dst, weight = edges // max(base, 1), edges % max(base, 1), weight.astype(float)
    many = np.array([len(n) for n in numbers], dtype=np.int64)
    final = np.ones(base)
    share = weight / np.bincount(src, weight, minlength=base)[src]
    docs = np.flatnonzero(many > 1)  # those not done, their nodes in order, and where they lie among the others
    node = np.flatnonzero(np.repeat(many > 1, many))
    place = np.cumsum(np.repeat(many > 1, many)) - 1
    src, dst = place[src], place[dst]
    score = 1.0 / np.repeat(many[docs], many[docs])
    for _ in range(most):
        if not len(docs):
            break
        begin = np.cumsum(many[docs]) - many[docs]
        new = (1 - damping) + damping * np.bincount(dst, share * score[src], minlength=len(score))
        moved = np.abs(new - score)
        change = np.add.reduceat(moved, begin)
        for i in np.flatnonzero(np.abs(change - tolerance) < 1e-9):  # summed in another order, which may decide
            change[i] = moved[begin[i] : begin[i] + many[docs[i]]].sum()
        score = new
        done = change < tolerance
        if done.any():
            left = np.repeat(~done, many[docs])
            final[node[~left]] = score[~left]
            kept, place = left[src], np.cumsum(left) - 1
            src, dst, share = place[src[kept]], place[dst[kept]], share[kept]
            docs, node, score = docs[~done], node[left], score[left]
    final[node] = score
    return list(zip(map(list, numbers), np.split(final, np.cumsum(many)[:-1]) if len(many) else [], strict=True))


#: Words of documents that are ranked together; a longer one is ranked by itself.
TOGETHER = 1 << 15


def _together(lists: list[list[str]]) -> Iterator[list[list[str]]]:
    held, size = [], 0
    for said in lists:
        if held and size + len(said) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(said)
        size += len(said)
    if held:
        yield held


RANKED = "array<struct<rank:int,word:string,score:double>>"
RANKING = pa.list_(pa.struct([("rank", pa.int32()), ("word", pa.string()), ("score", pa.float64())]))


def _told(words: list[tuple[str, float]]) -> list[dict] | None:
    return [{"rank": r, "word": w, "score": s} for r, (w, s) in enumerate(words, 1)] or None


def textrank_of(tokens: Column, n: int = 10, window: int = 3, damping: float = 0.85, most: int = 100, tolerance: float = 1e-4, digits: int = 6) -> Column:
    """textrank() as a column: an array of (rank, word, score), null without words."""

    def work(some: pa.Array) -> pa.Array:
        out = []
        for lists in _together([[t for t in said or () if t is not None] for said in some.to_pylist()]):
            for words, scores in rank_lists(lists, window, damping, most, tolerance):
                scores = np.round(scores, digits)
                out.append(_told([(words[i], float(scores[i])) for i in np.argsort(-scores, kind="stable")[:n]]))
        return pa.array(out, RANKING)

    @F.arrow_udf(RANKED)
    def run(lists: pa.Array) -> pa.Array:
        return sliced(work, lists)

    return run(tokens)


def _rounded(x: float) -> float:
    """To six digits as Spark's round: halves of the shortest decimal form go up."""
    low = math.floor(x * 1e6)
    if abs(x * 1e6 - low - 0.5) < 1e-3:
        return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return round(x, 6)


def tfidf_of(tokens: Column, idf: DataFrame, n: int = 10) -> Column:
    """The n best words of score_tfidf() as a column, an array of (rank, word, score), null without known words.
    idf: a fitted table of a bounded number of words (fit_idf's max_features), which goes to all tasks."""
    known = {r.word: r.idf for r in idf.select("word", "idf").collect()}

    def ranked(said: list) -> list[dict] | None:
        counts = Counter(t for t in said if t is not None)  # in order of their first place
        scored = [(w, _rounded(c / len(said) * known[w])) for w, c in counts.items() if w in known]
        return _told(sorted(scored, key=lambda x: -x[1])[:n])

    return over_list(ranked, RANKED, RANKING)(tokens)


def keywords(docs: DataFrame, method: str = "tfidf", n: int = 10, **options) -> DataFrame:
    if method == "tfidf":
        return tfidf(docs, n, **options)
    if method == "textrank":
        return textrank(docs, n, **options)
    raise ValueError(f"no such method: {method}")
