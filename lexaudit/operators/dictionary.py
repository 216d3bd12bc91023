"""Dictionaries and models for segmentation, counted from segmented rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segment import BEGIN, END, MIDDLE, NEXT, SINGLE, Dictionary, Shapes

#: Words that a dictionary holds at most, the most frequent ones: it is sent to all tasks.
MOST_WORDS = 500_000


def word_counts(rows: DataFrame, words_col: str = "words") -> DataFrame:
    """(word, n): how often each word stands in the arrays of a column; null and empty ones do not count."""
    return rows.select(F.explode(words_col).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary(rows: DataFrame, words_col: str = "words", most: int = MOST_WORDS) -> Dictionary:
    """The dictionary of segmented rows: the most frequent words (ties: in alphabetical order). Without rows it is empty."""
    counts = word_counts(rows, words_col)
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    return Dictionary({r.word: r.n for r in kept}, total)


def shapes(rows: DataFrame, words_col: str = "words") -> Shapes | None:
    """The hidden Markov model of segmented rows, with one more of each thing that may happen; None without words.

    What is collected is bounded by the characters there are: counts of a state with a character and of a
    state after another.
    """
    inner = F.concat(F.lit(BEGIN), F.repeat(F.lit(MIDDLE), F.length("w") - 2), F.lit(END))
    states_of = F.when(F.length("w") == 1, SINGLE).otherwise(inner)
    words = rows.select(F.monotonically_increasing_id().alias("row"), F.posexplode(words_col).alias("at", "w")).where("w <> ''")
    words = words.select("row", "at", "w", states_of.alias("states"))
    shown = words.select(F.explode(F.arrays_zip(F.split("states", "").alias("s"), F.split("w", "").alias("c"))).alias("x")).where("x.s <> ''").groupBy("x.s", "x.c").count().collect()
    if not shown:
        return None
    whole = rows.select(F.array_join(F.transform(F.filter(words_col, lambda w: w != ""), lambda w: F.when(F.length(w) == 1, SINGLE).otherwise(F.concat(F.lit(BEGIN), F.repeat(F.lit(MIDDLE), F.length(w) - 2), F.lit(END)))), "").alias("s"))
    pairs = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substr("s", i, F.lit(2)))).alias("pair")).where("length(pair) = 2").groupBy("pair").count().collect()
    first = whole.where("s <> ''").groupBy(F.substring("s", 1, 1).alias("s")).count().collect()
    total = {s: 0 for s in NEXT}
    for r in shown:
        total[r.s] += r["count"]
    variety = len({r.c for r in shown})
    begun = {r.s: r["count"] for r in first}
    after = {(r.pair[0], r.pair[1]): r["count"] for r in pairs}
    log = lambda a, b: math.log(a / b)
    begin = {s: log(begun.get(s, 0) + 1, sum(begun.values()) + 2) for s in (BEGIN, SINGLE)}
    follow = {(p, s): log(after.get((p, s), 0) + 1, sum(after.get((p, x), 0) for x in NEXT[p]) + 2) for p in NEXT for s in NEXT[p]}
    return Shapes(begin, follow, {(r.s, r.c): log(r["count"] + 1, total[r.s] + variety) for r in shown}, {s: log(1, total[s] + variety) for s in NEXT})
