"""Matches of patterns with their offsets in code points, and rules for overlapping ones, as column expressions.

A span is a struct (text, type, start, end, rank); end is exclusive. rank breaks ties between patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

SPANS = "array<struct<text:string,type:string,start:int,end:int,rank:int>>"


def find_spans(text: Column, pattern: str, kind: str, rank: int = 0, group_ends_match: bool = False) -> Column:
    """All matches of a pattern that never matches the empty string.

    The offsets add up the lengths of the matches and of the pieces between them. group_ends_match:
    the span is the first group, which ends the match.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    said = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(2)) if group_ends_match else F.array().cast("array<string>")
    nothing = F.array().cast(SPANS)

    def add_up(m: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            end = acc["at"] + F.length(F.get(m["gaps"], i)) + F.length(F.get(m["whole"], i))
            found = F.get(m["said"], i) if group_ends_match else F.get(m["whole"], i)
            span = F.struct(found.alias("text"), F.lit(kind).alias("type"), (end - F.length(found)).alias("start"), end.alias("end"), F.lit(rank).alias("rank"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(m["whole"]) - 1), start, step, lambda acc: acc["spans"])
        return F.when(F.size(m["whole"]) > 0, found).otherwise(nothing)

    matched = let(F.struct(whole.alias("whole"), said.alias("said"), F.split(text, pattern, -1).alias("gaps")), add_up)
    return F.when(text.rlike(pattern), matched).otherwise(nothing)


def _sorted(spans: Column, *keys: str) -> Column:
    """By the given keys: start, length (longest first), rank."""
    by = {"start": lambda s: s["start"], "length": lambda s: s["start"] - s["end"], "rank": lambda s: s["rank"]}
    keyed = F.transform(spans, lambda s: F.struct(*(by[k](s).alias(f"k{i}") for i, k in enumerate(keys)), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def first_wins(spans: Column) -> Column:
    """By start, then the longest, then the rank: a span that begins before the last kept one's end goes."""

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["end"]
        return F.struct(F.when(fits, s["end"]).otherwise(acc["end"]).alias("end"), F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(SPANS).alias("kept"))
    return F.aggregate(_sorted(spans, "start", "length", "rank"), start, step, lambda acc: acc["kept"])


def splice(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of the spans, which are in order and apart, replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
