"""Times, sums of money, products and listed names in text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .kernels import SPAN, Span, longest_of_chain, matches, over_spans, over_text_and, over_texts, python_pattern
from .spans import SPANS

TIME, MONEY, PERSON, PLACE, ORGANISATION, PRODUCT = "时间", "金额", "人名", "地名", "机构名", "产品名"


@lru_cache(maxsize=64)
def _pattern(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, sorted(set(words), key=lambda w: (-len(w), w))))


def _times(text: str) -> list[Span]:
    found = [(t.strip(), *rest) for t, *rest in matches(text, python_pattern(L.TIME_PATTERN), TIME, 1)]
    return found + matches(text, python_pattern(_pattern(tuple(L.WEEKDAYS))), TIME, 2) + matches(text, python_pattern(_pattern(tuple(L.RELATIVE_TIMES))), TIME, 3)


def _money(text: str) -> list[Span]:
    return matches(text, python_pattern(L.MONEY_PATTERN), MONEY, 4) + matches(text, python_pattern(L.PERCENT_PATTERN), MONEY, 5)


def _products(text: str, suffixes: tuple[str, ...] = L.PRODUCT_SUFFIXES) -> list[Span]:
    ends, whole = _product_patterns(suffixes)
    out: list[Span] = []
    at = 0
    for m in ends.finditer(text):  # a product begins one to three characters before a suffix
        for i in range(max(at, m.start() - 3), m.start()):
            if i >= at and (found := whole.match(text, i)):
                out.append((found[0], PRODUCT, i, found.end(), 9))
                at = found.end()
    return out


@lru_cache(maxsize=8)
def _product_patterns(suffixes: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """How suffixes begin, wherever they do, and whole products."""
    return re.compile(f"(?=(?:{_pattern(suffixes)}))"), python_pattern(rf"[\x{{4e00}}-\x{{9fff}}]{{1,3}}(?:{_pattern(suffixes)})")


def _names(text: str, words: tuple[str, ...], kind: str, rank: int) -> list[Span]:
    places = ((text.find(w), w) for w in words)
    return [(w, kind, at, at + len(w), rank) for at, w in places if at >= 0]


def find_all(text: str, people: tuple, places: tuple, organisations: tuple) -> list[Span]:
    named = _names(text, people, PERSON, 6) + _names(text, places, PLACE, 7) + _names(text, organisations, ORGANISATION, 8)
    return _times(text) + _money(text) + named + _products(text)


def _spans(find: Callable[[str], list[Span]], text: Column) -> Column:
    return over_spans(find)(text)


def times(text: Column) -> Column:
    return _spans(_times, text)


def money(text: Column) -> Column:
    return _spans(_money, text)


def products(text: Column, suffixes: Iterable[str] = L.PRODUCT_SUFFIXES) -> Column:
    listed = tuple(suffixes)
    return _spans(lambda t: _products(t, listed), text)


def names(text: Column, words: Iterable[str], kind: str, rank: int) -> Column:
    """Words of a list, each at its first place in the text: the stand-in for a tagger of names."""
    listed = tuple(words)
    return _spans(lambda t: _names(t, listed, kind, rank), text)


def recognise(text: Column, people: Iterable[str] = (), places: Iterable[str] = (), organisations: Iterable[str] = (), extra: Column | None = None, more: Callable[[list[str]], list[list[Span]]] | None = None) -> Column:
    """All entities in order of their start; overlapping ones are absorbed by the longest of their chain,
    and a text of a type counts once. extra: spans from another recogniser; more: one of texts, which runs in
    the same pass. A null text has none."""
    lists = tuple(people), tuple(places), tuple(organisations)
    if more is not None:
        if extra is not None:
            raise ValueError("either extra or more")
        return over_texts(lambda texts: [longest_of_chain(found + find_all(t, *lists)) for t, found in zip(texts, more(texts), strict=True)])(text)
    if extra is None:
        return over_spans(lambda t: longest_of_chain(find_all(t, *lists)))(text)
    told = lambda t, more: [dict(zip(SPAN.names, s, strict=True)) for s in longest_of_chain([tuple(s[c] for c in SPAN.names) for s in more] + find_all(t, *lists))]
    return over_text_and(told, SPANS, pa.list_(SPAN))(text, extra)


def show(entities: Column, text: Column) -> Column:
    """One line for each entity, with five characters of context on either side."""
    line = lambda e: F.concat(
        F.lit("  ["), e["type"], F.lit("] "), e["text"], F.lit("  ..."),
        F.substring(text, F.greatest(e["start"] - 5, F.lit(0)) + 1, F.least(e["start"], F.lit(5))), F.lit("【"), e["text"], F.lit("】"), F.substring(text, e["end"] + 1, F.lit(5)), F.lit("..."),
    )
    return F.when(F.size(entities) == 0, "(无实体)").otherwise(F.array_join(F.transform(entities, line), "\n"))
