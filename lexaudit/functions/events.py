"""Events by trigger words, with slots from nearby entities and context."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .entities import MONEY, ORGANISATION, PERSON, PLACE, PRODUCT, TIME, find_all
from .kernels import SPAN, Span, lexicon, longest_of_chain, over_spans, span_lists
from .kernels import _sliced as sliced
from .spans import SPANS

NEAR, BEFORE, AFTER = 60, 30, 30
EVENTS = "array<struct<type:string,trigger:string,start:int,end:int,slots:map<string,string>>>"
EVENT = pa.struct([("type", pa.string()), ("trigger", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("slots", pa.map_(pa.string(), pa.string()))])
EventTypes = dict[str, tuple[tuple[str, ...], tuple[str, ...]]]


def load_types(path: str) -> EventTypes:
    """Event types from a JSON file: {type: [[trigger, ...], [slot, ...]]}."""
    with open(path, encoding="utf-8") as f:
        return {k: (tuple(v[0]), tuple(v[1])) for k, v in json.load(f).items()}


def owners(types: EventTypes = L.EVENT_TYPES) -> dict[str, str]:
    """The first type that lists a trigger owns it."""
    out: dict[str, str] = {}
    for name, (triggers, _) in types.items():
        for t in triggers:
            out.setdefault(t, name)
    return out


def _found(text: str, words: tuple[str, ...]) -> list[tuple[int, str]]:
    """Of overlapping trigger words a longer one takes the place of the one before."""
    kept: list[tuple[int, str]] = []
    for at, word in lexicon(words).occurrences(text):
        if not kept or at >= kept[-1][0] + len(kept[-1][1]):
            kept.append((at, word))
        elif len(word) > len(kept[-1][1]):
            kept[-1] = at, word
    return kept


def triggers(text: Column, types: EventTypes = L.EVENT_TYPES) -> Column:
    """Trigger words of the text, as spans whose type is the event's; of overlapping ones a longer one replaces the earlier."""
    owned = owners(types)
    words = tuple(owned)
    return over_spans(lambda t: [(w, owned[w], at, at + len(w), -len(w)) for at, w in _found(t, words)])(text)


MARKS = re.compile("[，,。！？、]")


def _reason(before: str, near: list[Span]) -> str | None:
    """The cause named in the text before a trigger: nearby entities taken out, then what follows the last
    cause word (at most 20 characters), else the first 15 characters without punctuation."""
    if not before.strip():
        return None
    cleaned = before
    for e in near:
        if e[2] < len(before):
            cleaned = cleaned.replace(e[0], "", 1)
    for word in ("因", "为", "由于", "因为"):
        if word in cleaned and len(named := cleaned.rpartition(word)[2].strip()) > 1:
            return named[:20]
    plain = MARKS.sub("", cleaned).strip()
    return plain[:15] if len(plain) > 1 else None


KINDS = {"时间": TIME, "地点": PLACE, "金额": MONEY, "产品": PRODUCT}


@lru_cache(maxsize=1024)
def _fillable(declared: tuple[str, ...]) -> tuple[str, ...]:
    """The declared slots that something can fill, in their order; one of them takes the cause."""
    cause = next((c for c in ("原因", "事由", "内容") if c in declared), None)
    return tuple(s for s in ("时间", "地点", "金额", "主体", "产品", "动作", cause, "结果") if s in declared)


def _slots(text: str, entities: list[Span], at: int, word: str, declared: tuple[str, ...]) -> list[tuple[str, str]]:
    """What can be filled of an event's declared slots, as pairs."""
    end = at + len(word)
    near = [e for e in entities if -NEAR < e[2] - at < NEAR or -NEAR < e[3] - end < NEAR]
    first = {e[1]: e[0] for e in reversed(near)}
    out = []
    for slot in _fillable(declared):
        if slot in KINDS:
            value = first.get(KINDS[slot])
        elif slot == "动作":
            value = word
        elif slot == "主体":
            value = first.get(ORGANISATION, first.get(PERSON))
        elif slot == "结果":
            value = text[end : end + AFTER].strip() or None
        else:
            value = _reason(text[max(0, at - BEFORE) : at], near)
        if value is not None:
            out.append((slot, value))
    return out


Event = tuple[str, str, int, int, list[tuple[str, str]]]


def _array(found: list[list[Event]]) -> pa.Array:
    """Each row's events, put together by columns: no value becomes a nested object for Arrow to take apart."""
    flat = list(chain.from_iterable(found))
    pairs = list(chain.from_iterable(e[4] for e in flat))
    ends = lambda lists: pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())
    text = lambda values: pa.array(values, pa.string())
    slots = pa.MapArray.from_arrays(ends([e[4] for e in flat]), text([k for k, _ in pairs]), text([v for _, v in pairs]))
    columns = [text([e[0] for e in flat]), text([e[1] for e in flat]), pa.array([e[2] for e in flat], pa.int32()), pa.array([e[3] for e in flat], pa.int32()), slots]
    return pa.ListArray.from_arrays(ends(found), pa.StructArray.from_arrays(columns, fields=list(EVENT)))


def _teller(types: EventTypes) -> tuple[tuple[str, ...], Callable[[str, list[tuple[int, str]], list[Span]], list[Event]]]:
    """The trigger words, and a function of a text, its triggers and its entities to its events."""
    owned = owners(types)
    known = {w: (name, tuple(types[name][1])) for w, name in owned.items()}

    def told(text: str, hits: list[tuple[int, str]], entities: list[Span]) -> list[Event]:
        return [(known[w][0], w, at, at + len(w), _slots(text, entities, at, w, known[w][1])) for at, w in hits]

    return tuple(owned), told


def extract(text: Column, entities: Column, types: EventTypes = L.EVENT_TYPES) -> Column:
    """Array of (type, trigger, start, end, slots): slots is a map of those that could be filled. A null text has none."""
    words, told = _teller(types)

    @F.arrow_udf(EVENTS)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        def work(some: pa.Array, more: pa.Array) -> pa.Array:
            spans = ([tuple(e[c] for c in SPAN.names) for e in x or ()] for x in more.to_pylist())
            return _array([told(t or "", _found(t or "", words), s) for t, s in zip(some.to_pylist(), spans, strict=True)])

        return sliced(work, texts, lists)

    return run(text, entities)


def of_text(text: Column, people: Iterable[str] = (), places: Iterable[str] = (), organisations: Iterable[str] = (), types: EventTypes = L.EVENT_TYPES) -> Column:
    """extract() with the entities that entities.recognise() finds by these lists, in one pass over the text."""
    (words, told), lists = _teller(types), (tuple(people), tuple(places), tuple(organisations))

    def one(t: str) -> list[Event]:
        hits = _found(t, words)
        return told(t, hits, longest_of_chain(find_all(t, *lists))) if hits else []

    @F.arrow_udf(EVENTS)
    def run(texts: pa.Array) -> pa.Array:
        return sliced(lambda some: _array([one(t or "") for t in some.to_pylist()]), texts)

    return run(text)


def with_entities(text: Column, people: Iterable[str] = (), places: Iterable[str] = (), organisations: Iterable[str] = (), types: EventTypes = L.EVENT_TYPES) -> Column:
    """Struct (entities, events): what entities.recognise() and of_text() tell, found once."""
    (words, told), lists = _teller(types), (tuple(people), tuple(places), tuple(organisations))

    def work(some: pa.Array) -> pa.Array:
        texts = [t or "" for t in some.to_pylist()]
        found = [longest_of_chain(find_all(t, *lists)) for t in texts]
        return pa.StructArray.from_arrays([span_lists(found), _array([told(t, _found(t, words), e) for t, e in zip(texts, found, strict=True)])], ["entities", "events"])

    @F.arrow_udf(f"struct<entities:{SPANS},events:{EVENTS}>")
    def run(texts: pa.Array) -> pa.Array:
        return sliced(work, texts)

    return run(text)


def summary(events: Column) -> Column:
    """A map for each event: its type and its slots."""
    return F.transform(events, lambda e: F.map_concat(F.create_map(F.lit("事件类型"), e["type"]), e["slots"]))


def show(events: Column) -> Column:
    """The events as numbered lines, each with its filled slots under it."""
    line = lambda e, i: F.concat(F.lit("  事件"), (i + 1).cast("string"), F.lit(": 【"), e["type"], F.lit("】 (触发词: "), e["trigger"], F.lit(")"))
    slots = lambda e: F.transform(F.filter(F.map_entries(e["slots"]), lambda s: s["value"] != ""), lambda s: F.concat(F.lit("    "), s["key"], F.lit(": "), s["value"]))
    lines = F.flatten(F.transform(events, lambda e, i: F.concat(F.array(line(e, i)), slots(e))))
    return F.when(F.size(events) == 0, "  (未识别到事件)").otherwise(F.array_join(lines, "\n"))
