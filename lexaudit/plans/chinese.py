"""Queries about Chinese text, over the phrases made from the tables' keys, and their SQL.

The SQL works the answers out from the texts: patterns and word lists are the operators' fixed values,
everything else is its own.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, entities, events, pii, sentiment, tokens, transcripts
from ..functions import lexicons as L
from ..functions.binding import opened
from ..operators import classify
from . import analysis, phrases
from .phrases import listed, quoted
from .registry import query, spread, table


def texts(spark, sf_dir, parts: tuple, source: str = "orders", key: str = "o_orderkey") -> DataFrame:
    return spread(table(spark, sf_dir, source).select(key)).select(key, phrases.column(F.col(key).cast("string"), parts).alias("text"))


def texts_sql(parts: tuple, source: str = "orders", key: str = "o_orderkey") -> str:
    return f"SELECT {key}, {phrases.sql(f'CAST({key} AS VARCHAR)', parts)} AS text FROM {source}"


WHITE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f"


def pattern(java: str) -> str:
    """A fixed pattern as DuckDB's regular expressions have it, quoted."""
    return quoted(java.replace(L.BLANK, WHITE))


def words_pattern(words) -> str:
    return "|".join(map(re.escape, sorted(set(words), key=lambda w: (-len(w), w))))


def spans_sql(source: str, key: str, text: str, match: str, kind: str, rank: int) -> str:
    """(key, text, type, start, stop, rank) of all matches, by the lengths of the matches and of what is between them."""
    m = lambda i: f"coalesce(list_sum(list_transform(m[1:{i}], lambda x: len(x))), 0)"
    g = "list_sum(list_transform(g[1:i], lambda x: len(x)))"
    return f"""SELECT {key}, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'text': m[i], 'type': '{kind}', 'start': CAST({g} + {m('i - 1')} AS BIGINT), 'stop': CAST({g} + {m('i')} AS BIGINT), 'rank': {rank}}})) AS s
    FROM (SELECT {key}, regexp_extract_all({text}, {match}) AS m, regexp_split_to_array({text}, {match}) AS g FROM ({source})) WHERE len(m) > 0"""


# ---------------------------------------------------------------- cleaning

POSTS = texts_sql(phrases.POST)


def posts(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, phrases.POST)


def _step_sql(name: str, t: str) -> str:
    swap = lambda p, to="": f"regexp_replace({t}, {pattern(p)}, '{to}', 'g')"
    if name == "unescape":
        for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            t = f"replace({t}, {quoted(entity)}, {quoted(plain)})"
        return t
    if name == "boilerplate":
        for p in L.BOILERPLATE_PATTERNS:
            t = f"regexp_replace({t}, {pattern(p)}, '', 'g')"
        return t
    if name == "symbols":
        return f"regexp_replace({swap(L.REPEATED_PATTERN, chr(92) + '1')}, {pattern(L.NOISE_PATTERN)}, '', 'g')"
    if name == "blanks":
        return f"trim({swap(f'[{L.BLANK}]+', ' ')})"
    return {"tags": swap(L.TAG_PATTERN), "urls": swap(L.URL_PATTERN), "mentions": swap(L.MENTION_PATTERN), "hashtags": swap(L.HASHTAG_PATTERN, chr(92) + "1"), "emoji": swap(L.EMOJI_PATTERN)}[name]


STEP_NAMES = [name for name, _ in cleaning.STEPS]


def _steps_sql() -> str:
    """(o_orderkey, text, after_<step> for each step)."""
    before, sql = "text", f"({POSTS})"
    for name in STEP_NAMES:
        sql = f"(SELECT *, {_step_sql(name, before)} AS after_{name} FROM {sql})"
        before = f"after_{name}"
    return sql


STEPS = _steps_sql()
IS_AD = f"list_sum(list_transform({listed(L.AD_KEYWORDS)}, lambda k: CAST(contains(lower(after_blanks), k) AS INT))) >= 2"
SIMPLE = f"translate(after_blanks, '{L.TRADITIONAL}', '{L.SIMPLIFIED}')"


@query(f"SELECT o_orderkey, after_blanks AS cleaned FROM {STEPS}")
def clean_text(spark, sf_dir):
    return posts(spark, sf_dir).select("o_orderkey", cleaning.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT o_orderkey, {', '.join(f'after_{n}' for n in STEP_NAMES)}, {IS_AD} AS is_ad FROM {STEPS}")
def clean_steps(spark, sf_dir):
    """One column for each step's result, and whether the text is an advertisement: it is told, not dropped."""
    rows = posts(spark, sf_dir)
    for name, step in cleaning.STEPS:
        rows = rows.withColumn("text", step(F.col("text"))).withColumn(f"after_{name}", F.col("text"))
    return rows.withColumn("text", F.lower("text")).withColumn("is_ad", cleaning.holds(F.col("text"))).drop("text")


#: Entities of every form: named with and without a semicolon, names that go on, numbers, and what is none.
ENTITIES = ("&eacute;", "&copy", "&notit;", "&notin;", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&#233;", "&#x4E2D;", "&#X1f600", "&#0;", "&#128;", "&#xD800;", "&#99999999999;", "&#1114111;", "&#11;", "&amp;lt;", "&nosuch;", "&", "&#;", "&#x;", "&ampamp;", "&Aacute&aacute;", "")
MARKUP = (phrases.Pick("e1", ENTITIES), " ", phrases.Key(), phrases.Pick("e2", ENTITIES), "中", phrases.Pick("e3", ENTITIES))
PLAIN = (phrases.Pick("e1", tuple(map(html.unescape, ENTITIES))), " ", phrases.Key(), phrases.Pick("e2", tuple(map(html.unescape, ENTITIES))), "中", phrases.Pick("e3", tuple(map(html.unescape, ENTITIES))))


@query(f"SELECT o_orderkey, to_base64(encode(text)) AS plain FROM ({texts_sql(PLAIN)})")
def decode_entities(spark, sf_dir):
    """Entities of all forms; the result's bytes, as some are no printable characters."""
    return texts(spark, sf_dir, MARKUP).select("o_orderkey", F.base64(F.encode(cleaning.unescape_exact(F.col("text")), "UTF-8")).alias("plain"))


#: Words that the table of characters alone would write wrongly, and their simplified form.
PHRASES = {"乾坤": "乾坤", "乾隆": "乾隆", "頭髮": "头发", "發展": "发展", "皇后": "皇后", "以後": "以后", "瞭望": "瞭望", "瞭解": "了解", "藉口": "借口", "狼藉": "狼藉"}
MIXED = "乾後發髮頭瞭藉", "干后发发头了借"
WRITTEN = (phrases.Pick("q1", tuple(PHRASES)), phrases.Pick("q2", ("，", "、")), phrases.Key(), phrases.Pick("q3", ("乾糧", "頭", "發", "")), phrases.Pick("q4", tuple(PHRASES)))
SIMPLER = (phrases.Pick("q1", tuple(PHRASES.values())), phrases.Pick("q2", ("，", "、")), phrases.Key(), phrases.Pick("q3", ("干糧", "头", "发", "")), phrases.Pick("q4", tuple(PHRASES.values())))


@query(f"SELECT o_orderkey, s.text AS by_phrase, translate(t.text, '{MIXED[0]}', '{MIXED[1]}') AS by_character FROM ({texts_sql(SIMPLER)}) s JOIN ({texts_sql(WRITTEN)}) t USING (o_orderkey)")
def simplify_phrases(spark, sf_dir):
    """Phrase by phrase, and character by character: they differ."""
    return texts(spark, sf_dir, WRITTEN).select("o_orderkey", cleaning.simplify_phrases(F.col("text"), PHRASES, *MIXED).alias("by_phrase"), cleaning.simplify(F.col("text"), *MIXED).alias("by_character"))


@query(f"SELECT o_orderkey, CASE WHEN {IS_AD} THEN '' ELSE {SIMPLE} END AS kept FROM {STEPS}")
def ad_filter(spark, sf_dir):
    return posts(spark, sf_dir).select("o_orderkey", cleaning.clean_post(F.col("text")).alias("kept"))


@query(f"SELECT o_orderkey, translate(text, '{L.TRADITIONAL}', '{L.SIMPLIFIED}') AS simplified FROM ({POSTS})")
def simplified(spark, sf_dir):
    return posts(spark, sf_dir).select("o_orderkey", cleaning.simplify(F.col("text")).alias("simplified"))


LEXICON = quoted(f"{words_pattern(tokens.sentiment_words())}|[A-Za-z0-9]+|[^\\s]")
KEPT = f"list_filter(cut, lambda t: NOT regexp_full_match(t, {pattern(L.DROPPED_TOKEN_PATTERN.strip('^$'))}) AND (len(t) >= 2 OR regexp_full_match(t, '[\\x{{4e00}}-\\x{{9fff}}]')) AND NOT list_contains({listed(L.STOPWORDS)}, t))"
TOKENISED = f"(SELECT *, list_filter(content, lambda t, i: i = 1 OR t <> content[i - 1]) AS final FROM (SELECT *, {KEPT} AS content FROM (SELECT *, regexp_extract_all(simple, {LEXICON}) AS cut FROM (SELECT *, {SIMPLE} AS simple FROM {STEPS}))))"


@query(f"SELECT o_orderkey, unnest(final) AS token, unnest(range(len(final))) AS pos FROM {TOKENISED}")
def chinese_tokens(spark, sf_dir):
    """Cut, filtered and deduplicated tokens of the cleaned posts."""
    rows = posts(spark, sf_dir).select("o_orderkey", tokens.lexicon_tokens(cleaning.simplify(cleaning.clean(F.col("text"))), tokens.sentiment_words()).alias("cut"))
    kept = rows.select("o_orderkey", tokens.keep_content(F.col("cut")).alias("content")).select("o_orderkey", tokens.drop_repeats(F.col("content")).alias("final"))
    long = kept.select("o_orderkey", F.posexplode_outer("final").alias("pos", "token")).where("token is not null")
    return long.select("o_orderkey", "token", F.col("pos").cast("long").alias("pos"))


_TRACED = ["text", *(f"after_{n}" for n in STEP_NAMES), f"CASE WHEN {IS_AD} THEN 'yes' ELSE 'no' END", "simple", "array_to_string(cut, ' | ')", "array_to_string(content, ' | ')", "array_to_string(final, ' | ')", "array_to_string(final, ' ')"]
_TRACE_NAMES = ["original", *STEP_NAMES, "advertisement", "simplified", "tokens", "content", "distinct", "final"]


@query(f"SELECT o_orderkey, unnest(range({len(_TRACED)})) AS step, unnest({listed(_TRACE_NAMES)}) AS name, unnest([{', '.join(_TRACED)}]) AS value FROM {TOKENISED}")
def trace_steps(spark, sf_dir):
    found = opened(analysis.trace(posts(spark, sf_dir)), F.col("trace"), "t", "o_orderkey")
    return found.select("o_orderkey", F.col("t.step").cast("long").alias("step"), "t.name", "t.value")


REVIEWS = texts_sql(phrases.REVIEW, "orders")
CLAUSES = "list_filter(list_transform(regexp_split_to_array(text, '[。！？?；;，,\\n]+'), lambda c: trim(c)), lambda c: c <> '')"


@query(f"SELECT o_orderkey, list_filter(list_transform(regexp_split_to_array(text, '[。！？\\n；;]+'), lambda s: trim(s)), lambda s: len(s) >= 4 AND regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]')) AS sentences, {CLAUSES} AS clauses FROM ({REVIEWS})")
def sentence_split(spark, sf_dir):
    return texts(spark, sf_dir, phrases.REVIEW).select("o_orderkey", tokens.split_sentences(F.col("text")).alias("sentences"), tokens.split_clauses(F.col("text")).alias("clauses"))


# ---------------------------------------------------------------- entities

NEWS = texts_sql(phrases.NEWS)


def news(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, phrases.NEWS)


def _of_pattern(java: str, kind: str, rank: int) -> str:
    return spans_sql(NEWS, "o_orderkey", "text", quoted(java), kind, rank)


def _all_of(*parts: str) -> str:
    return " UNION ALL ".join(parts)


SPAN_TYPE = 'STRUCT(text VARCHAR, type VARCHAR, start BIGINT, stop BIGINT, "rank" INT)'
TIME_SQL = f"SELECT o_orderkey, {{'text': trim(s.text), 'type': s.type, 'start': s.start, 'stop': s.stop, 'rank': s.rank}} AS s FROM ({_of_pattern(L.TIME_PATTERN, entities.TIME, 1)})"
TIMES = _all_of(TIME_SQL, _of_pattern(words_pattern(L.WEEKDAYS), entities.TIME, 2), _of_pattern(words_pattern(L.RELATIVE_TIMES), entities.TIME, 3))
MONEY = _all_of(_of_pattern(L.MONEY_PATTERN, entities.MONEY, 4), _of_pattern(L.PERCENT_PATTERN, entities.MONEY, 5))
PRODUCTS = _of_pattern(rf"[\x{{4e00}}-\x{{9fff}}]{{1,3}}(?:{words_pattern(L.PRODUCT_SUFFIXES)})", entities.PRODUCT, 9)


def _of_list(words, kind: str, rank: int) -> str:
    return f"SELECT o_orderkey, {{'text': w, 'type': '{kind}', 'start': CAST(instr(text, w) - 1 AS BIGINT), 'stop': CAST(instr(text, w) - 1 + len(w) AS BIGINT), 'rank': {rank}}} AS s FROM ({NEWS}), (SELECT unnest({listed(words)}) AS w) WHERE contains(text, w)"


def _told(spans: str) -> str:
    return f"SELECT o_orderkey, s.text AS entity, s.start AS start FROM ({spans})"


def _listed(spans, f) -> DataFrame:
    found = opened(spans, f(F.col("text")), "e", "o_orderkey")
    return found.select("o_orderkey", F.col("e.text").alias("entity"), F.col("e.start").cast("long").alias("start"))


@query(_told(TIMES))
def ner_time(spark, sf_dir):
    return _listed(news(spark, sf_dir), entities.times)


@query(_told(MONEY))
def ner_money(spark, sf_dir):
    return _listed(news(spark, sf_dir), entities.money)


@query(_told(PRODUCTS))
def ner_product(spark, sf_dir):
    return _listed(news(spark, sf_dir), entities.products)


def recognised(spark, sf_dir) -> DataFrame:
    return news(spark, sf_dir).withColumn("entities", entities.recognise(F.col("text"), phrases.PEOPLE, phrases.PLACES, phrases.ORGANISATIONS))


def reported(text):
    return events.of_text(text, phrases.PEOPLE, phrases.PLACES, phrases.ORGANISATIONS)


# overlapping spans: the longest of a chain; then one of each text and type
ENTITIES = f"""n AS MATERIALIZED ({NEWS}), every AS ({_all_of(TIMES, MONEY, _of_list(phrases.PEOPLE, entities.PERSON, 6), _of_list(phrases.PLACES, entities.PLACE, 7), _of_list(phrases.ORGANISATIONS, entities.ORGANISATION, 8), PRODUCTS)}),
sorted AS (SELECT o_orderkey, list(CAST(s AS {SPAN_TYPE}) ORDER BY s.start, s.start - s.stop, s.rank) AS l FROM every GROUP BY o_orderkey),
chained AS (SELECT o_orderkey, list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR x.start >= acc[len(acc)].stop THEN list_append(acc, x) WHEN x.stop - x.start > acc[len(acc)].stop - acc[len(acc)].start THEN list_append(list_slice(acc, 1, len(acc) - 1), x) ELSE acc END, CAST([] AS {SPAN_TYPE}[])) AS l FROM sorted),
ent AS MATERIALIZED (SELECT o_orderkey, text, coalesce(list_filter(l, lambda s, i: NOT list_contains(list_transform(l[1:i - 1], lambda o: o.type || ':' || o.text), s.type || ':' || s.text)), CAST([] AS {SPAN_TYPE}[])) AS entities FROM n LEFT JOIN chained USING (o_orderkey))"""


@query(f"WITH {ENTITIES} SELECT e.type AS type, count(*) AS n FROM (SELECT unnest(entities) AS e FROM ent) GROUP BY 1")
def entity_type_counts(spark, sf_dir):
    return opened(recognised(spark, sf_dir), F.col("entities"), "e").groupBy("e.type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENTITIES} SELECT o_orderkey, CASE WHEN len(entities) = 0 THEN '(无实体)' ELSE array_to_string(list_transform(entities, lambda e:
'  [' || e.type || '] ' || e.text || '  ...' || substr(text, greatest(e.start - 5, 0) + 1, least(e.start, 5)) || '【' || e.text || '】' || substr(text, e.stop + 1, 5) || '...'), chr(10)) END AS lines FROM ent""")
def entity_lines(spark, sf_dir):
    return recognised(spark, sf_dir).select("o_orderkey", entities.show(F.col("entities"), F.col("text")).alias("lines"))


# ---------------------------------------------------------------- events

_DEFINED = [(i, kind, t) for i, (kind, (words, _)) in enumerate(L.EVENT_TYPES.items()) for t in words]
_SLOTS = [(kind, s) for kind, (_, slots) in L.EVENT_TYPES.items() for s in slots]
TRIGGER_TYPE = "STRUCT(start BIGINT, word VARCHAR, type VARCHAR)"
TRIGGERED = f"""owner AS MATERIALIZED (SELECT word, arg_min(type, place) AS type FROM (VALUES {', '.join(f"({i}, '{k}', '{t}')" for i, k, t in _DEFINED)}) d(place, type, word) GROUP BY word),
hits AS (SELECT o_orderkey, word, type, string_split(text, word) AS g FROM n JOIN owner ON contains(text, word)),
found AS (SELECT o_orderkey, word, type, unnest(list_transform(range(1, len(g)), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + (i - 1) * len(word) AS BIGINT))) AS start FROM hits),
trig AS MATERIALIZED (SELECT o_orderkey, list_reduce(list(CAST({{'start': start, 'word': word, 'type': type}} AS {TRIGGER_TYPE}) ORDER BY start, len(word) DESC),
    lambda acc, x: CASE WHEN len(acc) = 0 OR x.start >= acc[len(acc)].start + len(acc[len(acc)].word) THEN list_append(acc, x) WHEN len(x.word) > len(acc[len(acc)].word) THEN list_append(list_slice(acc, 1, len(acc) - 1), x) ELSE acc END, CAST([] AS {TRIGGER_TYPE}[])) AS l FROM found GROUP BY o_orderkey)"""


@query(f"WITH n AS MATERIALIZED ({NEWS}), {TRIGGERED} SELECT o_orderkey, t.word AS trigger, t.type AS type, t.start AS start FROM (SELECT o_orderkey, unnest(l) AS t FROM trig)")
def event_triggers(spark, sf_dir):
    found = opened(news(spark, sf_dir), events.triggers(F.col("text")), "t", "o_orderkey")
    return found.select("o_orderkey", F.col("t.text").alias("trigger"), F.col("t.type").alias("type"), F.col("t.start").cast("long").alias("start"))


def _cause_sql() -> str:
    after = lambda w: f"trim(string_split(cleaned, '{w}')[len(string_split(cleaned, '{w}'))])"
    named = ", ".join(f"CASE WHEN contains(cleaned, '{w}') AND len({after(w)}) > 1 THEN left({after(w)}, 20) END" for w in ("因", "为", "由于", "因为"))
    plain = "trim(regexp_replace(cleaned, '[，,。！？、]+', '', 'g'))"
    return f"CASE WHEN trim(before) <> '' THEN coalesce({named}, CASE WHEN len({plain}) >= 2 THEN left({plain}, 15) END) END"


EVENTS = f"""slot AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{s}')" for k, s in _SLOTS)}) v(type, slot)), declared AS (SELECT type, list(slot) AS slots FROM slot GROUP BY type),
one AS (SELECT o_orderkey, text, entities, unnest(l) AS t FROM trig JOIN ent USING (o_orderkey)),
near AS (SELECT o_orderkey, t, t.type AS type, slots, list_filter(entities, lambda e: abs(e.start - t.start) < 60 OR abs(e.stop - t.start - len(t.word)) < 60) AS near,
    substr(text, greatest(t.start - 30, 0) + 1, least(t.start, 30)) AS before, trim(substr(text, t.start + len(t.word) + 1, 30)) AS after FROM one JOIN declared ON declared.type = t.type),
cleaned AS (SELECT *, list_reduce(list_filter(near, lambda e: e.start < len(before)), lambda acc, e: CASE WHEN contains(acc, e.text) THEN left(acc, instr(acc, e.text) - 1) || substr(acc, instr(acc, e.text) + len(e.text)) ELSE acc END, before) AS cleaned FROM near),
caused AS (SELECT *, {_cause_sql()} AS cause, CASE WHEN list_contains(slots, '原因') THEN '原因' WHEN list_contains(slots, '事由') THEN '事由' WHEN list_contains(slots, '内容') THEN '内容' END AS cause_slot FROM cleaned),
filled AS (SELECT o_orderkey, t, type, slot.place, slot.name AS slot, CASE slot.name WHEN '时间' THEN {{first:时间}} WHEN '地点' THEN {{first:地名}} WHEN '金额' THEN {{first:金额}} WHEN '主体' THEN coalesce({{first:机构名}}, {{first:人名}}) WHEN '产品' THEN {{first:产品名}} WHEN '动作' THEN t.word
    WHEN '结果' THEN nullif(after, '') ELSE CASE WHEN slot.name = cause_slot THEN cause END END AS value
    FROM caused, (SELECT unnest(['时间', '地点', '金额', '主体', '产品', '动作', '原因', '事由', '内容', '结果']) AS name, unnest(range(10)) AS place) slot WHERE list_contains(slots, slot.name))"""
EVENTS = re.sub(r"\{first:(\w+)\}", lambda m: f"list_filter(near, lambda e: e.type = '{m[1]}')[1].text", EVENTS)


@query(f"WITH {ENTITIES}, {TRIGGERED}, {EVENTS} SELECT o_orderkey, t.start AS start, type, t.word AS trigger, slot, value FROM filled WHERE value IS NOT NULL")
def event_slots(spark, sf_dir):
    rows = opened(news(spark, sf_dir), reported(F.col("text")), "e", "o_orderkey")
    return rows.select("o_orderkey", F.col("e.start").cast("long").alias("start"), "e.type", "e.trigger", F.explode_outer("e.slots").alias("slot", "value")).where("slot is not null")


@query(f"WITH n AS MATERIALIZED ({NEWS}), {TRIGGERED} SELECT t.type AS type, count(*) AS n FROM (SELECT unnest(l) AS t FROM trig) GROUP BY 1")
def event_type_counts(spark, sf_dir):
    return opened(news(spark, sf_dir), events.triggers(F.col("text")), "t").groupBy("t.type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENTITIES}, {TRIGGERED}, {EVENTS}, e AS (SELECT o_orderkey, t.start AS start, '{{"事件类型":"' || type || '"' || coalesce(string_agg(',"' || slot || '":"' || replace(value, '"', '\\"') || '"', '' ORDER BY place) FILTER (value IS NOT NULL), '') || '}}' AS j FROM filled GROUP BY o_orderkey, t.start, type)
SELECT o_orderkey, '[' || coalesce(j, '') || ']' AS summary FROM n LEFT JOIN (SELECT o_orderkey, string_agg(j, ',' ORDER BY start) AS j FROM e GROUP BY o_orderkey) USING (o_orderkey)""")
def event_summaries(spark, sf_dir):
    return news(spark, sf_dir).select("o_orderkey", F.to_json(events.summary(reported(F.col("text")))).alias("summary"))


@query(f"""WITH {ENTITIES}, {TRIGGERED}, {EVENTS}, e AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY t.start) AS i, t.start AS start, '【' || type || '】 (触发词: ' || t.word || ')' || coalesce(string_agg(chr(10) || '    ' || slot || ': ' || value, '' ORDER BY place) FILTER (value <> ''), '') AS said FROM filled GROUP BY o_orderkey, t, type)
SELECT o_orderkey, coalesce(said, '  (未识别到事件)') AS lines FROM n LEFT JOIN (SELECT o_orderkey, string_agg('  事件' || i || ': ' || said, chr(10) ORDER BY i) AS said FROM e GROUP BY o_orderkey) USING (o_orderkey)""")
def event_lines(spark, sf_dir):
    return news(spark, sf_dir).select("o_orderkey", events.show(reported(F.col("text"))).alias("lines"))


# ---------------------------------------------------------------- sentiment

REVIEW_LINES = f"SELECT l_orderkey, l_linenumber, {phrases.sql('CAST(l_orderkey AS VARCHAR) || chr(45) || CAST(l_linenumber AS VARCHAR)', phrases.REVIEW)} AS text FROM lineitem"


def reviews(spark, sf_dir) -> DataFrame:
    """A review for each line item."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", phrases.column(key, phrases.REVIEW).alias("text"))


def _light_sql(text: str) -> str:
    for p, to in ((r"https?://\S+", ""), (L.TAG_PATTERN, ""), (L.MENTION_PATTERN, ""), (L.HASHTAG_PATTERN, chr(92) + "1"), (L.EMOJI_PATTERN, "")):
        text = f"regexp_replace({text}, {pattern(p)}, '{to}', 'g')"
    return text


def _cut_sql(text: str) -> str:
    return f"regexp_extract_all({_light_sql(text)}, {LEXICON})"


def _map_sql(pairs: dict[str, float]) -> str:
    return f"MAP {{{', '.join(f'{quoted(k)}: CAST({v} AS DOUBLE)' for k, v in pairs.items())}}}"


def _weights_sql(words: str) -> str:
    """Each word's weight: its sign, times the degree and the turn of the word before."""
    sign = f"CASE WHEN list_contains({listed(L.POSITIVE)}, {words}[i]) THEN 1.0 WHEN list_contains({listed(L.NEGATIVE)}, {words}[i]) THEN -1.0 ELSE 0.0 END"
    degree = f"CASE WHEN i > 1 THEN coalesce({_map_sql(L.DEGREE)}[{words}[i - 1]], 1.0) ELSE 1.0 END"
    turn = f"CASE WHEN i > 1 AND list_contains({listed(L.NEGATION)}, {words}[i - 1]) THEN -1.0 ELSE 1.0 END"
    return f"list_transform(range(1, len({words}) + 1), lambda i: CAST({sign} AS DOUBLE) * {degree} * {turn})"


def _score_sql(weights: str) -> str:
    return f"CASE WHEN len({weights}) > 0 THEN greatest(-1.0, least(1.0, greatest(-5.0, least(5.0, list_sum({weights}))) / sqrt(len({weights})))) ELSE 0.0 END"


FACE_SCORE = f"greatest(-1.0, least(1.0, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: coalesce({_map_sql(L.EMOJI_WEIGHT)}[c], 0.0))), 0.0) / greatest(1, len(text)) * 5))"
LABEL = lambda x: f"CASE WHEN {x} > 0.1 THEN '正面' WHEN {x} < -0.1 THEN '负面' ELSE '中性' END"


def _judged_sql(source: str, key: str) -> str:
    """(key, text, score, pos, neg, scores) of each text; clauses one by one, then back together."""
    return f"""c AS (SELECT {key}, text, unnest({CLAUSES}) AS clause, unnest(range(1, len({CLAUSES}) + 1)) AS i FROM (SELECT DISTINCT {key}, text FROM ({source}))),
    w AS MATERIALIZED (SELECT {key}, i, clause, {_cut_sql('clause')} AS words FROM c), v AS MATERIALIZED (SELECT *, {_weights_sql('words')} AS weights FROM w),
    s AS (SELECT *, {_score_sql('weights')} AS score, CASE WHEN max(CASE WHEN contains(clause, '但') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) = 1 THEN 2.0 ELSE 1.0 END AS k FROM v),
    per AS (SELECT {key}, sum(score * k ORDER BY i) / sum(k) AS mean, list(score ORDER BY i) AS scores, flatten(list(words ORDER BY i)) AS words, flatten(list(weights ORDER BY i)) AS weights FROM s GROUP BY ALL),
    judged AS (SELECT r.*, CASE WHEN trim(text) = '' THEN 0.0 ELSE round(greatest(-1.0, least(1.0, coalesce(mean, 0.0) + 0.3 * {FACE_SCORE})), 4) + 0.0 END AS score, coalesce(scores, []) AS scores,
        list_transform(list_filter(range(1, coalesce(len(words), 0) + 1), lambda i: weights[i] > 0), lambda i: words[i]) AS pos, list_transform(list_filter(range(1, coalesce(len(words), 0) + 1), lambda i: weights[i] < 0), lambda i: words[i]) AS neg FROM ({source}) r LEFT JOIN per USING ({key}))"""


def _distinct_sql(words: str) -> str:
    return f"list_filter({words}, lambda w, i: NOT list_contains({words}[1:i - 1], w))[1:10]"


@query(f"""WITH {_judged_sql(REVIEW_LINES, 'l_orderkey, l_linenumber')} SELECT l_orderkey, l_linenumber, {LABEL('score')} AS sentiment, score, array_to_string({_distinct_sql('pos')}, ' ') AS positive_words,
array_to_string({_distinct_sql('neg')}, ' ') AS negative_words, CAST(len(scores) AS INT) AS num_clauses FROM judged""")
def doc_sentiment(spark, sf_dir):
    rows = reviews(spark, sf_dir).withColumn("s", sentiment.analyse(F.col("text")))
    said = lambda c: F.array_join(f"s.{c}", " ").alias(c)
    return rows.select("l_orderkey", "l_linenumber", "s.sentiment", "s.score", said("positive_words"), said("negative_words"), "s.num_clauses")


@query(f"SELECT o_orderkey, round({FACE_SCORE}, 6) AS score FROM ({REVIEWS})")
def emoji_sentiment(spark, sf_dir):
    return texts(spark, sf_dir, phrases.REVIEW).select("o_orderkey", F.round(sentiment.emoji_score(F.col("text")), 6).alias("score"))


@query(f"""WITH w AS (SELECT o_orderkey, unnest({_cut_sql('text')}) AS word FROM ({REVIEWS})), e AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{w}')" for k, v in L.EMOTIONS.items() for w in dict.fromkeys(v))}) v(emotion, word))
SELECT emotion, count(*) AS n, count(DISTINCT o_orderkey) AS texts FROM w JOIN e USING (word) GROUP BY emotion""")
def fine_grained(spark, sf_dir):
    found = texts(spark, sf_dir, phrases.REVIEW).select(F.explode_outer(sentiment.emotions(sentiment.tokens(F.col("text")))).alias("emotion", "n")).where("emotion is not null")
    return found.groupBy("emotion").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))


@query(f"""WITH {_judged_sql(REVIEWS, 'o_orderkey')}, a AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{w}')" for i, (k, v) in enumerate(L.ASPECTS.items()) for w in dict.fromkeys(v))}) v(place, aspect, word)),
h AS (SELECT o_orderkey, text, place, aspect, word, unnest(list_transform(range(1, len(string_split(text, word))), lambda i: CAST(list_sum(list_transform(string_split(text, word)[1:i], lambda x: len(x))) + (i - 1) * len(word) AS BIGINT))) AS spot FROM ({REVIEWS}) JOIN a ON contains(text, word)),
ar AS (SELECT *, {_cut_sql("substr(text, greatest(spot - 30, 0) + 1, least(spot, 30) + len(word) + 30)")} AS words FROM h), sc AS (SELECT *, {_weights_sql('words')} AS weights FROM ar), s2 AS (SELECT *, {_score_sql('weights')} AS s FROM sc),
f AS (SELECT o_orderkey, place, aspect, s FROM s2 WHERE abs(s) > 0.05 QUALIFY row_number() OVER (PARTITION BY o_orderkey, aspect ORDER BY spot, len(word), word) = 1),
g AS (SELECT o_orderkey, list(aspect || ':' || {LABEL('s')} ORDER BY place) AS aspects, count(*) FILTER (s > 0.1) AS p, count(*) FILTER (s < -0.1) AS q FROM f GROUP BY o_orderkey)
SELECT o_orderkey, array_to_string(coalesce(aspects, []), ' ') AS aspects, CASE WHEN aspects IS NULL THEN {LABEL('score')} WHEN p > q THEN '偏正面' WHEN q > p THEN '偏负面' ELSE '混合' END AS overall FROM judged LEFT JOIN g USING (o_orderkey)""")
def aspect_sentiment(spark, sf_dir):
    rows = texts(spark, sf_dir, phrases.REVIEW).withColumn("a", sentiment.aspects(F.col("text"))).withColumn("base", sentiment.analyse(F.col("text"))["sentiment"])
    return rows.select("o_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["aspect"], x["sentiment"])), " ").alias("aspects"), sentiment.overall(F.col("a"), F.col("base")).alias("overall"))


# ---------------------------------------------------------------- personal data

CONTACTS = texts_sql(phrases.CONTACT, "customer", "c_custkey")
RUN_KIND = "CASE WHEN regexp_full_match(s.text, '[1-9][0-9]{17}[Xx]') THEN 'id_card_x' WHEN regexp_full_match(s.text, '[1-9][0-9]{17}') THEN 'id_card' WHEN regexp_full_match(s.text, '1[3-9][0-9][\\s.-]?[0-9]{4}[\\s.-]?[0-9]{4}') THEN 'mobile_phone' WHEN regexp_full_match(s.text, '[1-9][0-9]{11,18}') THEN 'bank_card' END"


def personal_sql(source: str, key: str) -> str:
    """(key, category, original, start, stop): whole runs of digits by their form, numerals after their words, addresses."""
    ends = lambda p, n, kind: f"SELECT {key}, '{kind}' AS category, right(s.text, {n}) AS original, s.stop - {n} AS start, s.stop AS stop FROM ({spans_sql(source, key, 'text', quoted(p), kind, 0)})"
    runs = f"SELECT {key}, {RUN_KIND} AS category, s.text AS original, s.start AS start, s.stop AS stop FROM ({spans_sql(source, key, 'text', quoted('[0-9](?:[ .-]?[0-9])*[Xx]?'), '', 0)}) WHERE {RUN_KIND} IS NOT NULL"
    mail = f"SELECT {key}, 'email' AS category, s.text AS original, s.start AS start, s.stop AS stop FROM ({spans_sql(source, key, 'text', quoted('[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+' + chr(92) + '.[a-zA-Z]{2,}'), '', 0)})"
    return _all_of(runs, mail, ends("身份证号是[幺两二三四五六七八九零一X]{18}", 18, "id_card"), ends("(?:手机(?:号|机)|电话|号码)[是为：:\\s]*[幺两二三四五六七八九零一]{11}", 11, "mobile_phone"))


DIGITS = f"translate(original, '{L.CHINESE_DIGITS}', '{L.ARABIC_DIGITS}')"


def redacted_sql(source: str, key: str) -> str:
    """(key, text, redacted): spans replaced from the last to the first."""
    return f"""SELECT {key}, text, list_reduce(coalesce(l, []), lambda acc, s: left(acc, s.start) || '{L.REDACTED}' || substr(acc, s.stop + 1), text) AS redacted FROM ({source})
    LEFT JOIN (SELECT {key}, list({{'start': start, 'stop': stop}} ORDER BY start DESC) AS l FROM ({personal_sql(source, key)}) GROUP BY ALL) USING ({key})"""


@query(f"SELECT c_custkey, category, {DIGITS} AS original, start FROM ({personal_sql(CONTACTS, 'c_custkey')})")
def pii_spans(spark, sf_dir):
    found = opened(texts(spark, sf_dir, phrases.CONTACT, "customer", "c_custkey"), pii.records(F.col("text")), "r", "c_custkey")
    return found.select("c_custkey", "r.category", "r.original", F.col("r.start").cast("long").alias("start"))


@query(f"SELECT c_custkey, redacted FROM ({redacted_sql(CONTACTS, 'c_custkey')})")
def pii_redact(spark, sf_dir):
    return texts(spark, sf_dir, phrases.CONTACT, "customer", "c_custkey").select("c_custkey", pii.redact(F.col("text")).alias("redacted"))


@query(f"""SELECT c_custkey, 'email' AS category, original FROM ({personal_sql(CONTACTS, 'c_custkey')}) WHERE category = 'email'
UNION ALL SELECT c_custkey, 'bank_card', run FROM (SELECT c_custkey, unnest(regexp_extract_all(text, '[0-9]+[Xx]?')) AS run FROM ({CONTACTS})) WHERE regexp_full_match(run, '[1-9][0-9]{{11,18}}')"""
)
def pii_allowed(spark, sf_dir):
    """Only the categories asked for; an unknown one is ignored."""
    found = opened(texts(spark, sf_dir, phrases.CONTACT, "customer", "c_custkey"), pii.records(F.col("text"), ["email", "bank_card", "nonsense"]), "r", "c_custkey")
    return found.select("c_custkey", "r.category", "r.original")


# ---------------------------------------------------------------- transcripts

SPEECHES = texts_sql(phrases.SPEECH)


def corrected_sql(text: str) -> str:
    for wrong, right in L.HOMOPHONES.items():
        text = f"replace({text}, '{wrong}', '{right}')"
    for p, to in L.CORRECTIONS:
        text = f"regexp_replace({text}, {pattern(p)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return f"trim({text})"


@query(f"SELECT o_orderkey, {corrected_sql('text')} AS corrected FROM ({SPEECHES})")
def rule_correct(spark, sf_dir):
    return texts(spark, sf_dir, phrases.SPEECH).select("o_orderkey", transcripts.correct(F.col("text")).alias("corrected"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 100 / 100 >= 0.7 THEN text ELSE fixed END AS text, text AS original_text, CASE WHEN o_orderkey % 100 / 100 < 0.7 AND fixed <> text THEN '规则修正: ''' || text || ''' -> ''' || fixed || '''' ELSE '' END AS corrections FROM (SELECT *, {corrected_sql('text')} AS fixed FROM ({SPEECHES}))")
def low_conf_gate(spark, sf_dir):
    """Segments below the threshold are corrected and say how; all others keep their text."""
    rows = texts(spark, sf_dir, phrases.SPEECH).withColumn("c", transcripts.corrected(F.col("text"), F.col("o_orderkey") % 100 / 100, 0.7))
    return rows.select("o_orderkey", "c.text", "c.original_text", F.array_join("c.corrections", "|").alias("corrections"))


@query(f"""SELECT o_orderkey, coalesce(nullif(concat_ws('；', CASE WHEN list_bool_or(list_transform({listed(L.PII_HINTS)}, lambda w: contains(text, w))) THEN '检测到敏感信息暴露风险' END, CASE WHEN list_bool_or(list_transform({listed(L.ANOMALY_HINTS)}, lambda w: contains(text, w))) THEN '音频存在异常特征' END), ''),
CASE WHEN len(text) > 200 THEN '转写内容正常，未发现明显安全问题' ELSE '音频内容正常，未检测到明显异常' END) AS summary FROM (SELECT o_orderkey, repeat(text, CAST(1 + o_orderkey % 3 * 10 AS BIGINT)) AS text FROM ({SPEECHES}))""")
def security_summary(spark, sf_dir):
    rows = texts(spark, sf_dir, phrases.SPEECH).withColumn("text", F.expr("repeat(text, int(1 + o_orderkey % 3 * 10))"))
    return rows.select("o_orderkey", transcripts.security_summary(F.col("text")).alias("summary"))


@query("SELECT CASE WHEN c < 0.5 THEN 'low' WHEN c < 0.75 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM (SELECT o_orderkey % 100 / 100 AS c FROM orders) GROUP BY 1")
def confidence_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(transcripts.confidence_bucket(F.col("o_orderkey") % 100 / 100).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


CATEGORIES = {"价格": ("价格", "售价"), "质量": ("质量", "做工"), "服务": ("服务", "客服", "物流")}


@query(f"SELECT o_orderkey, CASE {' '.join(f'WHEN ' + ' OR '.join(f'contains(text, {quoted(w)})' for w in v) + f' THEN {quoted(k)}' for k, v in CATEGORIES.items())} ELSE '其他' END AS label FROM ({REVIEWS})")
def chinese_label(spark, sf_dir):
    return texts(spark, sf_dir, phrases.REVIEW).select("o_orderkey", classify.rule_label(F.col("text"), CATEGORIES).alias("label"))
