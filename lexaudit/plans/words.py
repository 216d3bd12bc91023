"""Queries about words and names in text without spaces, over sentences made from the orders' keys.

Orders whose key 5 divides stand for rows that were segmented and marked by hand: dictionaries and models
are counted and trained from them, and all others are read with what they give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entities, segment, tagging
from ..functions.binding import opened
from ..operators import dictionary as dictionaries
from ..operators import tagger
from . import tagged
from .registry import query, spread, table

KINDS = (entities.PERSON, entities.PLACE, entities.ORGANISATION)


def sentences(spark, sf_dir, by_hand: bool) -> DataFrame:
    """(o_orderkey, key as text)."""
    kept = F.col("o_orderkey") % 5 == 0
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).where(kept if by_hand else ~kept).withColumn("key", F.col("o_orderkey").cast("string"))


def segmented(spark, sf_dir) -> DataFrame:
    return sentences(spark, sf_dir, True).select(tagged.words(F.col("key")).alias("words"))


def unread(spark, sf_dir) -> DataFrame:
    return sentences(spark, sf_dir, False).select("o_orderkey", F.array_join(tagged.words(F.col("key")), "").alias("text"))


def marked(spark, sf_dir, by_hand: bool = True) -> DataFrame:
    rows = sentences(spark, sf_dir, by_hand)
    return rows.select("o_orderkey", F.array_join(tagged.words(F.col("key")), "").alias("text"), tagged.names(F.col("key")).alias("names"))


def trained(spark, sf_dir) -> tagging.Tagger:
    return tagger.train(marked(spark, sf_dir), KINDS)


COUNTS = f"SELECT word, count(*) AS n FROM (SELECT unnest({tagged.words_sql('CAST(o_orderkey AS VARCHAR)')}) AS word FROM orders WHERE o_orderkey % 5 = 0) GROUP BY word"


@query(COUNTS)
def word_counts(spark, sf_dir):
    """The dictionary of the segmented rows."""
    return dictionaries.word_counts(segmented(spark, sf_dir))


@query(f"""WITH d AS MATERIALIZED (SELECT word, n, sum(n) OVER () AS total FROM ({COUNTS})), dict AS MATERIALIZED (SELECT word, CAST(round({segment.SCALE} * ln(n / total)) AS BIGINT) AS w FROM d), u AS (SELECT CAST(round({segment.SCALE} * ln(1 / max(total))) AS BIGINT) AS unknown, max(len(word)) AS longest FROM d),
    t AS MATERIALIZED (SELECT o_orderkey, array_to_string({tagged.words_sql('CAST(o_orderkey AS VARCHAR)')}, '') AS text FROM orders WHERE o_orderkey % 5 <> 0),
    place AS (SELECT o_orderkey, text, unnest(range(1, len(text) + 1)) AS i FROM t), piece AS (SELECT o_orderkey, i, size, substr(text, i, size) AS word, unknown FROM (SELECT *, unnest(range(1, longest + 1)) AS size FROM place, u) WHERE i + size - 1 <= len(text)),
    edge AS (SELECT o_orderkey, i, size, coalesce(w, unknown) AS w FROM piece LEFT JOIN dict USING (word) WHERE w IS NOT NULL OR size = 1),
    graph AS (SELECT o_orderkey, list(e ORDER BY i DESC) AS e FROM (SELECT o_orderkey, i, list({{'w': w, 'size': size}}) AS e FROM edge GROUP BY ALL) GROUP BY o_orderkey),
    best AS (SELECT o_orderkey, list_reduce(e, lambda s, x: list_prepend(list_sort(list_transform(x, lambda y: {{'w': CAST(y.w + s[y.size].w AS BIGINT), 'size': CAST(y.size AS BIGINT)}}), 'DESC')[1], s), [{{'w': CAST(0 AS BIGINT), 'size': CAST(0 AS BIGINT)}}]) AS b FROM graph),
    path AS (SELECT o_orderkey, text, list_reduce(range(1, len(text) + 1), lambda s, i: CASE WHEN i < s.next THEN s ELSE {{'next': CAST(i + b[i].size AS BIGINT), 'words': list_append(s.words, substr(text, i, b[i].size))}} END, {{'next': CAST(1 AS BIGINT), 'words': CAST([] AS VARCHAR[])}}).words AS words FROM t JOIN best USING (o_orderkey))
    SELECT o_orderkey, array_to_string(words, ' ') AS words FROM path""")
def segment_words(spark, sf_dir):
    """The likeliest words of the other rows, by the dictionary alone."""
    known = dictionaries.dictionary(segmented(spark, sf_dir))
    return unread(spark, sf_dir).select("o_orderkey", F.array_join(segment.segment(F.col("text"), known), " ").alias("words"))


@query()
def segment_unknown(spark, sf_dir):
    """The same, with the words that the dictionary lacks."""
    rows = segmented(spark, sf_dir)
    known, shapes = dictionaries.dictionary(rows), dictionaries.shapes(rows)
    return unread(spark, sf_dir).select("o_orderkey", F.array_join(segment.segment(F.col("text"), known, shapes), " ").alias("words"))


@query()
def recognise_names(spark, sf_dir):
    """All entities of the other rows; people, places and organisations by the trained labeller, without lists."""
    model = trained(spark, sf_dir)
    found = entities.recognise(F.col("text"), more=tagging.finder(model))
    rows = opened(unread(spark, sf_dir), found, "e", "o_orderkey")
    return rows.select("o_orderkey", F.col("e.text").alias("text"), F.col("e.type").alias("type"), F.col("e.start").alias("start"), F.col("e.end").alias("stop"))
