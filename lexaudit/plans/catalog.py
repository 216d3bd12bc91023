"""The registered queries over the supplied tables, and the SQL that they are held against.

The tables hold Latin text, so the queries read words by letters and digits; where an operator is
about Chinese text, the query makes such text from the tables' columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, entities, events, pii, sentiment, tokens, transcripts
from ..functions import lexicons as L
from ..functions.binding import opened
from ..operators import classify, duplicates, gibbs, keywords, scratch, signal, summaries, timeline, topics
from ..operators import waves as pieced
from ..sources import posts as sources
from . import analysis, chinese, models, phrases, words  # noqa: F401 - words registers its own queries
from .registry import QUERIES, SQL, query, spread, table  # noqa: F401

ENGLISH_STOPWORDS = ("the", "of", "and", "to", "in", "is", "a", "that", "for", "on", "with", "as")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokens.latin_tokens(F.col("text")).alias("tokens"))


TOKENS = "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tokens FROM documents"

# ---------------------------------------------------------------- cleaning


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\\x20\\t\\n\\x0b\\x0c\\r]+', ' ', 'g'))) AS digest FROM pages")
def strip_html(spark, sf_dir):
    plain = F.trim(F.regexp_replace(cleaning.strip_tags(F.col("html")), r"[\x20\t\n\x0b\x0c\r]+", " "))
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.md5(plain).alias("digest"))


@query(f"SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM ({TOKENS})")
def tokens_long(spark, sf_dir):
    return tokenised(spark, sf_dir).select("doc_id", F.posexplode_outer("tokens").alias("pos", "token")).where("token is not null").select("doc_id", "token", F.col("pos").cast("long").alias("pos"))


STOP_SQL = ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS)
CONTENT = f"SELECT doc_id, list_filter(tokens, lambda t: t NOT IN ({STOP_SQL}) AND NOT regexp_full_match(t, '\\p{{Nd}}+') AND len(t) >= 2) AS tokens FROM ({TOKENS})"


@query(f"SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM ({CONTENT})")
def stopword_filter(spark, sf_dir):
    kept = tokens.keep_content(F.col("tokens"), ENGLISH_STOPWORDS)
    return tokenised(spark, sf_dir).withColumn("tokens", kept).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(tokens.join_tokens(F.col("tokens"))).alias("digest"))


@query(f"WITH t AS ({TOKENS}) SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, list_filter(tokens, lambda t, i: i = 1 OR t <> tokens[i - 1]) AS k FROM t)")
def consecutive_dedup(spark, sf_dir):
    rows = tokenised(spark, sf_dir).select("doc_id", tokens.drop_repeats(F.col("tokens")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(tokens.join_tokens(F.col("k"))).alias("digest"))


# ---------------------------------------------------------------- sources and sinks


@query("SELECT doc_id, coalesce(lang, '') AS topic, md5(text) AS digest FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> ''")
def posts_jsonl(spark, sf_dir):
    """Documents written as lines of JSON posts and read again; every third has no text and is left out."""
    rows = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    lines = rows.select("doc_id", F.struct(F.col("lang").alias("word")).alias("topic"), F.struct(F.struct(text.alias("text")).alias("selected_post")).alias("selection"))
    path = scratch.place(spark, "posts")
    sources.write_jsonl(lines, path)
    return sources.read_posts(spark, path).select("doc_id", "topic", F.md5("text").alias("digest"))


@query("SELECT DISTINCT trim(line) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def word_list(spark, sf_dir):
    """The lines of all documents as a word list."""
    path = scratch.place(spark, "words")
    sources.write_text(table(spark, sf_dir, "documents"), "text", path)
    return sources.word_lines(spark, path)


# ---------------------------------------------------------------- duplicates


@query("SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_dups(spark, sf_dir):
    return duplicates.exact_groups(documents(spark, sf_dir))


SIGNATURES = "SELECT list_sort(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) AS chars, min(doc_id) AS id FROM documents GROUP BY 1"


@query(f"WITH s AS MATERIALIZED (SELECT * FROM ({SIGNATURES}) WHERE len(chars) > 0), p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.chars, y.chars)) AS i, len(x.chars) + len(y.chars) AS n FROM s x JOIN s y ON x.id < y.id) SELECT a, b, round(i / (n - i), 6) AS similarity FROM p WHERE i >= 0.95 * (n - i)")
def char_jaccard_pairs(spark, sf_dir):
    pairs = duplicates.similar_signatures(duplicates.signatures(documents(spark, sf_dir)), 0.95)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) AS chars FROM documents),
k AS (SELECT list_reduce(list({'id': doc_id, 'chars': chars} ORDER BY doc_id), lambda acc, x: CASE WHEN list_bool_or(list_transform(acc, lambda y: len(list_intersect(y.chars, x.chars)) >= 0.85 * (len(y.chars) + len(x.chars) - len(list_intersect(y.chars, x.chars))))) THEN acc ELSE list_append(acc, x) END, CAST([] AS STRUCT(id BIGINT, chars VARCHAR[])[])) AS kept FROM s WHERE len(chars) > 0)
SELECT x.id AS doc_id FROM (SELECT unnest(kept) AS x FROM k)""")
def greedy_dedup(spark, sf_dir):
    return duplicates.greedy(documents(spark, sf_dir), 0.85)


# ---------------------------------------------------------------- keywords

VOCABULARY = f"SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS word FROM ({TOKENS})) GROUP BY word ORDER BY df DESC, word LIMIT 5000"
N_DOCS = f"(SELECT count(*) FROM ({TOKENS}) WHERE len(tokens) > 0)"


@query(VOCABULARY)
def df_vocab(spark, sf_dir):
    return keywords.fit_idf(tokenised(spark, sf_dir), 5000).select("word", "df")


@query(f"SELECT word, round(ln(({N_DOCS} + 1) / (df + 1)) + 1, 6) AS idf FROM ({VOCABULARY})")
def idf_smooth(spark, sf_dir):
    return keywords.fit_idf(tokenised(spark, sf_dir), 5000).select("word", F.round("idf", 6).alias("idf"))


@query(f"SELECT word, round(ln({N_DOCS} / df), 6) AS idf FROM ({VOCABULARY})")
def idf_plain(spark, sf_dir):
    return keywords.fit_idf(tokenised(spark, sf_dir), 5000, smooth=False).select("word", F.round("idf", 6).alias("idf"))


def _tfidf_sql(tf: str) -> str:
    return f"""WITH t AS ({TOKENS}), long AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS word, unnest(range(len(tokens))) AS pos FROM t),
    c AS (SELECT doc_id, word, count(*) AS cnt, min(pos) AS first_pos, any_value(n) AS n FROM long GROUP BY ALL),
    v AS (SELECT word, ln(({N_DOCS} + 1) / (df + 1)) + 1 AS idf FROM ({VOCABULARY})),
    s AS (SELECT doc_id, word, first_pos, round({tf} * idf, 6) AS score FROM c JOIN v USING (word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first_pos) AS rank FROM s)
    SELECT doc_id, CAST(rank AS INT) AS rank, word, score FROM r WHERE rank <= 5"""


@query(_tfidf_sql("cnt / n"))
def tfidf_top(spark, sf_dir):
    return keywords.tfidf(tokenised(spark, sf_dir), 5)


@query(_tfidf_sql("ln(1 + cnt)"))
def tfidf_sublinear(spark, sf_dir):
    return keywords.tfidf(tokenised(spark, sf_dir), 5, sublinear=True)


@query(f"""WITH t AS ({TOKENS}), l AS (SELECT doc_id, unnest(tokens) AS w, unnest(range(len(tokens))) AS pos FROM t),
p AS (SELECT a.doc_id, a.w AS src, b.w AS dst FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 AND a.w <> b.w)
SELECT doc_id, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT doc_id, src, dst, count(*) AS weight FROM (SELECT * FROM p UNION ALL SELECT doc_id, dst, src FROM p) GROUP BY ALL) GROUP BY doc_id""")
def cooc_edges(spark, sf_dir):
    edges = keywords.cooccurrence(tokenised(spark, sf_dir), 3)
    return edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"))


def _ranked_sql(nodes: str, edges: str) -> str:
    """CTEs down to ranked (doc_id, i, score): graph ranking of every document's nodes (doc_id, i) over edges
    (doc_id, src, dst, weight) given both ways, until a sweep changes a document by less than 1e-4 in all."""
    return f"""nd AS MATERIALIZED ({nodes}), ed AS MATERIALIZED ({edges}), size AS (SELECT doc_id, count(*) AS n FROM nd GROUP BY doc_id), outs AS (SELECT doc_id, src, sum(weight) AS o FROM ed GROUP BY ALL),
    adj AS MATERIALIZED (SELECT doc_id, src, dst, weight / o AS share, CAST(0 AS DOUBLE) AS own FROM ed JOIN outs USING (doc_id, src) UNION ALL SELECT doc_id, i, i, 0.0, 1.0 FROM nd
        UNION ALL SELECT x.doc_id, x.i, y.i, CAST(1 AS DOUBLE) / n / 0.85, 0.0 FROM nd x ANTI JOIN outs ON outs.doc_id = x.doc_id AND outs.src = x.i JOIN nd y ON y.doc_id = x.doc_id JOIN size ON size.doc_id = x.doc_id WHERE n > 1),
    sweep(doc_id, i, score, change, r) AS (SELECT doc_id, i, CAST(1 AS DOUBLE) / n, CAST(CASE WHEN n = 1 THEN 0 ELSE 1 END AS DOUBLE), 0 FROM nd JOIN size USING (doc_id)
        UNION ALL SELECT doc_id, i, score, sum(abs(score - old)) OVER (PARTITION BY doc_id), r FROM (SELECT adj.doc_id, dst AS i, 0.15 + 0.85 * sum(score * share) AS score, sum(score * own) AS old, max(r) + 1 AS r FROM sweep JOIN adj ON adj.doc_id = sweep.doc_id AND adj.src = sweep.i WHERE change >= 1e-4 AND r < 100 GROUP BY adj.doc_id, dst)),
    ranked AS (SELECT doc_id, i, score FROM sweep QUALIFY r = max(r) OVER (PARTITION BY doc_id))"""


WORD_NODES = f"SELECT doc_id, word AS i, min(pos) AS pos FROM (SELECT doc_id, unnest(tokens) AS word, unnest(range(len(tokens))) AS pos FROM ({TOKENS})) GROUP BY ALL"
WORD_EDGES = f"""SELECT doc_id, src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (WITH l AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS w, unnest(range(len(tokens))) AS pos FROM ({TOKENS})), n AS MATERIALIZED (SELECT doc_id, pos - d AS pos, w FROM l, (SELECT unnest([1, 2, 3]) AS d)),
p AS MATERIALIZED (SELECT l.doc_id, l.w AS src, n.w AS dst FROM l JOIN n USING (doc_id, pos) WHERE l.w <> n.w) SELECT * FROM p UNION ALL SELECT doc_id, dst, src FROM p) GROUP BY ALL"""


@query(f"WITH RECURSIVE {_ranked_sql(WORD_NODES, WORD_EDGES)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos) AS INT) AS rank, i AS word, round(score, 6) AS score FROM ranked JOIN nd USING (doc_id, i) QUALIFY rank <= 10")
def textrank_keywords(spark, sf_dir):
    return keywords.textrank(tokenised(spark, sf_dir), 10)


# ---------------------------------------------------------------- sentences and summaries


def sentences(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", tokens.split_sentences(F.col("text"), ideographs=False).alias("sentences"))
    return rows.withColumn("sentence_tokens", F.transform("sentences", lambda s: tokens.latin_tokens(s)))


SENTENCES = f"""sen AS MATERIALIZED (SELECT doc_id, i, s, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+') AS t FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), '[。！？\n；;]+|\\x01'), lambda x: trim(x)), lambda x: len(x) >= 4) AS l FROM documents))),
size_ AS (SELECT doc_id, count(*) AS m FROM sen GROUP BY doc_id)"""


def _chosen_sql(scored: str, alike: str) -> str:
    """(doc_id, chosen): the three best of scored (doc_id, i, s, x, score) that are not too alike, in the order of the text."""
    kind = "STRUCT(i BIGINT, s VARCHAR, x VARCHAR[])"
    return f"""pick AS (SELECT doc_id, list_reduce(list(CAST({{'i': i, 's': s, 'x': x}} AS {kind}) ORDER BY round(score, 12) DESC, i), lambda acc, c: CASE WHEN len(acc) >= 3 OR (m > 3 AND coalesce(list_bool_or(list_transform(acc, lambda o: {alike})), false)) THEN acc ELSE list_append(acc, c) END, CAST([] AS {kind}[])) AS l FROM ({scored}) JOIN size_ USING (doc_id) GROUP BY doc_id, m)
    SELECT d.doc_id, coalesce(list_transform(list_sort(l), lambda c: c.s), []) AS chosen FROM documents d LEFT JOIN pick USING (doc_id)"""


TFIDF_SENTENCES = """tot AS (SELECT doc_id, sum(len(t)) AS total FROM sen GROUP BY doc_id), w AS (SELECT doc_id, i, unnest(t) AS word FROM sen), freq AS (SELECT doc_id, word, count(*) AS c, count(DISTINCT i) AS k FROM w GROUP BY ALL),
wt AS MATERIALIZED (SELECT doc_id, word, c / total * (ln((m + 1) / (k + 1)) + 1) AS weight FROM freq JOIN tot USING (doc_id) JOIN size_ USING (doc_id)),
sc AS (SELECT doc_id, i, sum(weight) AS score FROM w JOIN wt USING (doc_id, word) GROUP BY ALL),"""


@query(f"WITH {SENTENCES}, {TFIDF_SENTENCES} " + _chosen_sql("SELECT doc_id, i, s, list_distinct(t) AS x, coalesce(score, 0) * CASE WHEN i < 0.2 * m THEN 1.3 ELSE 1 END * CASE WHEN len(t) < 5 THEN 0.5 ELSE 1 END AS score FROM sen LEFT JOIN sc USING (doc_id, i) JOIN size_ USING (doc_id)",
    "len(o.x) > 0 AND len(c.x) > 0 AND len(list_intersect(o.x, c.x)) / (len(o.x) + len(c.x) - len(list_intersect(o.x, c.x))) > 0.6"))
def summary_tfidf(spark, sf_dir):
    return summaries.summarise(sentences(spark, sf_dir), "tfidf", 3)


SENTENCE_NODES = "SELECT doc_id, i FROM sen"
SENTENCE_EDGES = """SELECT doc_id, a AS src, b AS dst, dot / sqrt(p.q) / sqrt(r.q) AS weight FROM (SELECT x.doc_id, x.i AS a, y.i AS b, sum(x.c * y.c) AS dot FROM cnt x JOIN cnt y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i <> y.i GROUP BY ALL) JOIN len_ p USING (doc_id) JOIN len_ r USING (doc_id) WHERE p.i = a AND r.i = b"""


@query(f"WITH RECURSIVE {SENTENCES}, cnt AS MATERIALIZED (SELECT doc_id, i, word, CAST(count(*) AS DOUBLE) AS c FROM (SELECT doc_id, i, unnest(t) AS word FROM sen) GROUP BY ALL), len_ AS MATERIALIZED (SELECT doc_id, i, sum(c * c) AS q FROM cnt GROUP BY ALL), {_ranked_sql(SENTENCE_NODES, SENTENCE_EDGES)}, "
    + _chosen_sql("SELECT doc_id, i, s, list_transform(list_sort(t), lambda w: w) AS x, score FROM sen JOIN ranked USING (doc_id, i)", "coalesce(list_sum(list_transform(list_distinct(o.x), lambda w: CAST(len(list_filter(o.x, lambda v: v = w)) AS DOUBLE) * len(list_filter(c.x, lambda v: v = w)))), 0) / greatest(sqrt(coalesce(list_sum(list_transform(list_distinct(o.x), lambda w: CAST(len(list_filter(o.x, lambda v: v = w)) AS DOUBLE) ** 2)), 0)), 1e-12) / greatest(sqrt(coalesce(list_sum(list_transform(list_distinct(c.x), lambda w: CAST(len(list_filter(c.x, lambda v: v = w)) AS DOUBLE) ** 2)), 0)), 1e-12) > 0.8"))
def summary_textrank(spark, sf_dir):
    return summaries.summarise(sentences(spark, sf_dir), "textrank", 3)


# ---------------------------------------------------------------- sentiment


@query("""SELECT doc_id, round(greatest(-1, least(1, s / sqrt(n))), 4) AS score FROM (
SELECT doc_id, len(tokens) AS n, CAST(list_sum(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN tokens[i] = 'tion' THEN 1.0 WHEN tokens[i] = 'er' THEN -1.0 ELSE 0.0 END
* CASE WHEN i > 1 AND tokens[i - 1] = 'the' THEN 2.0 ELSE 1.0 END * CASE WHEN i > 1 AND tokens[i - 1] = 'of' THEN -1.0 ELSE 1.0 END)) AS DOUBLE) AS s0, greatest(-5.0, least(5.0, coalesce(s0, 0.0))) AS s FROM (""" + TOKENS + """)) WHERE n > 0""")
def clause_sentiment(spark, sf_dir):
    """Each text as one clause, with a small lexicon of its language."""
    weights = sentiment.token_weights(F.col("tokens"), ("tion",), ("er",), {"the": 2.0}, ("of",))
    rows = tokenised(spark, sf_dir).where(F.size("tokens") > 0)
    return rows.select("doc_id", F.round(sentiment.clause_score(weights), 4).alias("score"))


# ---------------------------------------------------------------- classification


def labelled(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    rows = documents(spark, sf_dir).join(labels, "doc_id")  # texts are smaller than lists of their words
    return rows.select("doc_id", tokens.latin_tokens(F.col("text")).alias("tokens"), "label")


CATEGORIES = {"tion": ("tiontion", "ention"), "ment": ("mentment", "ement"), "heit": ("keit", "heit")}


@query("SELECT doc_id, CASE WHEN contains(text, 'tiontion') OR contains(text, 'ention') THEN 'tion' WHEN contains(text, 'mentment') OR contains(text, 'ement') THEN 'ment' WHEN contains(text, 'keit') OR contains(text, 'heit') THEN 'heit' ELSE '其他' END AS label FROM documents")
def auto_label(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", classify.rule_label(F.col("text"), CATEGORIES).alias("label"))


LABELLED = f"SELECT doc_id, tokens, 'q' || quality AS label FROM ({TOKENS}) JOIN labels USING (doc_id)"
VOCAB500 = f"SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS word FROM ({LABELLED})) GROUP BY word HAVING count(*) >= 2 ORDER BY df DESC, word LIMIT 500"
VECTORS = f"SELECT doc_id, word, count(*) AS cnt FROM (SELECT doc_id, unnest(tokens) AS word FROM ({LABELLED})) JOIN ({VOCAB500}) USING (word) GROUP BY ALL"


@query(f"SELECT doc_id, word, cnt FROM ({VECTORS})")
def count_vectors(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return classify.count_vectors(rows, classify.fit_vocabulary(rows, 500, 2)).select("doc_id", "word", "cnt")


BAYES = f"""t AS MATERIALIZED ({LABELLED}), vocab AS MATERIALIZED ({VOCAB500}), vec AS MATERIALIZED ({VECTORS}),
pri AS (SELECT label, ln(count(*) / (SELECT count(*) FROM t)) AS log_prior FROM t GROUP BY label),
f AS (SELECT label, word, sum(cnt) AS f FROM vec JOIN t USING (doc_id) GROUP BY ALL), tot AS (SELECT label, sum(f) AS t FROM f GROUP BY label),
cond AS (SELECT label, word, ln((coalesce(f, 0) + 1) / (t + (SELECT count(*) FROM vocab))) AS log_prob FROM tot CROSS JOIN vocab LEFT JOIN f USING (label, word))"""


@query(f"WITH {BAYES} SELECT label, word, round(log_prob, 6) AS log_prob FROM cond")
def nb_model(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    _, conditionals = classify.fit_bayes(rows, classify.fit_vocabulary(rows, 500, 2))
    return conditionals.select("label", "word", F.round("log_prob", 6).alias("log_prob"))


def _guessed(spark, sf_dir) -> DataFrame:
    rows = labelled(spark, sf_dir)
    vocabulary = classify.fit_vocabulary(rows, 500, 2)
    return classify.predict(classify.bayes_scores(rows, vocabulary, *classify.fit_bayes(rows, vocabulary)), 6).select("doc_id", "label", F.round("score", 4).alias("score"))


GUESSED = f"{BAYES}, sc AS (SELECT t.doc_id, pri.label, log_prior + coalesce(s, 0) AS score FROM (SELECT doc_id FROM t) t CROSS JOIN pri LEFT JOIN (SELECT doc_id, label, sum(cnt * log_prob) AS s FROM vec JOIN cond USING (word) GROUP BY ALL) USING (doc_id, label)), g AS (SELECT doc_id, label, round(score, 4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) = 1)"


@query(f"WITH {GUESSED} SELECT * FROM g")
def nb_predict(spark, sf_dir):
    return _guessed(spark, sf_dir)


def _pairs(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", F.col("label").alias("truth")).join(_guessed(spark, sf_dir).select("doc_id", F.col("label").alias("predicted")), "doc_id")


@query(f"""WITH {GUESSED}, p AS (SELECT t.label AS truth, g.label AS predicted FROM t JOIN g USING (doc_id)), l AS (SELECT DISTINCT unnest([truth, predicted]) AS label FROM p),
c AS (SELECT label, count(*) FILTER (truth = label AND predicted = label) AS hit, count(*) FILTER (predicted = label) AS guessed, count(*) FILTER (truth = label) AS support FROM l CROSS JOIN p GROUP BY label),
r AS (SELECT *, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support, round(sum(hit) OVER () / sum(support) OVER (), 4) AS accuracy FROM r""")
def class_report(spark, sf_dir):
    return classify.report(_pairs(spark, sf_dir))


@query(f"WITH {GUESSED}, p AS (SELECT t.label AS truth, g.label AS predicted FROM t JOIN g USING (doc_id)), l AS (SELECT DISTINCT unnest([truth, predicted]) AS label FROM p) SELECT a.label AS truth, b.label AS predicted, count(p.truth) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.truth = a.label AND p.predicted = b.label GROUP BY ALL")
def confusion(spark, sf_dir):
    return classify.confusion(_pairs(spark, sf_dir))


@query("SELECT doc_id, CAST(CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM documents")
def kfold(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", classify.fold("doc_id", 5, 7).alias("fold"))


def _fold_sql(k: int) -> str:
    """The accuracy of fold k under naive Bayes of the other folds, 5,000 words at most."""
    return f"""SELECT {k} AS fold, (WITH tr AS MATERIALIZED (SELECT * FROM lf WHERE fold <> {k}), te AS MATERIALIZED (SELECT * FROM lf WHERE fold = {k}), trw AS MATERIALIZED (SELECT doc_id, label, unnest(tokens) AS word FROM tr), vo AS MATERIALIZED (SELECT word FROM trw GROUP BY word ORDER BY count(DISTINCT doc_id) DESC, word LIMIT 5000),
    pr AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY label), f AS (SELECT label, word, count(*) AS f FROM trw JOIN vo USING (word) GROUP BY ALL), tt AS (SELECT label, coalesce(sum(f), 0) AS t FROM pr LEFT JOIN f USING (label) GROUP BY label),
    co AS MATERIALIZED (SELECT label, word, ln((coalesce(f, 0) + 1) / (t + (SELECT count(*) FROM vo))) AS lg FROM tt CROSS JOIN vo LEFT JOIN f USING (label, word)), kn AS (SELECT doc_id, label, sum(lg) AS s FROM (SELECT doc_id, unnest(tokens) AS word FROM te) JOIN co USING (word) GROUP BY ALL),
    sc AS (SELECT te.doc_id, te.label AS truth, pr.label, lp + coalesce(s, 0) AS score FROM te CROSS JOIN pr LEFT JOIN kn ON kn.doc_id = te.doc_id AND kn.label = pr.label), g AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1)
    SELECT avg(CASE WHEN truth = label THEN 1.0 ELSE 0.0 END) FROM g) AS accuracy"""


@query(f"WITH lf AS MATERIALIZED (SELECT doc_id, tokens, label, CAST('0x' || substr(md5('1:' || doc_id), 1, 8) AS BIGINT) % 3 AS fold FROM ({LABELLED})), a AS ({' UNION ALL '.join(map(_fold_sql, range(3)))}) SELECT CAST(fold AS INT) AS fold, round(accuracy, 9) AS accuracy, round(avg(accuracy) OVER (), 9) AS mean, round(stddev_pop(accuracy) OVER (), 9) AS std FROM a")
def cross_validation(spark, sf_dir):
    """Three folds with the operator's own vocabulary size."""
    found = classify.cross_validate(labelled(spark, sf_dir), 3, 1)
    return found.select("fold", *(F.round(c, 9).alias(c) for c in ("accuracy", "mean", "std")))


@query(f"WITH v AS MATERIALIZED ({VOCAB500}), c AS (SELECT doc_id, word, cnt, df, sum(cnt) OVER (PARTITION BY doc_id) AS total FROM ({VECTORS}) JOIN v USING (word)), x AS (SELECT doc_id, word, cnt / total * (ln(((SELECT count(*) FROM ({LABELLED})) + 1) / (df + 1)) + 1) AS value FROM c) SELECT doc_id, word, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM x")
def tfidf_unit_vectors(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    vectors = classify.tfidf_vectors(rows, classify.fit_vocabulary(rows, 500, 2), rows.count())
    return vectors.select("doc_id", "word", F.round("value", 6).alias("value"))


@query()
def logistic_predict(spark, sf_dir):
    """100 epochs over 5,000 words; an epoch is a pass over all rows (the operator's default is 500 epochs)."""
    rows = labelled(spark, sf_dir)
    vocabulary = classify.fit_vocabulary(rows)
    vectors = classify.tfidf_vectors(rows, vocabulary, rows.count())
    model = classify.fit_logistic(vectors.select("doc_id", "idx", "value"), rows.select("doc_id", "label"), 5000, epochs=100)
    return classify.predict(classify.logistic_scores(vectors, rows, model), 9)


@query(f"WITH {GUESSED}, e AS (SELECT doc_id, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, label) AS k FROM sc), p AS (SELECT doc_id, label, k, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e) SELECT doc_id, label AS sentiment, round(p, 4) AS confidence FROM p WHERE k = 1")
def supervised_sentiment(spark, sf_dir):
    """A trained classifier in the place of the lexicon: the best label and its probability."""
    rows = labelled(spark, sf_dir)
    vocabulary = classify.fit_vocabulary(rows, 500, 2)
    found = classify.probabilities(classify.bayes_scores(rows, vocabulary, *classify.fit_bayes(rows, vocabulary)), 6)
    return found.select("doc_id", F.col("label").alias("sentiment"), F.round("confidence", 4).alias("confidence"))


@query(f"SELECT x.doc_id, y.doc_id AS other_id, len(list_intersect(x.c, y.c)) >= 0.85 * (len(x.c) + len(y.c) - len(list_intersect(x.c, y.c))) AS alike FROM (SELECT doc_id, list_distinct(string_split(text, '')) AS c FROM documents) x JOIN (SELECT doc_id, list_distinct(string_split(text, '')) AS c FROM documents) y ON y.doc_id = x.doc_id + 1")
def neighbours_alike(spark, sf_dir):
    """Whether each document is a near-duplicate of the next one, by their characters."""
    docs = documents(spark, sf_dir)
    other = docs.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other"))
    return docs.join(other, F.col("other_id") == F.col("doc_id") + 1).select("doc_id", "other_id", cleaning.is_near_duplicate(F.col("text"), F.col("other")).alias("alike"))


# ---------------------------------------------------------------- topics and clusters


ASSIGNED = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT vec_id AS k, v FROM v WHERE vec_id < 8), d AS (SELECT v.vec_id, c.k, round(1 - list_cosine_similarity(v.v, c.v), 9) AS distance FROM v CROSS JOIN c) SELECT vec_id, CAST(k AS INT) AS cluster, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1"


@query(ASSIGNED)
def kmeans_assign(spark, sf_dir):
    """Nearest of eight given centres: the vectors with the smallest ids."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = vectors.where("vec_id < 8").orderBy("vec_id").collect()
    found = topics.assign(vectors, np.array([r.v for r in first]), "vec_id")
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c(r, k, c) AS (SELECT 0, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1, v FROM v QUALIFY row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) <= 8
    UNION ALL SELECT r + 1, k, list_transform(range(1, len(m[1]) + 1), lambda d: list_avg(list_transform(m, lambda x: x[d]))) FROM (SELECT r, k, list(v) AS m FROM (SELECT r, k, vec_id, v FROM c CROSS JOIN v WHERE r < 50 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(1 - list_cosine_similarity(v, c), 12), k) = 1) GROUP BY r, k)),
a AS (SELECT vec_id, k FROM c CROSS JOIN v WHERE r = 50 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(1 - list_cosine_similarity(v, c), 12), k) = 1)
SELECT CAST(k AS INT) AS cluster, count(*) AS size FROM a GROUP BY k""")
def kmeans_clusters(spark, sf_dir):
    """Fifty rounds at most, or until no centre moves."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = vectors.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(8).collect()
    found, _ = topics.kmeans(vectors, np.array([r.v for r in first]), id_col="vec_id")
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query(f"""WITH t AS ({TOKENS}), c AS (SELECT doc_id, word, count(*) / any_value(n) AS tf FROM (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS word FROM t) GROUP BY doc_id, word),
k AS MATERIALIZED (SELECT vec_id AS doc_id, cluster FROM ({ASSIGNED}) WHERE vec_id IN (SELECT doc_id FROM documents)), z AS (SELECT cluster, count(*) AS size FROM k GROUP BY cluster), w AS (SELECT cluster, word, sum(tf) AS s FROM c JOIN k USING (doc_id) GROUP BY ALL), g AS (SELECT word, sum(tf) AS g FROM c JOIN k USING (doc_id) GROUP BY word),
x AS (SELECT cluster, word, round(s / size / sqrt(g + 0.01), 6) AS score, size FROM w JOIN z USING (cluster) JOIN g USING (word))
SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, word) AS INT) AS rank, word, score, size FROM x QUALIFY rank <= 15""")
def kmeans_keywords(spark, sf_dir):
    """Words of the clusters that k-means gives the documents' vectors."""
    clusters = kmeans_assign(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "cluster").join(documents(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return topics.cluster_keywords(tokenised(spark, sf_dir), clusters)


def content(spark, sf_dir) -> DataFrame:
    return tokenised(spark, sf_dir).select("doc_id", tokens.keep_content(F.col("tokens"), ENGLISH_STOPWORDS).alias("tokens"))


@query()
def lda_topics(spark, sf_dir):
    """Ten topics by 100 sweeps over all documents: fifteen words of each, with their probability."""
    return gibbs.GibbsModel(content(spark, sf_dir), sweeps=100).describe().select("topic_id", F.posexplode(F.arrays_zip("words", "scores")).alias("rank", "x")).select("topic_id", "rank", F.col("x.words").alias("word"), F.col("x.scores").alias("score"))


@query()
def lda_fold_in(spark, sf_dir):
    """Topics from the documents of even ids; the shares of those of odd ids under them."""
    rows = content(spark, sf_dir)
    return gibbs.GibbsModel(rows.where("doc_id % 2 = 0"), sweeps=50).transform(rows.where("doc_id % 2 = 1"))


# ---------------------------------------------------------------- personal data

@query("SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS emails FROM documents WHERE regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')")
def pii_emails(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.size(pii.find(F.col("text"), ["email"])).cast("long").alias("emails"))
    return rows.where("emails > 0")


@query("SELECT 'bank_card' AS category, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+[Xx]?')) AS d FROM documents) WHERE regexp_full_match(d, '[1-9][0-9]{11,18}')")
def pii_category_counts(spark, sf_dir):
    found = opened(documents(spark, sf_dir), pii.find(F.col("text"), ["bank_card"]), "s")
    return found.groupBy(F.col("s.type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- transcripts and timelines


def segments(spark, sf_dir) -> DataFrame:
    """A conversation as a recording of a second for each turn, with spoken Chinese made from its key."""
    t = F.col("turn").cast("double")
    said = phrases.column(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), phrases.SPEECH)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn").cast("int").alias("seg_idx"), t.alias("start"), (t + 1).alias("end"), said.alias("text"), ((F.col("turn") % 10) / 10).alias("confidence"))


SAID = phrases.sql("CAST(conv_id AS VARCHAR) || chr(45) || CAST(turn AS VARCHAR)", phrases.SPEECH)
SEGMENTS = f"SELECT CAST(conv_id AS VARCHAR) AS media_id, CAST(turn AS INT) AS seg_idx, CAST(turn AS DOUBLE) AS start, CAST(turn AS DOUBLE) + 1 AS stop, {SAID} AS text, (turn % 10) / 10 AS confidence FROM conversations"


def odd_events(spark, sf_dir) -> DataFrame:
    """Anomalies of the recordings: one of every event, spread over all conversations."""
    recordings = table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("n"))
    t = F.col("event_id") % 7
    label = F.when(F.col("event_id") % 2 == 0, L.NOISE_LABEL).otherwise(L.SYNTHETIC_LABEL)
    media = F.floor(F.col("event_id") / 3).cast("long") % F.greatest("n", F.lit(1))
    return table(spark, sf_dir, "events").join(F.broadcast(recordings)).select(media.cast("string").alias("media_id"), (t + 0.25).cast("double").alias("start"), (t + 0.95).cast("double").alias("end"), label.alias("label"), ((F.col("event_id") % 11) / 10).alias("confidence"))


ODD = f"SELECT CAST(CAST(floor(event_id / 3) AS BIGINT) % (SELECT greatest(count(DISTINCT conv_id), 1) FROM conversations) AS VARCHAR) AS media_id, CAST(event_id % 7 AS DOUBLE) + 0.25 AS start, CAST(event_id % 7 AS DOUBLE) + 0.95 AS stop, CASE WHEN event_id % 2 = 0 THEN '{L.NOISE_LABEL}' ELSE '{L.SYNTHETIC_LABEL}' END AS label, (event_id % 11) / 10 AS confidence FROM events"


@query("SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, exp(coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE -l_discount END, -1.0)))), 9) AS confidence FROM lineitem")
def asr_confidence(spark, sf_dir):
    logprob = F.when(F.col("l_linenumber") != 3, -F.col("l_discount").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(transcripts.confidence(logprob), 9).alias("confidence"))


@query(f"SELECT s.media_id, s.seg_idx, a.label, a.start AS a_start FROM ({SEGMENTS}) s JOIN ({ODD}) a ON s.media_id = a.media_id AND s.stop + 0.1 >= a.start AND a.stop + 0.1 >= s.start")
def timeline_overlap(spark, sf_dir):
    return timeline.overlaps(segments(spark, sf_dir), odd_events(spark, sf_dir)).select("media_id", "seg_idx", "label", "a_start")


def _reports_sql(corrected: bool) -> str:
    """CTEs down to r: (media_id, summary, pii_redactions, anomaly_events, total_segments, display_text, parts of the full report)."""
    fixed = f"CASE WHEN confidence < 0.75 THEN {chinese.corrected_sql('text')} ELSE text END" if corrected else "text"
    key = "media_id, seg_idx"
    return f"""s AS MATERIALIZED ({SEGMENTS}), a AS MATERIALIZED ({ODD}), pers AS MATERIALIZED (SELECT media_id, seg_idx, category, {chinese.DIGITS} AS original FROM ({chinese.personal_sql('SELECT * FROM s', key)})),
    orig AS (SELECT media_id, list(DISTINCT original) AS originals FROM pers GROUP BY media_id),
    fix AS MATERIALIZED (SELECT s.* EXCLUDE (text), text AS before, {fixed} AS text FROM s), red AS ({chinese.redacted_sql('SELECT * FROM fix', key)}),
    lab AS (SELECT media_id, seg_idx, list(label ORDER BY t, label) AS labels FROM (SELECT s.media_id, s.seg_idx, label, min(a.start) AS t FROM s JOIN a ON s.media_id = a.media_id AND s.stop + 0.1 >= a.start AND a.stop + 0.1 >= s.start WHERE a.confidence >= 0.3 GROUP BY ALL) GROUP BY ALL),
    line AS (SELECT fix.media_id, fix.seg_idx, concat_ws(' ', printf('[%.2fs → %.2fs]', start, stop), nullif(concat_ws(' ', CASE WHEN contains(fix.text, '{L.REDACTED}') OR list_bool_or(list_transform(originals, lambda o: contains(fix.text, o))) THEN '{L.REDACTED}' END,
        CASE WHEN before <> fix.text THEN '{L.CORRECTED_LABEL}' END, array_to_string(labels, ' ')), ''), redacted) AS line
        FROM fix JOIN red USING (media_id, seg_idx) LEFT JOIN orig ON orig.media_id = fix.media_id LEFT JOIN lab ON lab.media_id = fix.media_id AND lab.seg_idx = fix.seg_idx),
    shown AS (SELECT media_id, string_agg(line, chr(10) ORDER BY seg_idx) AS display_text, count(*) AS total_segments FROM line GROUP BY media_id),
    cnt AS (SELECT media_id, label, count(*) AS n, min(start) AS t FROM a WHERE confidence >= 0.3 GROUP BY ALL),
    x AS (SELECT media_id, string_agg(label || ' ' || n || ' 次', '、' ORDER BY t, label) AS said, string_agg('      - ' || label || '：' || n || ' 次', chr(10) ORDER BY t, label) AS counted FROM cnt GROUP BY media_id),
    pn AS (SELECT media_id, count(*) AS pii_redactions FROM pers GROUP BY media_id), an AS (SELECT media_id, count(*) AS anomaly_events FROM a GROUP BY media_id),
    r AS (SELECT media_id, coalesce(pii_redactions, 0) AS pii_redactions, coalesce(anomaly_events, 0) AS anomaly_events, total_segments, display_text, counted,
        concat_ws('；', CASE WHEN pii_redactions > 0 THEN '检测到 ' || pii_redactions || ' 处敏感信息（已脱敏）' ELSE '未检测到敏感信息' END, CASE WHEN said IS NULL THEN '音频特征正常' ELSE '音频异常：' || said END, '共 ' || total_segments || ' 个转写片段') AS summary
        FROM shown LEFT JOIN pn USING (media_id) LEFT JOIN an USING (media_id) LEFT JOIN x USING (media_id))"""


@query(f"WITH {_reports_sql(False)} SELECT media_id, summary, pii_redactions, anomaly_events, total_segments, md5(display_text) AS display_digest FROM r")
def fusion_reports(spark, sf_dir):
    rows = segments(spark, sf_dir)
    return timeline.reports(rows, odd_events(spark, sf_dir), None, rows).select("media_id", "summary", "pii_redactions", "anomaly_events", "total_segments", F.md5("display_text").alias("display_digest"))


@query(f"WITH {_reports_sql(False)} SELECT media_id, summary FROM r")
def fusion_summary(spark, sf_dir):
    return timeline.reports(segments(spark, sf_dir), odd_events(spark, sf_dir)).select("media_id", "summary")


@query(f"WITH {_reports_sql(True)} SELECT media_id, summary, md5(display_text) AS display_digest FROM r")
def audit_reports(spark, sf_dir):
    return analysis.audit(segments(spark, sf_dir), odd_events(spark, sf_dir), correct=True).select("media_id", "summary", F.md5("display_text").alias("display_digest"))


def _full_sql() -> str:
    rule, thick, nl = "repeat('─', 60)", "repeat('=', 60)", "chr(10)"
    section = lambda title, *body: f"concat_ws({nl}, {rule}, '{title}', {rule}, {', '.join(body)}, '')"
    return f"""WITH {_reports_sql(False)}, det AS (SELECT media_id, string_agg(d, {nl} ORDER BY d) AS details FROM (SELECT DISTINCT media_id, '  · 类型：' || category || '  |  原文：' || original AS d FROM pers) GROUP BY media_id),
    rec AS (SELECT media_id, string_agg(d, {nl} ORDER BY start, d) AS records FROM (SELECT media_id, start, '  · ' || label || '  |  时间：' || printf('%.2fs – %.2fs', start, stop) || '  |  置信度：' || CAST(round(confidence * 100) AS INT) || '%' AS d FROM a) GROUP BY media_id),
    f AS (SELECT media_id, concat_ws({nl}, {thick}, '        ASR 安全审计报告  (ASR Security Audit Report)', {thick}, '生成时间：2026-01-01 00:00:00', '', {section('一、转写结果（原文）', "'（无）'")}, {section('二、转写结果（脱敏后）', 'display_text')}, {section('三、安全审计摘要', 'summary')},
        {section('五、详细统计', "'  · 转写片段总数：' || total_segments", "'  · 隐私信息泄露点：' || pii_redactions || ' 处'", "'  · 音频异常事件：' || anomaly_events || ' 个'", 'counted')},
        CASE WHEN details IS NOT NULL THEN {section('六、脱敏详情', 'details')} END, CASE WHEN records IS NOT NULL THEN {section('七、音频异常记录', 'records')} END, {thick}, '报告完毕。', {thick}) AS report FROM r LEFT JOIN det USING (media_id) LEFT JOIN rec USING (media_id))
    SELECT media_id, md5(report) AS digest, CAST(len(report) AS INT) AS n FROM f"""


@query(_full_sql())
def full_reports(spark, sf_dir):
    rows, odd = segments(spark, sf_dir), odd_events(spark, sf_dir)
    text = timeline.full_report(timeline.reports(rows, odd), timeline.redactions(rows), odd, "2026-01-01 00:00:00")
    return text.select("media_id", F.md5("report").alias("digest"), F.length("report").alias("n"))


# ---------------------------------------------------------------- signals


@query("SELECT event_id, user_id, round(mean, 6) AS mean FROM (SELECT event_id, user_id, avg(value) OVER w AS mean, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5")
def rolling_mean(spark, sf_dir):
    rows = signal.rolling_mean(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 5)
    return rows.select("event_id", "user_id", F.round("mean", 6).alias("mean"))


@query("""WITH n AS (SELECT user_id, row_number() OVER w - 1 AS r, value > 50 AS i, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(r) AS first_row, max(r) AS last_row, count(*) AS length FROM n WHERE i GROUP BY user_id, g""")
def islands(spark, sf_dir):
    rows = signal.islands(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], F.col("value") > 50)
    return rows.select("user_id", F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"), "length")


def waves(spark, sf_dir) -> DataFrame:
    """Each user's values, in order of time, as a whole wave around their middle; a user is one row, however many events."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    wave = F.flatten(F.array_repeat(F.transform("x", lambda r: (r["value"] - 50) / 100), 120))
    return spread(rows).select(F.col("user_id").cast("string").alias("media_id"), F.lit(16_000).alias("sr"), wave.cast("array<float>").alias("samples"))


@query("""WITH w AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS media_id, flatten(list_transform(range(120), lambda i: x)) AS x FROM (SELECT user_id, list(CAST(CAST((value - 50) / 100 AS FLOAT) AS DOUBLE) ORDER BY ts, event_id, value) AS x FROM events GROUP BY user_id)),
f AS (SELECT media_id, unnest(range(0, len(x) - 256, 128)) AS s, x FROM w WHERE len(x) > 256), g AS MATERIALIZED (SELECT media_id, list_slice(x, s + 1, s + 256) AS y FROM f),
m AS (SELECT media_id, list_sum(list_transform(range(1, 256), lambda i: abs(sign(y[i + 1]) - sign(y[i])))) / 255 / 2 AS zcr, sqrt(list_avg(list_transform(y, lambda v: v * v))) AS rms_energy FROM g)
SELECT media_id, 'zcr' AS feature, count(*) AS frames, round(avg(zcr), 6) AS mean FROM m GROUP BY media_id UNION ALL SELECT media_id, 'rms_energy', count(*), round(avg(rms_energy), 6) FROM m GROUP BY media_id""")
def wave_time_features(spark, sf_dir):
    """Zero crossings and energy of every frame; the spectral features are tested on their own."""
    rows = pieced.features(wave_segments(spark, sf_dir), kinds=("zcr", "rms_energy"))
    return rows.groupBy("media_id", "feature").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("value"), 6).alias("mean"))


def wave_segments(spark, sf_dir) -> DataFrame:
    """The same waves as segments: no task holds all events of a user."""
    rows = pieced.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id", "value"])
    events = rows.select(F.col("user_id").cast("string").alias("media_id"), F.lit(16_000).alias("sr"), F.col("_rows").alias("total"), F.col("_row").alias("s"), ((F.col("value") - 50) / 100).alias("value"))
    again = pieced.segments(events).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(119))))
    return again.select("media_id", "sr", (F.col("total") * 120).alias("total"), (F.col("s") + F.col("time") * F.col("total")).alias("s"), "samples")


WAVES = "SELECT CAST(user_id AS VARCHAR) AS media_id, flatten(list_transform(range(120), lambda i: x)) AS x FROM (SELECT user_id, list(CAST(CAST((value - 50) / 100 AS FLOAT) AS DOUBLE) ORDER BY ts, event_id, value) AS x FROM events GROUP BY user_id)"
#: (media_id, n, i, zcr, rms) and (media_id, n, i, centroid, entropy) of every frame: the spectra by direct sums over a table of cosines.
FRAMES = f"""w AS MATERIALIZED (SELECT media_id, x, len(x) AS n FROM ({WAVES})), short AS (SELECT media_id, n, i, list_slice(x, i * 128 + 1, i * 128 + 256) AS y FROM (SELECT *, unnest(range(0, ((n - 256 + 127) // 128))) AS i FROM w WHERE n > 256)),
times AS MATERIALIZED (SELECT media_id, n, i, list_sum(list_transform(range(1, 256), lambda j: abs(sign(y[j + 1]) - sign(y[j])))) / 255 / 2 AS zcr, sqrt(list_avg(list_transform(y, lambda v: v * v))) AS rms FROM short),
win AS MATERIALIZED (SELECT list_transform(range(1024), lambda j: CASE WHEN j < 128 THEN 0.5 * (1 + cos(pi() * (j / 128.0 - 1))) WHEN 1024 - j < 128 THEN 0.5 * (1 + cos(pi() * ((1024 - j) / 128.0 - 1))) ELSE 1.0 END) AS h),
long AS MATERIALIZED (SELECT media_id, n, i, list_transform(range(1, 1025), lambda j: x[i * 512 + j] * h[j]) AS y FROM (SELECT *, unnest(range(0, (n - 1024) // 512 + 1)) AS i FROM w WHERE n >= 1024), win),
wave AS MATERIALIZED (SELECT f, list_transform(range(1024), lambda j: cos(2 * pi() * ((f * j) % 1024) / 1024)) AS c, list_transform(range(1024), lambda j: sin(2 * pi() * ((f * j) % 1024) / 1024)) AS s FROM range(513) t(f)),
power AS (SELECT media_id, n, i, f * 16000.0 / 1024 AS hz, (list_dot_product(y, c) ** 2 + list_dot_product(y, s) ** 2) * CASE WHEN f IN (0, 512) THEN 1 ELSE 2 END / (16000 * list_dot_product(h, h)) AS p FROM long, wave, win),
spectra AS MATERIALIZED (SELECT media_id, n, i, sum(hz * p) / greatest(sum(p), 1e-10) AS centroid, -(sum(greatest(p, 1e-10) * log2(greatest(p, 1e-10))) / sum(greatest(p, 1e-10)) - log2(sum(greatest(p, 1e-10)))) AS entropy FROM power GROUP BY ALL)"""


@query(f"""WITH {FRAMES}, told AS (SELECT media_id, unnest([{{'feature': 'zcr', 'value': zcr}}, {{'feature': 'rms_energy', 'value': rms}}]) AS t FROM times UNION ALL SELECT media_id, unnest([{{'feature': 'spectral_centroid', 'value': centroid}}, {{'feature': 'spectral_entropy', 'value': entropy}}]) FROM spectra)
SELECT media_id, t.feature AS feature, count(*) AS frames, round(avg(t.value), 4) AS mean FROM told GROUP BY ALL""")
def wave_features(spark, sf_dir):
    return pieced.features(wave_segments(spark, sf_dir)).groupBy("media_id", "feature").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("value"), 4).alias("mean"))


def _stretches(track: str, value: str, hop: int, length: int, level: float, label: str, strength: str) -> str:
    width = int(0.5 * 16000 / hop)
    return f"""SELECT media_id, '{label}' AS label, round((min(i) * {hop} + {length // 2} + {(width - 1) * hop / 2}) / 16000, 4) AS start, round((least(max(i) + 1, any_value(most)) * {hop} + {length // 2} + {(width - 1) * hop / 2}) / 16000, 4) AS "end", round(least({strength.format('avg(v)')}, 1.0), 4) AS confidence
    FROM (SELECT *, i - row_number() OVER (PARTITION BY media_id ORDER BY i) AS island FROM (SELECT media_id, n, i, max(i) OVER (PARTITION BY media_id) - {width - 1} AS most, avg({value}) OVER ahead AS v, count(*) OVER ahead AS k FROM {track} WINDOW ahead AS (PARTITION BY media_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE k = {width} AND v > {level} AND n > 512)
    GROUP BY media_id, island HAVING (least(max(i) + 1, any_value(most)) - min(i)) * {hop} / 16000.0 >= {signal.SHORTEST}"""


@query(f"WITH {FRAMES} {_stretches('times', 'zcr', 128, 512, signal.NOISE_LEVEL, L.NOISE_LABEL, '{} / 0.6')} UNION ALL {_stretches('spectra', 'entropy', 512, 1024, signal.ENTROPY_LEVEL, L.SYNTHETIC_LABEL, '({} - 8.5) / 4.25')}")
def wave_anomalies(spark, sf_dir):
    found = pieced.anomalies(wave_segments(spark, sf_dir), 16_000)
    return found.select("media_id", "label", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("confidence", 4).alias("confidence"))


# ---------------------------------------------------------------- whole analyses


def posts(spark, sf_dir) -> DataFrame:
    """The news made from the orders, stored: every module would make its texts again."""
    return scratch.stored(chinese.news(spark, sf_dir).withColumnRenamed("o_orderkey", "doc_id"), "posts")


@query()
def analyse_posts(spark, sf_dir):
    """All modules that need no fitted models, over the news made from the orders; analyse_trained has the others too."""
    o = analysis.Options(keyword_method="textrank", keywords=3, people=phrases.PEOPLE, places=phrases.PLACES, organisations=phrases.ORGANISATIONS, categories=(("价格", ("售价", "涨幅")), ("案件", ("涉案",))))
    rows = analysis.analyse(posts(spark, sf_dir), analysis.MODULES, o)
    return analysis.post_report(rows).select("doc_id", F.md5("report").alias("digest"))


@query()
def analyse_trained(spark, sf_dir):
    """Models fitted on a fifth of the news, saved and loaded; all modules over all of it, topics and trained labels included."""
    o = analysis.Options(keywords=3, people=phrases.PEOPLE, places=phrases.PLACES, organisations=phrases.ORGANISATIONS, categories=(("价格", ("售价", "涨幅")), ("案件", ("涉案",))))
    rows = posts(spark, sf_dir)
    where = scratch.place(spark, "models")
    models.save(analysis.fit_models(rows.where("doc_id % 5 = 0"), o, sweeps=50), where)
    analysed = analysis.analyse(rows, analysis.MODULES, o, models=models.load(spark, where))
    return analysis.post_report(analysed).select("doc_id", F.md5("report").alias("digest"))
