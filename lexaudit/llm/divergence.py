"""Quality rules: how far a text's histograms of character classes and common words are from any language's.

DataFrame functions only. A text is compared with each reference language by the Jensen-Shannon
distance (base 2, 0 to 1) of both histograms. All words that are not common share one bin, so a long
text with few common words is far from every language. A text of too few characters or words is not
judged by that histogram. References are the sums over all documents of a language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

SPACE = r"\x20\x09-\x0D"

#: Common words by language. Fixed values.
COMMON = {
    "de": ("auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"),
    "en": ("a", "and", "are", "as", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"),
    "es": ("al", "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"),
    "fr": ("au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
}
WORDS = tuple(sorted({w for words in COMMON.values() for w in words}))
#: Character classes: letters but capitals, capitals, digits, white space, symbols, other marks.
CLASSES = ("small", "capital", "digit", "space", "symbol", "mark")


@dataclass(frozen=True)
class Limits:
    least_words: int = 10
    most_repeated_percent: int = 20
    #: Guards: below so many characters or words, the histogram is not judged.
    least_characters: int = 300
    least_length: int = 100
    #: The largest distance from the nearest language that is kept.
    class_distance: float = 0.22
    #: A text without any common word is at about 0.34.
    word_distance: float = 0.26


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and commons (counts), and the sums of these."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace("text", f"[^{pattern}]+", ""))
    rows = docs.select(F.col(id_col).alias("id"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang"), text.alias("text"))
    rows = rows.select(
        "id", "lang", "text", F.regexp_extract_all("text", F.lit(f"([^{SPACE}]+)"), F.lit(1)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    five = lambda h, i: F.xxhash64(h, *(F.get("hashes", i + d) for d in range(1, 5)))
    starts = F.when(F.size("words") >= 5, F.transform(F.slice("hashes", F.lit(1), F.size("words") - 4), five))
    common = F.filter("words", lambda w: F.lower(w).isin(*WORDS))
    rows = rows.select(
        "id", "lang", F.size("words").cast("long").alias("n_words"), F.length("text").alias("length"),
        count(rf"{SPACE}").alias("space"), count(r"\p{L}").alias("letter"), count(r"\p{Lu}").alias("capital"), count(r"\p{Nd}").alias("digit"),
        count(r"#*$%&|<>").cast("long").alias("n_symbols"), count(r"!@^~_=+\\/\[\]{}").alias("odd"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), starts.alias("starts"),
        F.size(common).cast("long").alias("n_common"), F.concat(F.lit("|"), F.array_join(F.transform(common, F.lower), "||"), F.lit("|")).alias("common"),
    )
    twice = F.size(F.array_distinct("starts")) < F.size("starts")
    in_order = F.when(twice, F.sort_array(F.transform("starts", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("ordered", in_order).drop("starts")
    alike = lambda x, i: (F.get("ordered", i - 1)["h"] == x["h"]) | (F.get("ordered", i + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("ordered", lambda x, i: F.coalesce(alike(x, i), F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("places", places).drop("ordered")
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("places", start, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(5), x - acc["last"])).alias("n")), lambda acc: acc["n"])
    symbol = F.col("n_symbols") + F.col("odd")
    classes = F.array(*(x.cast("long") for x in (F.col("letter") - F.col("capital"), F.col("capital"), F.col("digit"), F.col("space"), symbol, F.col("length") - F.col("letter") - F.col("digit") - F.col("space") - symbol)))
    # each common word stands between bars; taking it out tells how often it was there
    times = lambda w: ((F.length("common") - F.length(F.replace(F.col("common"), F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("long")
    commons = F.array(*map(times, WORDS), F.col("n_words") - F.col("n_common"))
    return rows.select(
        "id", "lang", "n_words", (F.col("length") - F.col("space")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), classes.alias("classes"), commons.alias("commons"),
        F.col("length").cast("long").alias("n_class"),
    )


def _information(p: Column) -> Column:
    """The sum of -p log2 p over an array."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a histogram, whose sum is given, from a reference; null if either is empty."""
    whole = sum(reference)
    if not whole:
        return F.lit(None).cast("double")
    other = F.array(*(F.lit(x / whole) for x in reference))
    own = -sum(x / whole * math.log2(x / whole) for x in reference if x)
    between = _information(F.zip_with(counts, other, lambda c, q: (c / total + q) / 2))
    divergence = between - (_information(F.transform(counts, lambda c: c / total)) + own) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance.

    n_dup_lines counts lines with a word that equal an earlier one; n_repeat_words the words inside
    windows of five words that the text holds twice or more. base_failed: too few words, or too large
    a share of repeated ones. kept is false if base_failed or if the text is too far from every
    reference language in either histogram; a histogram under its guard passes. References are summed
    over the rows of each known language that pass the base rules; with no such rows, nothing is too
    far. A row whose language is told but has no reference is not judged by distance: common words are
    listed for four languages, and text in others is far from all of them. A null text is empty and fails. Repeated rows count each; a null id is carried along. An
    empty table gives an empty one; other columns are ignored.
    """
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeated_percent * F.col("n_words"))
    rows = stored(measures(docs, id_col, text_col, lang_col).withColumn("base_failed", failed), "measures")
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES)), ("commons", len(WORDS) + 1)) for i in range(n)]
    found = rows.where(F.col("lang").isin(*COMMON) & ~F.col("base_failed")).groupBy("lang").agg(*sums).orderBy("lang").collect()
    references = [([r[f"classes{i}"] for i in range(len(CLASSES))], [r[f"commons{i}"] for i in range(len(WORDS) + 1)]) for r in found]
    if references:
        near = F.array(*(F.struct(distance(F.col("commons"), F.col("n_words"), w).alias("w"), distance(F.col("classes"), F.col("n_class"), c).alias("c")) for c, w in references))
    else:
        near = F.array(F.struct(F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("c")))
    guard = lambda x, limit, enough: F.coalesce(x, F.lit(0.0)) / limit * F.when(enough, 1.0).otherwise(0.0)
    foreign = F.col("lang").isNotNull() & ~F.col("lang").isin(*(r.lang for r in found))
    rows = rows.withColumn("near", near).withColumn("many", F.col("n_class") >= limits.least_characters).withColumn("often", F.col("n_words") >= limits.least_length)
    over = F.array_min(F.transform("near", lambda x: F.greatest(guard(x["c"], limits.class_distance, F.col("many")), guard(x["w"], limits.word_distance, F.col("often")))))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (foreign | (over <= 1.0))).alias("kept"),
        F.array_min(F.transform("near", lambda x: x["c"])).alias("class_distance"), F.array_min(F.transform("near", lambda x: x["w"])).alias("word_distance"),
    )
