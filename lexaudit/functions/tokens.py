"""Tokenizers and token filters as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .binding import let
from .kernels import lexicon, over_list, over_text

LATIN = r"[\p{L}\p{N}]+"


def latin_tokens(text: Column, lower: bool = True) -> Column:
    """Runs of letters and digits."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(f"({LATIN})"), F.lit(1))


def lexicon_tokens(text: Column, words: Iterable[str]) -> Column:
    """The longest word of a list that fits, else a run of Latin letters and digits, else one character; for
    text without spaces between words."""
    listed = tuple(sorted(set(words)))
    return over_text(lambda t: lexicon(listed).cut(t), "array<string>", pa.list_(pa.string()))(text)


def lexicon_tokens_each(texts: Column, words: Iterable[str]) -> Column:
    """lexicon_tokens of each text of an array."""
    known = tuple(sorted(set(words)))
    return over_list(lambda each: [lexicon(known).cut(t or "") for t in each], "array<array<string>>", pa.list_(pa.list_(pa.string())))(texts)


def sentiment_words() -> set[str]:
    """The words that the sentiment operators know."""
    grouped = [w for g in (*L.EMOTIONS.values(), *L.ASPECTS.values()) for w in g]
    return {*L.POSITIVE, *L.NEGATIVE, *L.DEGREE, *L.NEGATION, *grouped}


def keep_content(tokens: Column, stopwords: Iterable[str] = L.STOPWORDS) -> Column:
    """Drops stopwords, tokens of digits and marks only, and single characters but ideographs."""
    listed = list(stopwords)

    def keep(t: Column) -> Column:
        good = (t != "") & ~t.rlike(L.DROPPED_TOKEN_PATTERN) & ((F.length(t) >= 2) | t.rlike(r"^[\x{4e00}-\x{9fff}]$"))
        return good & ~t.isin(*listed) if listed else good

    return F.filter(F.transform(tokens, lambda t: F.trim(t)), keep)


def drop_repeats(tokens: Column) -> Column:
    """A token equal to the one before it goes."""
    return let(tokens, lambda all_: F.filter(all_, lambda t, i: (i == 0) | (t != F.get(all_, i - 1))))


def without_repeats(tokens: Column) -> Column:
    """drop_repeats() as a kernel, for tokens that other kernels read in the same row."""
    kept = lambda said: [t for before, t in zip([None, *said], said, strict=False) if t != before]
    return over_list(kept, "array<string>", pa.list_(pa.string()))(tokens)


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def split_sentences(text: Column, least: int = 4, ideographs: bool = True) -> Column:
    """Sentences by full stops, question and exclamation marks of Chinese text, line ends and semicolons.

    least: characters of a sentence that is kept. ideographs: only sentences with a Chinese character
    are kept; without it, . ! ? before a blank end a sentence too.
    """
    ends = r"[。！？\n；;]+" if ideographs else r"[。！？\n；;]+|(?<=[.!?])\s+"
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ends), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) >= least) & (s.rlike(r"[\x{4e00}-\x{9fff}]") if ideographs else F.lit(True)))


CLAUSE_ENDS = r"[。！？?；;，,\n]+"


def split_clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE_ENDS), lambda c: F.trim(c)), lambda c: c != "")
