"""A corpus pipeline of the operators in lexaudit.llm: each stage works on all that the one before kept.

run(spark, sf_dir) applies STAGES to the table documents; each result is written to the shared folder
and read again as the next one's documents. All stages but the last return the columns of documents,
whatever further columns there are and however they are called: the operators' own columns never
stand beside them. A null in any column, an empty or very long text, repeated rows and an empty table
are handled as the operators say. A stage leaves a table of its decisions in the shared folder, which
its result reads; run() deletes it, and each stage's documents, once the next stage has read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm import bpe, language, mixing, neardup, queries, substrings
from lexaudit.llm.base import discard, quoted, scope, sent_if_small, stored, table

#: Below this probability of its most likely language, or without any letter, a document goes.
LEAST_CONFIDENCE = 0.5
#: As the contract of near duplicates has them.
SHINGLE_WORDS, SIMILAR_PERCENT = 2, 80
#: The budget of the mix, as a share of all tokens that reach it.
MIX_FRACTION = 0.8
#: UTF-8 bytes of text in a block of the encoder: by the last stage executors hold much already, and small blocks take less of their
#: memory for more disk (op2 takes the larger ones of lexaudit.llm.bpe).
BLOCK_BYTES = 4 << 20
#: A fitted model and a tokenizer cannot be written in SQL; the tests use brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no clear language. The model is fitted on the rows with a language."""
    model = language.fit(docs, F.lit(True))
    keep = [f"c{i}" for i in range(len(docs.columns))]
    judged = language.predict(docs.toDF(*keep), model, keep, keep[docs.columns.index("text")])
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE))
    return kept.select(*keep).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the smallest doc_id; rows without a doc_id stay."""
    with scope(spark) as s:
        gone = neardup.groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("not kept").select("doc_id").distinct()
        gone = s.keep(stored(gone, "gone"))
    return docs.join(sent_if_small(gone), "doc_id", "left_anti").select(*quoted(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id holds; a document of which nothing is left goes.

    A cut document's words are joined by single spaces and n_chars, if there is such a column, counts
    what is left; others stay as they are.
    """
    with scope(spark) as s:
        cut = substrings.repeats(docs).where("n_removed > 0").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "kept")
        cut = s.keep(stored(cut, "cut"))
    changed = sent_if_small(cut.select("doc_id", "text_key"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.struct(*quoted(*docs.columns)).alias("doc"))
    same = rows.join(changed, ["doc_id", "text_key"], "left_anti").select("doc")
    doc = F.col("doc").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    new = rows.join(cut.where("kept <> ''"), ["doc_id", "text_key"]).select(doc.alias("doc"))
    return same.unionByName(new).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the domain-language-source tree's budgets choose, in one epoch."""
    plan, _ = mixing.plan_mix(docs, queries.mix_domain(), queries.mix_weight, MIX_FRACTION, seed=7, epochs=1)
    return mixing.select_mix(docs, queries.mix_domain(), plan, seed=7).select("doc.*")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, queries.tokenizer_path(), block_bytes=BLOCK_BYTES)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope(spark) as s:
            before, docs = docs, s.keep(stored(stage(spark, docs, sf_dir), name))
        discard(before)
    return docs
