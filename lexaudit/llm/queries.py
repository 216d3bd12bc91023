"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, divergence, language, mixing, neardup, negatives, oracles, quality, reputation, sharding, substrings, topk, toxicity
from .base import table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_path() -> str:
    """Where the vocabulary of the queries lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def _fold(folds: int, fold: int):
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(5, 0))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), _fold(3, 1))


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    distances = ("class_distance", "word_distance")
    found = divergence.judge(table(spark, sf_dir, "documents"))
    return found.select(*(F.round(c, 6).alias(c) if c in distances else c for c in found.columns))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24)


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page's outcome is that of the document whose number its path holds: bad if low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    number = F.regexp_extract(reputation.url_path(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labelled = pages.withColumn("doc_id", F.when(number != "", number.cast("long"))).join(labels, "doc_id").select("url", bad.alias("bad"))
    return reputation.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


MIX_DOMAINS = {"forum": 0.6, "press": 0.4}
MIX_LANGS = {"en": 0.4, "fr": 0.25, "de": 0.25, "es": 0.1}


def mix_weight(path: tuple[str, ...]) -> float:
    """Sources weigh alike in their language; languages and domains without a target weigh nothing."""
    return (MIX_DOMAINS.get(path[0], 0), MIX_LANGS.get(path[1], 0) if len(path) > 1 else 0, 1)[len(path) - 1]


def mix_domain():
    """Sources with an odd number are press, all others forum."""
    return F.when(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9])$", 1).isin("1", "3", "5", "7", "9"), "press").otherwise("forum")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, tokens and epoch of what is chosen: half of all tokens, two epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    plan, _ = mixing.plan_mix(docs, mix_domain(), mix_weight, 0.5, seed=7, epochs=2)
    chosen = mixing.select_mix(docs, mix_domain(), plan, seed=7)
    return chosen.select("doc.doc_id", "leaf.domain", "leaf.lang", "leaf.source", mixing.tokens_of(F.col("doc.text")).alias("tokens"), "epoch")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id 7 divides count as of the next label, so that some labels are wrong."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(5, 0))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.summaries(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe, op3_language, op4_divergence, op5_shards, op6_url_reputation, op7_topk, op8_substrings, op9_mix, op10_neardup, op11_negatives, op12_toxicity, op13_alignment, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_divergence": oracles.divergence(),
        "op5_shards": oracles.shards(),
        "op6_url_reputation": oracles.url_reputation(URL_RULES),
        "op7_topk": oracles.top_k(),
        "op8_substrings": oracles.substrings(),
        "op9_mix": oracles.mix(MIX_DOMAINS, MIX_LANGS, 0.5, 2, 7),
        "op10_neardup": oracles.near_duplicates(),
        "op11_negatives": oracles.negatives(),
    }
