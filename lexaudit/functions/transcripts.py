"""Rule corrections and notes on transcripts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def correct(text: Column, homophones: dict[str, str] = L.HOMOPHONES) -> Column:
    """Every homophone replaced in turn, then punctuation to blanks, blanks squeezed and a full stop at the end."""
    text = F.coalesce(text, F.lit(""))
    for wrong, right in homophones.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    for pattern, to in L.CORRECTIONS:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def corrected(text: Column, confidence: Column, threshold: float | None = None) -> Column:
    """Struct (text, original_text, corrections). With a threshold, segments of at least that confidence stay as they are."""
    fixed = correct(text) if threshold is None else F.when(confidence >= threshold, text).otherwise(correct(text))
    note = F.concat(F.lit("规则修正: '"), text, F.lit("' -> '"), fixed, F.lit("'"))
    return F.struct(fixed.alias("text"), text.alias("original_text"), F.when(fixed != text, F.array(note)).otherwise(F.array().cast("array<string>")).alias("corrections"))


def security_summary(text: Column) -> Column:
    """One sentence on hints of personal data and of odd sound in a transcript."""
    text = F.coalesce(text, F.lit(""))
    any_of = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0)) > 0
    plain = F.when(F.length(text) > 200, "转写内容正常，未发现明显安全问题").otherwise("音频内容正常，未检测到明显异常")
    said = F.concat_ws("；", F.when(any_of(L.PII_HINTS), "检测到敏感信息暴露风险"), F.when(any_of(L.ANOMALY_HINTS), "音频存在异常特征"))
    return F.when(said == "", plain).otherwise(said)


def confidence(avg_logprob: Column) -> Column:
    """A segment's confidence from its mean log probability; a missing one counts as -1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(F.coalesce(avg_logprob, F.lit(-1.0)))))


def confidence_bucket(value: Column) -> Column:
    return F.when(value < 0.5, "low").when(value < 0.75, "middle").otherwise("high")
