"""Segments, findings and anomalies on the timeline of a recording, and the report made of them.

segments: (media_id, seg_idx, start, end, text, confidence). redactions: (media_id, seg_idx, start, end,
category, original, redacted), offsets within a segment. anomalies: (media_id, start, end, label,
confidence). corrected: (media_id, start, text, corrections).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.binding import opened
from ..functions import pii


def overlaps(segments: DataFrame, anomalies: DataFrame, tolerance: float = 0.1, bucket: float = 10.0) -> DataFrame:
    """(media_id, seg_idx, label, a_start, a_confidence): closed intervals that meet within the tolerance.

    Both sides are dealt to time buckets and joined by equal ones, so the plan is an equi-join; a pair
    is taken in the first bucket that both lie in.
    """
    def dealt(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        return rows.withColumn("_first", F.floor(low / bucket)).withColumn("_b", F.explode(F.sequence(F.col("_first"), F.floor(high / bucket))))

    left = dealt(segments.select("media_id", "seg_idx", "start", "end"), F.col("start") - tolerance, F.col("end") + tolerance)
    right = dealt(anomalies.select("media_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "label", F.col("confidence").alias("a_confidence")), F.col("a_start"), F.col("a_end"))
    right = right.withColumnRenamed("_first", "_a_first")
    meets = (F.col("end") + tolerance >= F.col("a_start")) & (F.col("a_end") + tolerance >= F.col("start"))
    return left.join(right, ["media_id", "_b"]).where(meets & (F.col("_b") == F.greatest("_first", "_a_first"))).select("media_id", "seg_idx", "label", "a_start", "a_confidence")


def align(segments: DataFrame, corrected: DataFrame | None) -> DataFrame:
    """Segments with the corrected text of the same start, if any; is_corrected where corrections were made."""
    if corrected is None:
        return segments.withColumn("is_corrected", F.lit(False))
    order = F.col("seg_idx") if "seg_idx" in corrected.columns else F.lit(0)
    one = corrected.groupBy("media_id", "start").agg(F.max_by(F.struct(F.col("text").alias("new"), (F.size("corrections") > 0).alias("made")), order).alias("c"))
    return segments.join(one, ["media_id", "start"], "left").withColumn("text", F.coalesce("c.new", "text")).withColumn("is_corrected", F.coalesce("c.made", F.lit(False))).drop("c")


def redactions(segments: DataFrame) -> DataFrame:
    found = opened(segments, pii.records(F.col("text")), "r", "media_id", "seg_idx")
    return found.select("media_id", "seg_idx", "r.*")


def tagged(segments: DataFrame, redacted: DataFrame, anomalies: DataFrame, least: float = 0.3, tolerance: float = 0.1) -> DataFrame:
    """Segments (with is_corrected) and their tags: redacted, corrected, then anomalies in order of time, each label once."""
    originals = redacted.where("original <> ''").groupBy("media_id").agg(F.collect_set("original").alias("originals"))
    near = overlaps(segments, anomalies.where(F.col("confidence") >= least), tolerance)
    labels = near.groupBy("media_id", "seg_idx").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("a_start", "label"))), lambda x: x["label"])).alias("labels"))
    rows = segments.join(originals, "media_id", "left").join(labels, ["media_id", "seg_idx"], "left")
    private = F.col("text").contains(L.REDACTED) | F.coalesce(F.exists("originals", lambda o: F.col("text").contains(o)), F.lit(False))
    tags = F.concat(F.when(private, F.array(F.lit(L.REDACTED))).otherwise(F.array()), F.when(F.col("is_corrected"), F.array(F.lit(L.CORRECTED_LABEL))).otherwise(F.array()), F.coalesce("labels", F.array()))
    return rows.withColumn("tags", tags).drop("originals", "labels")


def display_line(row_start: Column, row_end: Column, tags: Column, text: Column) -> Column:
    stamp = F.format_string("[%.2fs → %.2fs]", row_start.cast("double"), row_end.cast("double"))
    return F.concat_ws(" ", stamp, F.when(F.size(tags) > 0, F.array_join(tags, " ")), text)


def summary(pii_count: Column, anomaly_counts: Column, total: Column) -> Column:
    """One sentence; anomaly_counts is an array of (label, n)."""
    said = F.array_join(F.transform(anomaly_counts, lambda x: F.concat(x["label"], F.lit(" "), x["n"].cast("string"), F.lit(" 次"))), "、")
    return F.concat_ws(
        "；",
        F.when(pii_count > 0, F.concat(F.lit("检测到 "), pii_count.cast("string"), F.lit(" 处敏感信息（已脱敏）"))).otherwise("未检测到敏感信息"),
        F.when(F.size(anomaly_counts) > 0, F.concat(F.lit("音频异常："), said)).otherwise("音频特征正常"),
        F.concat(F.lit("共 "), total.cast("string"), F.lit(" 个转写片段")),
    )


def reports(segments: DataFrame, anomalies: DataFrame, corrected: DataFrame | None = None, media: DataFrame | None = None, least: float = 0.3, tolerance: float = 0.1) -> DataFrame:
    """(media_id, summary, pii_redactions, anomaly_events, anomaly_counts, total_segments, display_text).

    Text is corrected first and redacted after, so that a correction cannot bring personal data back.
    media lists recordings that may have no segments; without it, those with segments are reported.
    """
    found = redactions(segments)
    aligned = align(segments, corrected)
    rows = tagged(aligned, found, anomalies, least, tolerance).withColumn("text", pii.redact(F.col("text")))
    lines = rows.select("media_id", "seg_idx", display_line(F.col("start"), F.col("end"), F.col("tags"), F.col("text")).alias("line"))
    shown = lines.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "line"))), lambda x: x["line"]), "\n").alias("display_text"), F.count(F.lit(1)).alias("total_segments"))
    private = found.groupBy("media_id").agg(F.count(F.lit(1)).alias("pii_redactions"))
    strong = anomalies.where(F.col("confidence") >= least).groupBy("media_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("t"))
    counts = strong.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "label", "n"))), lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))).alias("anomaly_counts"))
    events = anomalies.groupBy("media_id").agg(F.count(F.lit(1)).alias("anomaly_events"))
    every = media.select("media_id").distinct() if media is not None else segments.select("media_id").distinct()
    out = every.join(shown, "media_id", "left").join(private, "media_id", "left").join(counts, "media_id", "left").join(events, "media_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    no_counts = F.array().cast("array<struct<label:string,n:bigint>>")
    out = out.select("media_id", zero("pii_redactions").alias("pii_redactions"), zero("anomaly_events").alias("anomaly_events"), F.coalesce("anomaly_counts", no_counts).alias("anomaly_counts"), zero("total_segments").alias("total_segments"), F.coalesce("display_text", F.lit("（无转写结果）")).alias("display_text"))
    return out.select("media_id", summary(F.col("pii_redactions"), F.col("anomaly_counts"), F.col("total_segments")).alias("summary"), "pii_redactions", "anomaly_events", "anomaly_counts", "total_segments", "display_text")


def full_report(report: DataFrame, found: DataFrame, anomalies: DataFrame, generated_at: str, raw: DataFrame | None = None, assistant: DataFrame | None = None) -> DataFrame:
    """(media_id, report): the sections of an audit as one text. raw: (media_id, text) of the unredacted
    transcript, left out by default; assistant: (media_id, text) of another summary."""
    details = found.groupBy("media_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("  · 类型："), "category", F.lit("  |  原文："), "original"))).alias("details"))
    percent = F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    line = F.concat(F.lit("  · "), "label", F.lit("  |  时间："), F.format_string("%.2fs – %.2fs", F.col("start").cast("double"), F.col("end").cast("double")), F.lit("  |  置信度："), percent)
    records = anomalies.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))), lambda x: x["line"]).alias("records"))
    none = lambda: report.select("media_id", F.lit(None).cast("string").alias("text"))
    rows = report.join((raw if raw is not None else none()).select("media_id", F.col("text").alias("raw")), "media_id", "left")
    rows = rows.join((assistant if assistant is not None else none()).select("media_id", F.col("text").alias("said")), "media_id", "left").join(details, "media_id", "left").join(records, "media_id", "left")
    rule, thick = F.lit("─" * 60), F.lit("=" * 60)

    def section(title: str, *body: Column, when: Column | None = None) -> Column:
        whole = F.concat_ws("\n", rule, F.lit(title), rule, *body, F.lit(""))
        return whole if when is None else F.when(when, whole)

    counted = F.array_join(F.transform("anomaly_counts", lambda x: F.concat(F.lit("      - "), x["label"], F.lit("："), x["n"].cast("string"), F.lit(" 次"))), "\n")
    statistics = [
        F.concat(F.lit("  · 转写片段总数："), F.col("total_segments").cast("string")), F.concat(F.lit("  · 隐私信息泄露点："), F.col("pii_redactions").cast("string"), F.lit(" 处")),
        F.concat(F.lit("  · 音频异常事件："), F.col("anomaly_events").cast("string"), F.lit(" 个")), F.when(F.size("anomaly_counts") > 0, counted),
    ]
    text = F.concat_ws(
        "\n", thick, F.lit("        ASR 安全审计报告  (ASR Security Audit Report)"), thick, F.lit(f"生成时间：{generated_at}"), F.lit(""),
        section("一、转写结果（原文）", F.coalesce("raw", F.lit("（无）"))), section("二、转写结果（脱敏后）", F.col("display_text")), section("三、安全审计摘要", F.col("summary")),
        section("四、LLM 智能摘要（参考）", F.col("said"), when=F.col("said").isNotNull() & (F.col("said") != F.col("summary"))), section("五、详细统计", *statistics),
        section("六、脱敏详情", F.array_join("details", "\n"), when=F.col("details").isNotNull()), section("七、音频异常记录", F.array_join("records", "\n"), when=F.col("records").isNotNull()),
        thick, F.lit("报告完毕。"), thick,
    )
    return rows.select("media_id", text.alias("report"))
