"""The row-local modules on streams, and the few operators that need state there."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..plans.analysis import Options, row_modules


def analyse_stream(posts: DataFrame, modules: Iterable[str], o: Options = Options(), text_col: str = "text") -> DataFrame:
    """The same columns as in a batch: nothing but the row is needed."""
    return row_modules(posts, modules, o, text_col)


def drop_copies(posts: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """One of all posts with the same fingerprint within the watermark's delay."""
    return posts.withColumn("fingerprint", cleaning.fingerprint(F.coalesce(text_col, F.lit("")))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def counts(rows: DataFrame, time_col: str, by: Column | str, length: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(window, key, n) in tumbling or sliding windows; later rows than the delay are left out."""
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    key = F.col(by) if isinstance(by, str) else by
    return rows.withWatermark(time_col, delay).groupBy(window.alias("window"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def bursts(rows: DataFrame, time_col: str, key: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(session, key, n): runs of rows of a key without a gap of that length."""
    return rows.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"))


def report_batches(stream: DataFrame, report, sink, checkpoint: str):
    """Starts a query that gives each micro-batch to report and its frame, with the batch's number, to sink."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: sink(report(batch), number)).start()
