"""Recordings: what is wrong with a file, and its samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "wma")
VIDEO = ("mp4", "avi", "mov", "mkv", "flv", "wmv", "webm", "m4v")
LEAST_BYTES, MOST_SECONDS = 64, 300.0


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_video(path: Column) -> Column:
    return suffix(path).isin(*VIDEO)


def fault(path: Column, length: Column) -> Column:
    """Why a file cannot be used, or null."""
    return F.when(~suffix(path).isin(*AUDIO, *VIDEO), "unsupported format").when(length == 0, "empty file").when(length < LEAST_BYTES, "file too small")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, length, error, content) of the files under a path; content is null where there is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("media_id"), "length", "content")
    rows = files.withColumn("error", fault(F.col("media_id"), F.col("length")))
    return rows.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a PCM WAV file."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2147483648
    else:
        raise ValueError(f"{8 * width}-bit samples")
    return rate, x.reshape(-1, channels).mean(axis=1)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """By linear interpolation."""
    if rate == target or not len(x):
        return x
    n = int(round(len(x) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x).astype(np.float32)


def load(files: DataFrame, rate: int = 16_000, most_seconds: float = MOST_SECONDS) -> DataFrame:
    """(media_id, sr, samples, seconds, error): mono samples at one rate. Only PCM WAV can be decoded here; others get an error."""
    rows = files.select("media_id", "content", "error")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for media, content, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                samples, seconds = None, None
                if error is None:
                    try:
                        own, x = decode_wav(content)
                        seconds = len(x) / own
                        if seconds > most_seconds:
                            error = f"longer than {most_seconds:g} seconds"
                        else:
                            samples = resample(x, own, rate).tolist()
                    except (wave.Error, EOFError, ValueError) as e:
                        error = f"cannot be decoded: {e}"
                for column, v in zip(out, (media, rate, samples, seconds, error), strict=True):
                    column.append(v)
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float32()), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["media_id", "sr", "samples", "seconds", "error"])

    return rows.mapInArrow(work, "media_id string, sr int, samples array<float>, seconds double, error string")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, seg_idx, start, end, text, confidence) of a recogniser's JSON lines with avg_logprob."""
    from ..functions.transcripts import confidence

    rows = spark.read.schema("media_id string, seg_idx int, start double, end double, text string, avg_logprob double").json(path)
    return rows.select("media_id", "seg_idx", "start", "end", F.trim(F.coalesce("text", F.lit(""))).alias("text"), confidence(F.col("avg_logprob")).alias("confidence"))
