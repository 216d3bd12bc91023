"""Signals: rolling means and runs over tables of samples, and acoustic features of waveforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L

FRAME, HOP, SPECTRUM = 256, 128, 1024
NOISE_LEVEL, ENTROPY_LEVEL, SHORTEST = 0.3, 8.5, 0.1


def rolling_mean(rows: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """rows with mean, the average of the last width values; only where there are so many."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("_n", F.count(value).over(w)).where(F.col("_n") == width).drop("_n")


def islands(rows: DataFrame, key: str, order: list[str], inside: Column, *sums: Column) -> DataFrame:
    """(key, first_row, last_row, length, ...sums): runs of consecutive rows where inside is true, numbered from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("_row", F.row_number().over(w) - 1).withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_outside", F.sum((~F.col("_in")).cast("long")).over(w))
    runs = numbered.where("_in").groupBy(key, "_outside")
    return runs.agg(F.min("_row").alias("first_row"), F.max("_row").alias("last_row"), F.count(F.lit(1)).alias("length"), *sums).drop("_outside")


# ---------------------------------------------------------------- waveforms


def _frames(wave: np.ndarray, length: int, hop: int) -> np.ndarray:
    """Frames that start before the last full one's start; none for a shorter wave."""
    starts = np.arange(0, len(wave) - length, hop)
    return np.lib.stride_tricks.sliding_window_view(wave, length)[starts] if len(starts) else np.zeros((0, length))


def zero_crossings(wave: np.ndarray, length: int = FRAME, hop: int = HOP) -> np.ndarray:
    return np.abs(np.diff(np.sign(_frames(wave, length, hop)), axis=1)).mean(axis=1) / 2


def energy(wave: np.ndarray, length: int = FRAME, hop: int = HOP) -> np.ndarray:
    return np.sqrt((_frames(wave, length, hop) ** 2).mean(axis=1))


def _tukey(length: int, share: float = 0.25) -> np.ndarray:
    """A periodic tapered cosine window."""
    n = np.arange(length)
    edge = share * length / 2
    low = np.where(n < edge, 0.5 * (1 + np.cos(np.pi * (n / edge - 1))), 1.0)
    back = length - n
    return np.where(back < edge, 0.5 * (1 + np.cos(np.pi * (back / edge - 1))), low)


def spectrum(wave: np.ndarray, rate: int, length: int = SPECTRUM, overlap: int = SPECTRUM // 2) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power (frames by frequencies) of overlapping tapered frames; a shorter wave is one frame."""
    length = min(length, len(wave))
    if not length:
        return np.zeros(0), np.zeros((0, 0))
    hop = max(length - min(overlap, length - 1), 1) if length < SPECTRUM else length - overlap
    starts = np.arange(0, len(wave) - length + 1, hop)
    window = _tukey(length)
    frames = np.lib.stride_tricks.sliding_window_view(wave, length)[starts] * window
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / (rate * (window**2).sum())
    power[:, 1 : -1 if length % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(length, 1 / rate), power


def centroid(wave: np.ndarray, rate: int) -> np.ndarray:
    frequencies, power = spectrum(wave, rate)
    return (power @ frequencies) / np.maximum(power.sum(axis=1), 1e-10) if power.size else np.zeros(0)


def entropy(wave: np.ndarray, rate: int) -> np.ndarray:
    return entropy_of(spectrum(wave, rate)[1])


def entropy_of(power: np.ndarray) -> np.ndarray:
    if not power.size:
        return np.zeros(0)
    power = np.maximum(power, 1e-10)
    p = power / power.sum(axis=1, keepdims=True)
    return -(p * np.log2(p)).sum(axis=1)


def subtract_noise(wave: np.ndarray, length: int = 512, hop: int = 128, frames: int = 30, floor: float = 0.002) -> np.ndarray:
    """Spectral subtraction: the median of the first frames is taken as noise; what is left keeps a floor."""
    if len(wave) < length:
        return wave
    window = np.hanning(length + 1)[:-1]
    starts = np.arange(0, len(wave) - length + 1, hop)
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wave, length)[starts] * window, axis=1)
    size = np.abs(spectra)
    cleaned = np.maximum(size - np.median(size[:frames], axis=0), floor * size)
    parts = np.fft.irfft(cleaned * np.exp(1j * np.angle(spectra)), length, axis=1) * window
    out, weight = np.zeros(len(wave)), np.zeros(len(wave))
    for s, part in zip(starts, parts, strict=True):
        out[s : s + length] += part
        weight[s : s + length] += window**2
    return out / np.maximum(weight, 1e-8)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges where the mask is true."""
    edges = np.diff(np.concatenate([[0], np.asarray(mask, dtype=np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def _smooth(track: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(track, np.ones(width) / width, mode="valid") if len(track) >= width else np.full(len(track), np.nan)


def anomalies(wave: np.ndarray, rate: int, noise: float = NOISE_LEVEL, synthetic: float = ENTROPY_LEVEL, compat: bool = False) -> list[tuple[float, float, str, float]]:
    """(start, end, label, confidence) of stretches with many zero crossings or high spectral entropy, smoothed over half a second.

    The entropy track has its own hop; compat smooths and times it with the other track's, as older results have it.
    """
    if len(wave) <= 2 * FRAME:
        return []
    out = []
    tracks = (
        (zero_crossings(wave), HOP, 2 * FRAME, noise, L.NOISE_LABEL, lambda v: v / (2 * noise)),
        (entropy(wave, rate), HOP if compat else SPECTRUM // 2, 2 * FRAME if compat else SPECTRUM, synthetic, L.SYNTHETIC_LABEL, lambda v: (v - synthetic) / (0.5 * synthetic)),
    )
    for track, hop, length, level, label, strength in tracks:
        width = max(1, int(0.5 * rate / hop))
        smooth = _smooth(track, width)
        if not len(smooth):
            continue
        times = (np.arange(len(smooth)) * hop + length // 2 + (width - 1) * hop / 2) / rate
        for a, b in runs(np.nan_to_num(smooth, nan=-np.inf) > level):
            start, end = float(times[a]), float(times[min(b, len(times) - 1)])
            if end - start >= SHORTEST:
                out.append((start, end, label, min(float(strength(np.nanmean(smooth[a:b]))), 1.0)))
    return sorted(out, key=lambda e: e[0])


def features(waves: DataFrame) -> DataFrame:
    """(media_id, feature, frame_idx, value) of waves (media_id, sr, samples)."""
    rows = waves.select("media_id", "sr", "samples")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, rate, samples in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                wave = np.array(samples or [], dtype=float)
                for name, track in (("zcr", zero_crossings(wave)), ("rms_energy", energy(wave)), ("spectral_centroid", centroid(wave, rate)), ("spectral_entropy", entropy(wave, rate))):
                    yield pa.RecordBatch.from_arrays([pa.array([media] * len(track), pa.string()), pa.array([name] * len(track), pa.string()), pa.array(np.arange(len(track), dtype=np.int32)), pa.array(track, pa.float64())], names=["media_id", "feature", "frame_idx", "value"])

    return rows.mapInArrow(work, "media_id string, feature string, frame_idx int, value double")


def find_anomalies(waves: DataFrame, **levels) -> DataFrame:
    """(media_id, start, end, label, confidence) of waves (media_id, sr, samples)."""
    rows = waves.select("media_id", "sr", "samples")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m, *e) for m, r, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for e in anomalies(np.array(s or [], dtype=float), r, **levels)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64()))], names=["media_id", "start", "end", "label", "confidence"])

    return rows.mapInArrow(work, "media_id string, start double, end double, label string, confidence double")
