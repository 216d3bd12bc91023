"""Waves of any length in pieces that overlap, by their samples' numbers: no task holds a whole wave.

A piece has the frames that start in it and, behind them, the samples that its last frames and their
smoothing reach into. Stretches of the smoothed tracks that touch at a border are joined by number.
Results are those of the whole wave (operators.signal).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from . import signal
from .scratch import stored
from .signal import FRAME, HOP, SPECTRUM

#: Samples in a piece, a multiple of all hops; samples that travel together.
PIECE, SEGMENT = 1 << 16, 4096
HALF = SPECTRUM // 2
FEATURES = ("zcr", "rms_energy", "spectral_centroid", "spectral_entropy")


def numbered(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with _row (from 0) and _rows (how many) of each key's rows in order, where no key's rows meet in one task.

    Rows are dealt by ranges of key and order and counted by range; a range's numbers begin where those of the
    key's ranges before it end. Equal rows are numbered in any order.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts or spark.sparkContext.defaultParallelism, key, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    each = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.withColumn("_before", before).withColumn("_rows", F.sum("_n").over(of_key)).drop("_n").withColumnRenamed(key, "_key")
    local = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1)
    joined = local.join(starts.withColumnRenamed("_part", "_of"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_row", F.col("_row") + F.col("_before")).drop("_part", "_of", "_key", "_before")


def segments(samples: DataFrame, length: int = SEGMENT) -> DataFrame:
    """(media_id, sr, total, s, samples): so many consecutive samples at most from number s, of rows (media_id, sr, total, s, value)."""
    cut = samples.groupBy("media_id", F.floor(F.col("s") / length).alias("_cut")).agg(F.first("sr").alias("sr"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", F.col("value").cast("float").alias("value")))).alias("x"))
    return cut.select("media_id", "sr", "total", F.col("x")[0]["s"].alias("s"), F.col("x.value").alias("samples"))


def pieces(held: DataFrame, halo: int, size: int = PIECE) -> DataFrame:
    """(media_id, sr, total, piece, samples array<float>) of segments (media_id, sr, total, s, samples), s from 0.

    A segment goes to the pieces whose samples it holds, those that reach into the next piece counted in.
    A wave with samples missing is not defined.
    """
    if size % HOP or size % HALF:
        raise ValueError("a piece must hold whole hops")
    last = F.floor((F.col("s") + F.size("samples") - 1) / size).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("s") - (size + halo) + 1) / size).cast("int"))
    spread = held.where(F.size("samples") > 0).select("media_id", "sr", "total", "s", "samples", F.explode(F.sequence(first, last)).alias("piece"))
    met = spread.groupBy("media_id", "piece").agg(F.first("sr").alias("sr"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("s", "samples"))).alias("x"))
    begin = (F.col("piece").cast("long") * size - F.col("x")[0]["s"]).cast("int")
    return met.select("media_id", "sr", "total", "piece", F.slice(F.flatten("x.samples"), begin + 1, F.lit(size + halo)).alias("samples"))


def _tracks(wave: np.ndarray, rate: int, total: int, piece: int, size: int, ahead: int = 0, spectra: bool = True) -> dict[str, tuple[int, np.ndarray]]:
    """(number of the first frame, values) of the frames that start in a piece, and so many more of each track."""
    out = {}
    starts = np.arange(0, size + ahead * HOP, HOP)
    starts = starts[piece * size + starts < total - FRAME]
    frames = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[starts] if len(starts) else np.zeros((0, FRAME))
    out["zcr"] = piece * size // HOP, np.abs(np.diff(np.sign(frames), axis=1)).mean(axis=1) / 2
    out["rms_energy"] = piece * size // HOP, np.sqrt((frames**2).mean(axis=1))
    if not spectra:
        return out
    if total < SPECTRUM:  # one shorter frame, in the first piece
        frequencies, power = signal.spectrum(wave, rate) if piece == 0 else (np.zeros(0), np.zeros((0, 0)))
    else:
        starts = np.arange(0, size + ahead * HALF, HALF)
        starts = starts[piece * size + starts <= total - SPECTRUM]
        frequencies, power = signal.spectrum(wave[: starts[-1] + SPECTRUM], rate) if len(starts) else (np.zeros(0), np.zeros((0, 0)))
    out["spectral_centroid"] = piece * size // HALF, (power @ frequencies) / np.maximum(power.sum(axis=1), 1e-10) if power.size else np.zeros(0)
    out["spectral_entropy"] = piece * size // HALF, signal.entropy_of(power)
    return out


def features(held: DataFrame, size: int = PIECE, kinds: tuple[str, ...] = FEATURES) -> DataFrame:
    """(media_id, feature, frame_idx, value) of segments (media_id, sr, total, s, samples); an empty table gives an empty one.
    kinds: the features asked for; spectra are taken only for those that need them."""
    spectra = any(k.startswith("spectral") for k in kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, rate, total, piece, wave in zip(*(batch.column(i) for i in range(5)), strict=True):
                tracks = _tracks(wave.values.to_numpy(zero_copy_only=False).astype(float), rate.as_py(), total.as_py(), piece.as_py(), size, spectra=spectra)
                for name, (first, track) in tracks.items():
                    if name not in kinds:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([media.as_py()] * len(track), pa.string()), pa.array([name] * len(track), pa.string()), pa.array(np.arange(first, first + len(track)), pa.int64()), pa.array(track, pa.float64())], names=["media_id", "feature", "frame_idx", "value"])

    return pieces(held, SPECTRUM, size).select("media_id", "sr", "total", "piece", "samples").mapInArrow(work, "media_id string, feature string, frame_idx long, value double")


def anomalies(held: DataFrame, rate: int, noise: float = signal.NOISE_LEVEL, synthetic: float = signal.ENTROPY_LEVEL, size: int = PIECE) -> DataFrame:
    """(media_id, start, end, label, confidence) of segments (media_id, sr, total, s, samples) of one rate: stretches with
    many zero crossings or high spectral entropy, smoothed over half a second."""
    kinds = {"zcr": (HOP, 2 * FRAME, noise, L.NOISE_LABEL), "spectral_entropy": (HALF, SPECTRUM, synthetic, L.SYNTHETIC_LABEL)}
    widths = {name: max(1, int(0.5 * rate / hop)) for name, (hop, *_) in kinds.items()}
    halo = max(widths[name] * hop for name, (hop, *_) in kinds.items()) + SPECTRUM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for media, sr, total, piece, wave in zip(*(batch.column(i) for i in range(5)), strict=True):
                total, piece = total.as_py(), piece.as_py()
                if total <= 2 * FRAME:
                    continue
                values = wave.values.to_numpy(zero_copy_only=False).astype(float)
                for name, (hop, _, level, _) in kinds.items():
                    first, track = _tracks(values, sr.as_py(), total, piece, size, widths[name])[name]
                    width, mine = widths[name], size // hop
                    smooth = np.convolve(track, np.ones(width) / width, mode="valid")[:mine] if len(track) >= width else np.zeros(0)
                    for a, b in signal.runs(np.nan_to_num(smooth, nan=-np.inf) > level):
                        out.append((media.as_py(), name, total, first + a, first + b, float(smooth[a:b].sum())))
            kind = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kind)], names=["media_id", "track", "total", "first", "last", "sum"])

    runs = pieces(held, halo, size).select("media_id", "sr", "total", "piece", "samples").mapInArrow(work, "media_id string, track string, total long, first long, last long, sum double")
    along = Window.partitionBy("media_id", "track").orderBy("first")
    apart = F.coalesce(F.lag("last").over(along) != F.col("first"), F.lit(True)).cast("long")
    whole = runs.withColumn("apart", apart).withColumn("number", F.sum("apart").over(along)).groupBy("media_id", "track", "number")
    whole = whole.agg(F.first("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("sum").alias("sum"))
    pick = lambda of: F.create_map(*(F.lit(x) for name, k in kinds.items() for x in (name, of(name, k))))[F.col("track")]
    hop, length, level, label, width = pick(lambda _, k: k[0]), pick(lambda _, k: k[1]), pick(lambda _, k: k[2]), pick(lambda _, k: k[3]), pick(lambda n, _: widths[n])
    frames = F.when(F.col("track") == "zcr", F.ceil((F.col("total") - FRAME) / HOP)).otherwise(F.floor((F.col("total") - SPECTRUM) / HALF) + 1)
    time = lambda at: (at * hop + F.floor(length / 2) + (width - 1) * hop / 2) / rate
    start, end = time(F.col("first")), time(F.least(F.col("last"), frames - width))
    mean = F.col("sum") / (F.col("last") - F.col("first"))
    strength = F.when(F.col("track") == "zcr", mean / (2 * level)).otherwise((mean - level) / (0.5 * level))
    return whole.select("media_id", start.alias("start"), end.alias("end"), label.alias("label"), F.least(strength, F.lit(1.0)).alias("confidence")).where(F.col("end") - F.col("start") >= signal.SHORTEST)
