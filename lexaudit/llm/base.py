"""What the operators of this subpackage share: scratch tables, Arrow batches, word and window hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D in the UTF-8 text (a null text has
none). Hashes are 64-bit polynomials over odd multipliers, computed for a whole batch of documents
at once with prefix sums; a window's hash is a difference of two prefix sums.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import discard, scope, stored  # noqa: F401 - the operators import them from here

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Rows of text in an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(*names: str) -> list[str]:
    """Column names as Spark's functions take them, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


#: Decisions on so many rows at most are sent to all tasks; more are joined by a shuffle.
SMALL_ROWS = 1_000_000


def sent_if_small(rows: DataFrame) -> DataFrame:
    """rows, which are narrow and stored, marked for broadcast if a count finds them few enough."""
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: one batch of whole texts must fit beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidy() -> None:
    """Gives freed memory back to the system: worker processes live on from stage to stage, beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- hashes

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_WORD_BASE_2 = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=None)
def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, n: int) -> np.ndarray:
    """Of the spans [start, end) of what sums was made from; equal spans have equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(inverse(base), n + 1)[start])


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words of documents lo..hi-1 of an array: byte spans, hashes, and first[i]: where document i's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: bool):
        self.lo, self.hi = lo, hi
        base = offsets[lo]
        self.data = data[base : offsets[hi]]
        bounds = offsets[lo : hi + 1] - base
        n = len(self.data)
        white = WHITE[self.data]
        before = np.ones(n, dtype=bool)
        before[1:] = white[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = white[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        before[inner] = True
        after[inner - 1] = True
        black = ~white
        self.start = np.flatnonzero(black & before)
        self.end = np.flatnonzero(black & after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds
        sums = prefix_sums(_byte_codes(fold)[self.data], _BYTE_BASE)
        self.hash = span_hashes(sums, self.start, self.end, _BYTE_BASE, n)
        self.count = np.diff(self.first)
        self._sums: dict[int, np.ndarray] = {}

    def windows(self, start: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        """Hashes of the windows of so many words that begin at these words."""
        base = _WORD_BASE_2 if second else _WORD_BASE
        if base not in self._sums:
            self._sums[base] = prefix_sums(self.hash, base)
        return span_hashes(self._sums[base], start, start + length, base, len(self.hash))

    def spans(self, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
        base = _WORD_BASE_2 if second else _WORD_BASE
        if base not in self._sums:
            self._sums[base] = prefix_sums(self.hash, base)
        return span_hashes(self._sums[base], start, end, base, len(self.hash))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_chunks(texts: pa.Array | pa.ChunkedArray, fold: bool = False) -> Iterator[Words]:
    """All documents of the column, in order, in chunks of about CHUNK_BYTES; fold: A-Z count as a-z."""
    data, offsets = utf8(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Words(data, offsets, lo, hi, fold)
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- blocks of text


def text_blocks(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[tuple[int, pa.Table]]:
    """A task's rows in blocks of about so many bytes of text, each with a number that follows from its
    rows alone: a second pass over the same rows finds the same blocks under the same numbers."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        _, offsets = utf8(batch.column(text_at))
        cost = offsets + 16 * np.arange(len(offsets))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(cost, cost[lo] + size - have))
            hi = min(max(hi, lo + 1), batch.num_rows)
            held.append(batch.slice(lo, hi - lo))
            have += int(cost[hi] - cost[lo])
            lo = hi
            if have >= size:
                yield _numbered(held)
                held, have = [], 0
    if held:
        yield _numbered(held)


def _numbered(held: list[pa.RecordBatch]) -> tuple[int, pa.Table]:
    import xxhash

    rows = pa.Table.from_batches(held).combine_chunks()
    digest = xxhash.xxh3_64(str(rows.num_rows))
    for column in rows.columns:
        digest.update(str(column.null_count))
        if pa.types.is_string(column.type):
            data, offsets = utf8(column)
            digest.update(np.ascontiguousarray(offsets - offsets[0]))
            digest.update(data[offsets[0] : offsets[-1]])
        else:
            digest.update(repr(column.to_pylist()))
    return int(np.array(digest.intdigest(), np.uint64).view(np.int64)), rows


def packed(rows: pa.Table, level: int) -> bytes:
    out = pa.BufferOutputStream()
    with ipc.new_stream(out, rows.schema, options=ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(blob: pa.Scalar) -> pa.Table:
    return ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()


def packed_blocks(rows: DataFrame, text_at: int, size: int, level: int = 3) -> DataFrame:
    """(block, rows): each block's rows as one compressed value, a fraction of the text's size in a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in text_blocks(batches, text_at, size):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed(held, level)], pa.binary())], names=["block", "rows"])

    return rows.mapInArrow(pack, "block long, rows binary")


def batched(rows: DataFrame, size: int, name: str) -> DataFrame:
    """One column: all columns of rows as Arrow tables of so many rows at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            table = pa.Table.from_batches(held)
            with ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=[name])

        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                some = batch.slice(lo, size)
                if held and sum(x.num_rows for x in held) + some.num_rows > size:
                    yield close()
                    held = []
                held.append(some)
        if held:
            yield close()

    return rows.mapInArrow(pack, f"{name} binary")


def total(parts: DataFrame, column: str, spread: int = 16, kind: type = np.int64) -> np.ndarray | None:
    """The sum of the vectors of a kind, int64 or float64, that the tasks left in a binary column, added up in two steps."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for value in batch.column(0):
                x = np.frombuffer(value.as_buffer(), kind)
                sums = x.copy() if sums is None else sums + x
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=[column])

    rows = parts.select(column).repartition(spread).mapInArrow(add, f"{column} binary").collect()
    return sum((np.frombuffer(r[0], kind) for r in rows[1:]), np.frombuffer(rows[0][0], kind)) if rows else None
