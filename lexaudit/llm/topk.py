"""Exact top-k by integer inner product over an impact-ordered inverted index, score at a time.

A block of vectors is kept as postings: for each dimension, the rows whose component there is not
zero, in segments by quantised impact, the power of two that the component's size reaches. Segments
are read by descending impact for a batch of queries at once, adding to the sums of the rows listed.
What a row can still gain is bounded by the query's length times the length of the row's components
that are not read yet (Cauchy and Schwarz); a row whose bound is under the k-th best exact score
known is out for certain. A query stops reading when the rows not ruled out are few enough, and
those are rescored exactly.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import batched, discard, stored, tidy

ROW_BLOCK = 8192
#: Queries that go to a block together.
QUERY_UNIT = 4096
#: Each wave has so many times the blocks of all before.
GROWTH = 4
#: The floor of a query that has none.
LEAST = -(1 << 63)
#: Reading stops once so small a share of a block's rows is not ruled out.
RESCORE_SHARE = 0.2
#: Queries that a block reads its segments for at once.
QUERY_BATCH = 64
#: While more of the rows' squared length is unread, no rows are ruled out: they could not be many.
LOOK_FROM = 0.25


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null, NaN or infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Index:
    """The postings of one block. Segment (level, dimension) lists the rows whose component has bit length
    levels - level there; level 0 holds the largest impacts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, self.width = rows.shape
        bits = np.frexp(np.abs(self.rows).astype(np.float64))[1]  # sizes of 2**53 and more may count one level up
        self.levels = int(bits.max(initial=0))
        row, dim = np.nonzero(self.rows)
        segment = (self.levels - bits[row, dim]) * self.width + dim
        by_segment = np.argsort(segment, kind="stable")
        self.row = row[by_segment].astype(np.int32)
        self.start = np.searchsorted(segment[by_segment], np.arange(self.levels * self.width + 1))
        squares = self.rows.astype(np.float64) ** 2
        #: Length of each row's components in the levels after a level.
        self.tail = np.sqrt(np.array([np.where(bits < self.levels - level, squares, 0).sum(axis=1) for level in range(self.levels)]).reshape(self.levels, n))
        self.energy = float(squares.sum())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, rows=self.rows.astype(np.min_scalar_type(-int(np.abs(self.rows).max(initial=1)))), row=self.row.astype(np.min_scalar_type(len(self.ids))), start=self.start, tail=self.tail.astype(np.float64), energy=self.energy, levels=self.levels)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> "Index":
        held, self = np.load(io.BytesIO(blob)), cls.__new__(cls)
        self.ids, self.rows, self.row, self.start, self.tail = (held[c] for c in ("ids", "rows", "row", "start", "tail"))
        self.rows = self.rows.astype(np.int64)
        self.energy, self.levels, self.width = float(held["energy"]), int(held["levels"]), self.rows.shape[1]
        return self

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, share: float = RESCORE_SHARE, floors: np.ndarray | None = None, floor_ids: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the ids and scores of the k best rows but its own, by score, then smaller id.

        With floors (int64, as scores are), rows of a smaller score than a query's, or of the same and a greater id than
        floor_ids, are left out. reads has the levels that each query has read.
        """
        n, m = len(self.ids), len(own)
        width = max(self.width, queries.shape[1])
        largest = int(np.abs(self.rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, width)
        if largest >= 1 << 63:
            raise OverflowError("inner products do not fit 64 bits")
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64  # sums are exact in each
        exact = self.rows.astype(kind)
        asked = np.zeros((m, self.width), dtype=kind)
        shown = min(self.width, queries.shape[1])
        asked[:, :shown] = queries[:, :shown]
        at = np.searchsorted(self.ids, own)
        me = np.where((at < n) & (self.ids[np.minimum(at, n - 1)] == own), at, -1)
        floor = np.full(m, LEAST) if floors is None else floors.copy()
        length = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
        out: list = [None] * m
        self.reads = np.zeros(m, dtype=np.int64)
        live = np.arange(m)
        sums = np.zeros((n, m), dtype=kind)
        for level in range(self.levels):
            self._read(level, sums, exact, asked[live])
            self.reads[live] += 1
            last = level + 1 == self.levels
            left = self.tail[level]
            if not last and (left @ left) > LOOK_FROM * self.energy:
                continue
            by_query = np.ascontiguousarray(sums.T)
            going = []
            for r, i in enumerate(live):
                if n > 4 * k + 2:
                    first = np.argpartition(by_query[r], n - 2 * k - 1)[n - 2 * k - 1 :]
                    floor[i] = max(floor[i], int(np.sort(exact[first[first != me[i]]] @ asked[i])[-k]))
                # a little slack for the rounding of lengths, and of scores that doubles do not hold
                so_far, least = by_query[r].astype(np.float64), float(floor[i])
                maybe = np.flatnonzero(so_far + left * (length[i] * (1 + 1e-9)) + 1e-3 + 1e-15 * (np.abs(so_far) + abs(least)) >= least)
                if last or len(maybe) <= share * n:
                    out[i] = self._rank(maybe, me[i], exact, asked[i], k)
                else:
                    going.append(r)
            if len(going) < len(live):
                live, sums = live[going], np.ascontiguousarray(sums[:, going])
            if not len(live):
                break
        for i in live if not self.levels else ():
            out[i] = self._rank(np.arange(n), me[i], exact, asked[i], k)
        if floors is not None:
            for i, (ids, score) in enumerate(out):
                keep = (score > floors[i]) | ((score == floors[i]) & (ids < floor_ids[i]))
                out[i] = ids[keep], score[keep]
        return out

    def _read(self, level: int, sums: np.ndarray, exact: np.ndarray, asked: np.ndarray) -> None:
        """Adds what one level's postings give to the rows they list; a segment lists a row once."""
        for dim in range(self.width):
            a, b = self.start[level * self.width + dim], self.start[level * self.width + dim + 1]
            if a < b:
                listed = self.row[a:b]
                sums[listed] += exact[listed, dim, None] * asked[:, dim]

    def _rank(self, which: np.ndarray, me: int, exact: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        which = which[which != me]
        score = (exact[which] @ query).astype(np.int64)
        if len(which) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            which, score = which[keep], score[keep]
        order = np.lexsort((self.ids[which], -score))[:k]
        return self.ids[which[order]], score[order]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width; shorter vectors count as padded with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def waves(blocks: int, first: int) -> list[tuple[int, int]]:
    """Ranges of block numbers: first so many, then GROWTH times as many as all before, and so on."""
    ends = [0, min(first, blocks)]
    while ends[-1] < blocks:
        ends.append(min((1 + GROWTH) * ends[-1], blocks))
    return list(zip(ends, ends[1:], strict=False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK, query_unit: int = QUERY_UNIT, first_wave: int | None = None) -> DataFrame:
    """query_id, rank from 1, id_col and score: the k best other rows of each query row (all, if fewer).

    is_query is a condition on id_col. Rows with a null id, a null vector or a null or non-finite
    component take no part. Of rows that share an id, the one with the smallest quantised vector
    counts. Shorter vectors count as padded with zeros; an empty table or no query gives no rows.
    Equal scores go to the smaller id. Other columns are ignored. Scores that may not fit 64 bits
    are an error.

    Each row goes once to a block of bounded size, whose index is built and written once. Blocks answer
    in waves, each four times as large as all before, and a wave is one join of blocks and queries: what
    the k best rows so far score is a query's floor in the next wave, so that a query gets about k rows
    from each wave instead of k rows from each block. Queries, floors and answers are tables.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    blocks = max(1, math.ceil(rows.count() / row_block))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            some = pa.Table.from_batches(held)
            blob = Index(some["id"].to_numpy(), matrix(some["v"])).dump()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([blob], pa.binary())], names=["block", "blob"])

    index = stored(rows.repartition(blocks).mapInArrow(build, "block int, blob binary"), "index")
    asked = stored(rows.withColumnRenamed("id", id_col).where(is_query).select(F.col(id_col).alias("id"), "v"), "queries")
    no_floor = (F.lit(LEAST).cast("long").alias("floor"), F.lit(0).cast("long").alias("floor_id"))
    best = None
    for lo, hi in waves(blocks, first_wave or spark.sparkContext.defaultParallelism):
        if best is None:
            ready = asked.select("id", "v", *no_floor)
        else:
            full = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score", F.col("id").alias("at"))
            ready = asked.join(full, "id", "left").select("id", "v", F.coalesce("score", no_floor[0]).alias("floor"), F.coalesce("at", no_floor[1]).alias("floor_id"))
        found, before = _answers(index, ready, lo, hi, k, query_unit), best
        best = stored(_best(found if before is None else found.unionByName(before.drop("rank")), k), "answers")
        if before is not None:
            discard(before)
    discard(rows, index, asked)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _best(parts: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def _answers(index: DataFrame, asked: DataFrame, lo: int, hi: int, k: int, query_unit: int) -> DataFrame:
    """(query_id, id, score): what the blocks from lo to hi answer to asked (id, v, floor, floor_id). A block's
    number is the key of the join; each batch of queries goes to each block once."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for rows in batches:
            for block, blob, query in zip(*(rows.column(c) for c in ("block", "blob", "asked")), strict=True):
                if block != last:
                    last, held = block, Index.load(blob.as_py())
                some = pa.ipc.open_stream(query.as_buffer()).read_all().sort_by("id")
                own, floors, floor_ids = (some[c].to_numpy() for c in ("id", "floor", "floor_id"))
                vectors = matrix(some["v"])
                for a in range(0, len(own), QUERY_BATCH):
                    at = slice(a, a + QUERY_BATCH)
                    got = held.search(own[at], vectors[at], k, floors=floors[at], floor_ids=floor_ids[at])
                    ids, score = (np.concatenate(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(own[at], [len(x) for x, _ in got]), ids, score)], names=["query_id", "id", "score"])
        tidy()

    sent = batched(asked, query_unit, "asked").withColumn("block", F.explode(F.sequence(F.lit(lo).cast("int"), F.lit(hi - 1).cast("int"))))
    wave = index.where((F.col("block") >= lo) & (F.col("block") < hi))
    spread = sent.repartition(max(1, hi - lo), "block").join(wave.repartition(max(1, hi - lo), "block"), "block")
    return spread.select("block", "blob", "asked").mapInArrow(search, "query_id long, id long, score long")
