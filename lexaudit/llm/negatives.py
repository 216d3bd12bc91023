"""Hard negatives from a vector-approximation file, exactly.

Rows are kept in units of bounded size. In each, every dimension is cut into cells, and a row is also a
string of cell numbers: its approximation. For a query, a table of each cell's least and greatest
product bounds the inner product of every row by look-ups alone; rows are scored exactly only if their
bounds let them enter a window's best. What the best of the units read so far score raises the
windows' floors for the next wave of units. Anchors and floors are tables, joined to the units.
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
from .topk import matrix, quantised, waves

#: Cells a dimension; anchors and rows that are searched at once.
CELLS, ANCHOR_UNIT, ROW_UNIT, LEAST_UNIT = 64, 2048, 65_536, 4096
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Approximation:
    """A unit's rows by label and id, with the cell of each component and each cell's least and greatest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, cells: int = CELLS):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        n, width = rows.shape
        self.codes = np.zeros((width, n), dtype=np.uint8 if cells <= 256 else np.uint16)
        self.low = np.zeros((width, cells), dtype=np.int64)
        self.high = np.zeros((width, cells), dtype=np.int64)
        for d in range(width):
            values = self.rows[:, d]
            edges = np.unique(np.sort(values)[np.arange(1, cells) * n // cells])  # as many rows to a cell as ties let
            code = np.searchsorted(edges, values, side="right")
            self.codes[d] = code
            low, high = np.full(cells, _MOST), np.full(cells, _LEAST)
            np.minimum.at(low, code, values)
            np.maximum.at(high, code, values)
            empty = low > high
            low[empty] = high[empty] = 0
            self.low[d], self.high[d] = low, high

    def dump(self) -> bytes:
        out = io.BytesIO()
        narrow = np.min_scalar_type(-int(max(self.rows.max(initial=1), -(self.rows.min(initial=0) + 1))) - 1)
        np.savez(out, ids=self.ids, labels=self.labels, rows=self.rows.astype(narrow), codes=self.codes, low=self.low, high=self.high)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> "Approximation":
        held, self = np.load(io.BytesIO(blob)), cls.__new__(cls)
        self.ids, self.labels, self.rows, self.codes, self.low, self.high = (held[c] for c in ("ids", "labels", "rows", "codes", "low", "high"))
        return self

    def bounds(self, query: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product that each row from lo to hi can have, by table look-up."""
        least, most = self.low * query[:, None], self.high * query[:, None]
        least, most = np.minimum(least, most), np.maximum(least, most)
        below, above = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        for d in np.flatnonzero(query):
            code = self.codes[d, lo:hi]
            below += least[d][code]
            above += most[d][code]
        return below, above

    def search(self, own: int, label: int, query: np.ndarray, same: bool, floors: np.ndarray, tops: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window, from floors to tops with both, ids and scores of the k best rows but the query's own:
        of its label if same, else of other labels. scored has the number of rows that were scored exactly."""
        shown = min(len(query), self.rows.shape[1])
        asked = np.zeros(self.rows.shape[1], dtype=np.int64)
        asked[:shown] = query[:shown]
        size = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
        largest = max(size(self.low), size(self.high)) * size(asked) * max(1, len(asked))
        if largest >= 1 << 63:
            raise OverflowError("inner products do not fit 64 bits")
        first, last = (int(np.searchsorted(self.labels, label, side=s)) for s in ("left", "right"))
        lo, hi = (first, last) if same else (0, len(self.ids))
        below, above = self.bounds(asked, lo, hi)
        may = self.ids[lo:hi] != own
        if not same:
            may[first:last] = False
        wanted = np.zeros(hi - lo, dtype=bool)
        for floor, top in zip(floors, tops, strict=True):
            if floor <= top:
                inside = below[may & (below >= floor) & (above <= top)]
                if len(inside) >= k:
                    floor = max(floor, np.partition(inside, len(inside) - k)[len(inside) - k])
                wanted |= may & (above >= floor) & (below <= top)
        at = np.flatnonzero(wanted)
        self.scored = len(at)
        kind = np.float64 if largest < 1 << 53 else np.int64  # sums are exact in each
        scores = (self.rows[lo + at].astype(kind) @ asked.astype(kind)).astype(np.int64)
        ids = self.ids[lo + at]
        out = []
        for floor, top in zip(floors, tops, strict=True):
            fits = np.flatnonzero((scores >= floor) & (scores <= top))
            if len(fits) > k:
                fits = fits[scores[fits] >= np.partition(scores[fits], len(fits) - k)[len(fits) - k]]
            fits = fits[np.lexsort((ids[fits], -scores[fits]))[:k]]
            out.append((ids[fits], scores[fits]))
        return out


def _packed(rows: DataFrame, units: int) -> DataFrame:
    """(unit, blob) of (id, label, v), a unit a task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            some = pa.Table.from_batches(held)
            blob = Approximation(some["id"].to_numpy(), some["label"].to_numpy(), matrix(some["v"])).dump()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([blob], pa.binary())], names=["unit", "blob"])
            tidy()

    return rows.select("id", "label", "v").repartition(units).mapInArrow(build, "unit int, blob binary")


def _answers(units: DataFrame, asked: DataFrame, lo: int, hi: int, same: bool, k: int, batch: int) -> DataFrame:
    """(id, window, vec, score): what each unit from lo to hi answers to each of asked. A unit's number is the
    key of the join; each batch of anchors goes to each unit once."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for rows in batches:
            for unit, blob, query in zip(*(rows.column(c) for c in ("unit", "blob", "asked")), strict=True):
                if unit != last:
                    last, held = unit, Approximation.load(blob.as_py())
                some = pa.ipc.open_stream(query.as_buffer()).read_all()
                vectors = matrix(some["v"])
                out: list[list] = [[], [], [], []]
                for own, label, vector, floors, tops in zip(some["id"].to_pylist(), some["label"].to_pylist(), vectors, some["floors"].to_pylist(), some["tops"].to_pylist(), strict=True):
                    for window, (ids, scores) in enumerate(held.search(own, label, vector, same, np.array(floors, np.int64), np.array(tops, np.int64), k)):
                        if len(ids):
                            for column, x in zip(out, (np.full(len(ids), own), np.full(len(ids), window, np.int32), ids, scores), strict=True):
                                column.append(x)
                kinds = (np.int64, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], names=["id", "window", "vec", "score"])
        tidy()

    wave = units.where((F.col("unit") >= lo) & (F.col("unit") < hi))
    sent = batched(asked.select("id", "label", "v", "floors", "tops"), batch, "asked").withColumn("unit", F.explode(F.sequence(F.lit(lo).cast("int"), F.lit(hi - 1).cast("int"))))
    spread = sent.repartition(max(1, hi - lo), "unit").join(wave.repartition(max(1, hi - lo), "unit"), "unit")
    return spread.select("unit", "blob", "asked").mapInArrow(look, "id long, window int, vec long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id", "window").orderBy(F.desc("score"), "vec"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(units: DataFrame, n_units: int, asked: DataFrame, same: bool, k: int, first: int, batch: int) -> DataFrame:
    """(id, window, vec, score, rank) of asked (id, label, v, floors, tops): a stored table."""
    best = None
    for lo, hi in waves(n_units, first):
        ready = asked
        if best is not None:  # a full window's k-th score is its floor from now on
            full = best.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
            raised = F.transform("floors", lambda x, i: F.greatest(x, F.coalesce(F.element_at("reached", i), x)))
            ready = asked.join(full, "id", "left").withColumn("floors", F.when(F.col("reached").isNull(), F.col("floors")).otherwise(raised))
        new = _answers(units, ready, lo, hi, same, k, batch)
        before = best
        best = stored(_best(new if before is None else new.unionByName(before.drop("rank")), k), "best")
        if before is not None:
            discard(before)
    return best


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", row_unit: int | None = None, first_wave: int | None = None, anchor_unit: int = ANCHOR_UNIT) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score and negative_score.

    Scores are inner products of floor(scale * x). An anchor (is_anchor is a condition on id_col) has as
    positives its best other rows of its label (all, if fewer), and each positive the k best rows of
    other labels that score from low to high percent of it (all, if fewer); a positive without any gives
    no row. Equal scores go to the smaller id. Rows with a null id, label or vector or a null or
    non-finite component take no part. Of rows that share an id, the one with the smallest quantised
    vector, then label, counts. Shorter vectors count as padded with zeros; an empty table or no anchor
    gives no rows. Other columns are ignored. Scores that may not fit 64 bits are an error.

    A unit has row_unit rows (by default so many that all cores have two units, 65,536 at most); units
    answer in waves, each four times as large as all before. Results do not depend on either.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).groupBy("id").agg(F.min(F.struct("v", "label")).alias("x"))
    rows = stored(rows.select("id", "x.label", "x.v"), "vectors")
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    n_units = max(1, math.ceil(n / (row_unit or min(ROW_UNIT, max(LEAST_UNIT, math.ceil(n / (2 * cores)))))))
    first = first_wave or 2 * cores
    units = stored(_packed(rows, n_units), "units")
    anchors = rows.withColumnRenamed("id", id_col).where(is_anchor).withColumnRenamed(id_col, "id")
    all_of = lambda x: F.array(F.lit(x).cast("long"))
    anchors = stored(anchors.select("id", "label", "v", all_of(_LEAST).alias("floors"), all_of(_MOST).alias("tops")), "anchors")
    found = _searched(units, n_units, anchors, True, positives, first, anchor_unit)
    rest, hundreds = F.pmod("score", F.lit(100)), F.expr("(score - pmod(score, 100L)) div 100")  # no product overflows
    floor = hundreds * low + F.ceil(rest * low / 100).cast("long")
    top = hundreds * high + F.floor(rest * high / 100).cast("long")
    windows = found.select("id", F.struct(F.col("rank"), F.col("vec"), F.col("score"), floor.alias("floor"), top.alias("top")).alias("w")).groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # positives' number
    asked = stored(anchors.drop("floors", "tops").join(windows, "id").select("id", "label", "v", F.col("w.floor").alias("floors"), F.col("w.top").alias("tops"), F.col("w.vec").alias("vecs"), F.col("w.score").alias("scores")), "asked")
    hard = _searched(units, n_units, asked, False, k, first, anchor_unit)
    named = hard.withColumnRenamed("vec", "negative_id").withColumnRenamed("score", "negative_score").join(found.select("id", (F.col("rank") - 1).alias("window"), F.col("vec").alias("positive_id"), F.col("score").alias("positive_score")), ["id", "window"])
    discard(rows, units, anchors, asked)
    return named.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
