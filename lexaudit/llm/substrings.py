"""Removal of long repeated passages, by difference-cover anchors.

A window is a fixed number of consecutive words. Anchors are shorter windows, taken only at word
positions whose remainder modulo a period lies in a difference cover: whatever the offset between
two occurrences of a window, some anchor inside it is taken in both. Anchors that two different
documents share are extended to the windows around them, and those are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, packed_blocks, signed, small_batches, stored, text_blocks, tidy, unpacked, word_chunks

WINDOW = 50
#: A perfect difference set: every non-zero remainder modulo 31 is a difference of two of them. Fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bits of a text's hash that tell whether two texts share an anchor, and of a window's second hash.
MARK, HALF = np.uint64((1 << 44) - 1), np.uint64((1 << 32) - 1)
#: Bytes of text that are read, compared and cut together.
BLOCK_BYTES = 4 << 20


class _Doc:
    """Word positions of a chunk that matter: those of documents with at least a window."""

    def __init__(self, words: Words, window: int, period: int, cover: tuple[int, ...], only: np.ndarray | None = None):
        keep = words.count >= window
        if only is not None:
            keep = keep & only
        n, ordinal = len(words.hash), np.arange(len(words.hash))
        self.doc = np.repeat(np.arange(len(words.count)), words.count)
        first, last = (np.repeat(x, words.count) for x in (words.first[:-1], words.first[1:]))
        in_cover = np.zeros(period, dtype=bool)
        in_cover[list(cover)] = True
        length = window - period + 1
        self.anchors = np.flatnonzero(keep[self.doc] & (last - ordinal >= length) & in_cover[(ordinal - first) % period])
        self.starts = keep[self.doc] & (last - ordinal >= window)
        self.hashes = words.windows(self.anchors, length) if n else np.zeros(0, np.uint64)


def _spread(at: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """True from before positions before each of at to after positions after it."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + after + 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _pair(words: Words, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the windows that start there, 96 bits in all."""
    return signed(words.windows(start, window)), signed(words.windows(start, window, second=True) & HALF)


def _join(words: Words, first: int, last: int, keep: np.ndarray | None) -> bytes:
    """The kept words of a document, joined by single spaces."""
    at = range(first, last) if keep is None else (np.flatnonzero(keep) + first).tolist()
    if keep is None and last > first:
        return b" ".join(words.data[words.start[first] : words.end[last - 1]].tobytes().split())
    data, start, end = words.data, words.start, words.end
    return b" ".join([data[start[i] : end[i]].tobytes() for i in at])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per input row: id_col, text_key, n_words, n_removed, kept_sha256, kept.

    A word goes if it lies in a window whose words also start, in the same order, in a document with
    a smaller id; all windows are judged on the input. kept holds the words left, joined by single
    spaces, where some went, and is null where none did; kept_sha256 is its digest in either case.
    text_key is xxhash64 of the text. A null or empty text has no words, and its digest is that of
    the empty string. A row with a null id loses nothing and is compared with nothing. Rows that
    share an id are judged each on its own text and lose no words to one another. A text of fewer
    words than a window loses nothing. An empty table gives an empty one; other columns are ignored.

    Copies of a whole text are settled by its smallest id: of each text one copy is compared in full.
    Hashes of compared windows have 96 bits; shared anchors are looked for with marks of 44 bits that
    tell texts apart.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"), F.col(text_col).alias("text"))
    length = window - period + 1

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in text_blocks(batches, 2, BLOCK_BYTES):
            for w in word_chunks(held["text"]):
                one, two = (w.spans(w.first[:-1], w.first[1:], second=x) for x in (False, True))
                sha = [hashlib.sha256(_join(w, w.first[i], w.first[i + 1], None)).hexdigest() for i in range(w.hi - w.lo)]
                keys = [held[c].combine_chunks().slice(w.lo, w.hi - w.lo) for c in ("id", "k")]
                here = [pa.array(np.full(w.hi - w.lo, block)), pa.array(np.arange(w.lo, w.hi, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*here, *keys, pa.array(signed(one)), pa.array(signed(two)), pa.array(w.count.astype(np.int64)), pa.array(sha, pa.string())], names=["block", "row", "id", "k", "t1", "t2", "n", "sha"])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each of a block's anchors once, with the least and the largest mark of the texts that hold it."""
        for block, held in text_blocks(batches, 2, BLOCK_BYTES):
            has_id = np.asarray(held["id"].combine_chunks().is_valid())
            hashes, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for w in word_chunks(held["text"]):
                d = _Doc(w, window, period, cover, has_id[w.lo : w.hi])
                hashes.append(d.hashes)
                marks.append((w.spans(w.first[:-1], w.first[1:]) & MARK)[d.doc[d.anchors]])
            h, m = np.concatenate(hashes), signed(np.concatenate(marks))
            order = np.lexsort((m, h))
            h, m = h[order], m[order]
            edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            last = np.append(edge[1:], len(h)) - 1 if len(h) else edge
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[edge])), pa.array(np.full(len(edge), block)), pa.array(m[edge]), pa.array(m[last])], names=["hash", "block", "a", "b"])

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("a block has changed between two readings of its table")
        return unpacked(left["rows"][0])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each candidate window of a block once, with the smallest and the largest id that it starts in there."""
        hashes: list[np.ndarray] = []
        value, is_copy = right["value"].to_numpy(), right["is_copy"].to_numpy(zero_copy_only=False)
        if len(value):
            held = opened(left, right)
            known = np.sort(value[~is_copy].view(np.uint64))
            ids = held["id"].combine_chunks().fill_null(0).to_numpy()
            use = np.asarray(held["id"].combine_chunks().is_valid()) & ~np.isin(np.arange(len(ids)), value[is_copy])
            for w in word_chunks(held["text"]):
                d = _Doc(w, window, period, cover, use[w.lo : w.hi])
                at = np.minimum(np.searchsorted(known, d.hashes), max(len(known) - 1, 0))
                hit = d.anchors[known[at] == d.hashes] if len(known) else d.anchors[:0]
                start = np.flatnonzero(_spread(hit, len(w.hash), window - length, 0) & d.starts)
                if len(start):
                    hashes.append(np.stack([*_pair(w, start, window), ids[w.lo + d.doc[start]]]))
        w1, w2, owner = np.concatenate(hashes, axis=1) if hashes else np.zeros((3, 0), np.int64)
        order = np.lexsort((owner, w2, w1))
        w1, w2, owner = w1[order], w2[order], owner[order]
        edge = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))) if len(w1) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(w1)) - 1 if len(w1) else edge
        block = np.full(len(edge), right["block"][0].as_py() if right.num_rows else 0)
        tidy()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in (("w1", w1[edge]), ("w2", w2[edge]), ("block", block), ("least", owner[edge]), ("most", owner[last]))})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """What is left of a block's documents once the windows that a smaller id holds are gone."""
        row, gone, sha, left_over = [], [], [], []
        order = np.argsort(right["w1"].to_numpy())
        w1, w2, lead = (right[c].to_numpy()[order] for c in ("w1", "w2", "lead"))
        if len(w1):
            held = opened(left, right)
            ids = held["id"].combine_chunks()
            use, ids = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
            for w in word_chunks(held["text"]):
                d = _Doc(w, window, period, cover, use[w.lo : w.hi])
                start = np.flatnonzero(d.starts)
                one, two = _pair(w, start, window)
                at = np.minimum(np.searchsorted(w1, one), len(w1) - 1)
                start = start[(w1[at] == one) & (w2[at] == two) & (lead[at] < ids[w.lo + d.doc[start]])]
                lost = _spread(start, len(w.hash), 0, window - 1)
                for i in np.unique(d.doc[start]):
                    first, last = w.first[i], w.first[i + 1]
                    kept = _join(w, first, last, ~lost[first:last])
                    row.append(w.lo + i)
                    gone.append(int(lost[first:last].sum()))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    left_over.append(kept)
        block = [right["block"][0].as_py()] * len(row) if row else []  # of many blocks no window is held elsewhere
        tidy()
        return pa.table({"block": pa.array(block, pa.int64()), "row": pa.array(row, pa.int32()), "gone": pa.array(gone, pa.int64()), "cut_sha": pa.array(sha, pa.string()), "cut": pa.array(left_over, pa.binary()).cast(pa.string())})

    texts = stored(rows.mapInArrow(profile, "block long, row int, id long, k long, t1 long, t2 long, n long, sha string"), "profile")
    blobs = packed_blocks(rows, 2, BLOCK_BYTES, level=6)
    # Only texts that hold a window have a lead, and a block asks for each of its texts once: neither empty
    # texts nor the copies of one text meet in a task.
    once = texts.where((F.col("n") >= window) & F.col("id").isNotNull()).groupBy("block", "t1", "t2").agg(F.min("id").alias("first"))
    leads = once.groupBy("t1", "t2").agg(F.min("first").alias("lead"))
    led = texts.join(once.join(leads, ["t1", "t2"]).select("block", "t1", "t2", "lead"), ["block", "t1", "t2"], "left")
    # A block holds an anchor once, so that no anchor has more rows than there are blocks. Both readers
    # of this exchange ask for all of its columns: otherwise it would be made twice, once for each.
    found = rows.mapInArrow(anchors, "hash long, block long, a long, b long").where("hash is not null").repartition("hash")
    shared = found.groupBy("hash").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.count("block").alias("blocks")).where("least <> most and blocks > 0").select("hash")
    hits = found.join(shared, "hash").select("block", F.col("hash").alias("value"), (F.col("a") > F.col("b")).alias("is_copy"))
    copies = led.where((F.col("id") > F.col("lead")) & (F.col("n") >= window)).select("block", F.col("row").cast("long").alias("value"), F.lit(True).alias("is_copy"))
    # A block holds a window once too, and one exchange serves the minimum and the way back: both ask for
    # all columns, and what either would filter by is filtered before.
    candidates = blobs.groupBy("block").cogroup(hits.unionByName(copies).groupBy("block")).applyInArrow(windows, "w1 long, w2 long, block long, least long, most long")
    candidates = candidates.where(" and ".join(f"{c} is not null" for c in candidates.columns)).repartition("w1", "w2")
    smallest = candidates.groupBy("w1", "w2").agg(F.min("least").alias("lead"), F.max("most").alias("last"), F.count("block").alias("blocks")).where("lead < last and blocks > 0").select("w1", "w2", "lead")
    repeated = candidates.join(smallest, ["w1", "w2"]).where("most > lead").select("block", "w1", "w2", F.least("lead", "least").alias("lead"))
    trimmed = blobs.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(cut, "block long, row int, gone long, cut_sha string, cut string")
    trimmed = trimmed.dropDuplicates(["block", "row"])  # equal blocks have equal numbers
    judged = led.join(trimmed, ["block", "row"], "left")
    copy = F.coalesce((F.col("id") > F.col("lead")) & (F.col("n") >= window), F.lit(False))
    return judged.select(
        F.col("id").alias(id_col), F.col("k").alias("text_key"), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("cut")).alias("kept"),
    )
