"""Alignment of two tokenizers' ids over the same bytes, by a dangling-suffix transducer.

Both tokenizers write the same bytes. The transducer reads their tokens in turn and holds the bytes by
which one side is ahead, the residual: the side behind reads next, and an empty residual closes a group.
A transition depends on the residual and the next token alone, so it is worked out once and remembered;
so are the groups of a piece of text between single spaces, where both tokenizers always cut.
A group's last tokens end together and are linked. Links are counted by block of text first; each
block then gets back the corpus-wide counts of the pairs that it holds.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .base import packed, small_batches, stored, tidy, unpacked
from .bpe import byte_characters

#: UTF-8 bytes of text whose links are counted together, and those that are encoded at once.
BLOCK_BYTES, ENCODE_BYTES = 16 << 20, 1 << 18
#: Transitions and pieces that a task remembers; beyond, it forgets all and begins anew. Longer pieces are not remembered.
MOST_REMEMBERED, MOST_PIECES, LONGEST_PIECE = 2_000_000, 150_000, 40
#: A space between two characters that are not white begins a token on both sides.
CUT = re.compile(r"(?<=\S) (?=\S)")
_TOKEN_BITS = 20
_B_BITS = 32


class Transducer:
    """States are numbers; 0 is the empty residual. Which side reads the next token follows from the state."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        if max(len(bytes_a), len(bytes_b)) >= 1 << _TOKEN_BITS:
            raise ValueError("a vocabulary of so many ids is not supported")
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.forget()

    def forget(self) -> None:
        self.moves: dict[int, int] = {}
        #: By state: whether A is ahead, and by which bytes.
        self.ahead, self.residual = [False], [b""]
        self.numbers = {(False, b""): 0}

    def _state(self, ahead: bool, residual: bytes) -> int:
        key = (ahead and residual != b"", residual)
        if key not in self.numbers:
            self.numbers[key] = len(self.ahead)
            self.ahead.append(key[0])
            self.residual.append(residual)
        return self.numbers[key]

    def move(self, state: int, token: int) -> int:
        """The state after the side behind (A, if none is) has read a token; -1 if the bytes differ."""
        ahead, residual = self.ahead[state], self.residual[state]
        read = self.bytes_b[token] if ahead else self.bytes_a[token]
        if residual.startswith(read):
            to = self._state(ahead, residual[len(read) :])
        elif read.startswith(residual):
            to = self._state(not ahead, read[len(residual) :])
        else:
            to = -1
        self.moves[state << _TOKEN_BITS | token] = to
        return to

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of each side have been read when each group closes; None if the sides' bytes differ."""
        if len(self.moves) > MOST_REMEMBERED:
            self.forget()
        moves, ahead = self.moves, self.ahead
        ends_a: list[int] = []
        ends_b: list[int] = []
        i = j = state = 0
        try:
            while True:
                if ahead[state]:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                key = state << _TOKEN_BITS | token
                state = moves[key] if key in moves else self.move(state, token)
                if state == 0:
                    ends_a.append(i)
                    ends_b.append(j)
                elif state < 0:
                    return None
        except IndexError:  # one side is at its end
            return (ends_a, ends_b) if state == 0 and i == len(a) and j == len(b) else None


class Pair:
    """Two tokenizers: a byte-level BPE file of the tokenizers library and a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            bytes_a[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        number = self.b.get_piece_size()
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(number)]
        if any(" " in x.decode("utf-8", "replace").lstrip(" ") for x in bytes_b):
            raise ValueError("a piece with a space inside: texts cannot be cut at spaces")
        self.transducer = Transducer(bytes_a, bytes_b)
        #: A byte-level vocabulary of all bytes, without a normaliser, writes any text as it is.
        self.exact = self.a.normalizer is None and set(vocabulary) >= set(byte)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.decimal = [str(i) for i in range(max(len(bytes_a), number))]

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
        """For each text, the ids of both sides and where its groups end in them; all empty where the text has no tokens."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < ENCODE_BYTES):
                size += len(texts[hi] or "")
                hi += 1
            some = [t or "" for t in texts[lo:hi]]
            lo = hi
            sides_b = [self.b.encode(t) for t in some]
            for text, one, b in zip(some, self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False), sides_b, strict=True):
                a, found = one.ids, None
                if text and (self.exact or b"".join([self.transducer.bytes_a[i] for i in a]) == b" " + text.encode()):
                    found = self.transducer.ends(a, b)
                yield (a, b, *found) if found else ([], [], [], [])

    def told(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """For each text: tokens of both sides, groups, the group list, and the linked pairs as int64; by pieces."""
        cut = [CUT.split(t) if t else [] for t in texts]
        if len(self.known) > MOST_PIECES:  # pieces that are not met again are forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        unmet = {p for pieces in cut for p in pieces} - known.keys()
        again = unmet & older.keys()
        known.update({p: older[p] for p in again})
        new = list(unmet - again)
        for piece, (a, b, ends_a, ends_b) in zip(new, self.align(new), strict=True):
            links = array("q", [a[i - 1] << _B_BITS | b[j - 1] for i, j in zip(ends_a, ends_b, strict=True)]).tobytes()
            known[piece] = (len(a), len(b), len(ends_a), self.written(a, b, ends_a, ends_b), links) if ends_a else None
        for pieces in cut:
            found = [known[p] for p in pieces]
            if found and None not in found:
                n_a, n_b, n, written, links = zip(*found, strict=True)
                yield sum(n_a), sum(n_b), sum(n), ";".join(written), b"".join(links)
            else:
                yield 0, 0, 0, "", b""
        for piece in new:
            if len(piece) > LONGEST_PIECE:
                del known[piece]

    def written(self, a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> str:
        """a1,a2|b1;a3|b2,b3"""
        decimal, out, i, j = self.decimal, [], 0, 0
        for m, n in zip(ends_a, ends_b, strict=True):
            left = decimal[a[i]] if m - i == 1 else ",".join([decimal[x] for x in a[i:m]])
            right = decimal[b[j]] if n - j == 1 else ",".join([decimal[x] for x in b[j:n]])
            out.append(f"{left}|{right}")
            i, j = m, n
        return ";".join(out)


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and groups, an array of (a array<int>, b array<int>): the ids of each side between two common ends.

    A encodes a space and the text, B the text (its model adds the space); special tokens' strings are
    plain text. Null and empty texts, and those that either side cannot write byte for byte, have no
    groups. Repeated rows are kept; other columns are left out. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            found = []
            for a, b, ends_a, ends_b in pair.align(batch.column(1).to_pylist()):
                found.append([{"a": a[i:m], "b": b[j:n]} for i, m, j, n in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "groups"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>>>"
    return rows.mapInArrow(look, schema).withColumnRenamed("id", id_col)


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, rows, pairs, counts), to be stored: a block's documents with their links, packed; its distinct
    pairs of linked ids, a * 2**32 + b, ascending; and how often it links each."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number, task = load(path_a, path_b), 0, TaskContext.get().partitionId()
        ids: list[pa.Array] = []
        told: list[tuple] = []
        links: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            distinct, at, n = np.unique(np.concatenate(links) if links else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
            lengths = np.array([len(x) for x in links])
            owner = np.repeat(np.arange(len(links)), lengths)
            keys, times = np.unique(owner * max(len(distinct), 1) + at, return_counts=True)  # a document's distinct pairs
            first = np.searchsorted(keys, np.arange(len(links) + 1) * max(len(distinct), 1))
            lists = lambda values: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int32)))
            columns = [pa.concat_arrays(ids), *(pa.array(x) for x in zip(*told, strict=True)), lists(keys % max(len(distinct), 1)), lists(times)]
            table = pa.table(columns, names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "times"])
            one = [pa.array([task << 32 | number], pa.int64()), pa.array([packed(table, 3)], pa.binary()), pa.array([distinct], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(one, names=["block", "rows", "pairs", "counts"])

        gc.disable()  # what is remembered has no cycles, and searching it for some takes a sixth of the time
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                ids.append(some.column(0))
                texts = some.column(1).to_pylist()
                for text, (n_a, n_b, n, written, linked) in zip(texts, pair.told(texts), strict=True):
                    told.append((n_a, n_b, n, hashlib.sha256(written.encode()).hexdigest() if n else ""))
                    links.append(np.frombuffer(linked, np.int64))
                    size += len(text or "")
                if size >= block_bytes:
                    yield close()
                    number += 1
                    ids, told, links, size = [], [], [], 0
        if told:
            yield close()
        gc.enable()
        del ids, told, links
        tidy()

    return rows.mapInArrow(look, "block long, rows binary, pairs array<long>, counts array<long>")


def link_counts(held: DataFrame) -> DataFrame:
    """(pair, count, best) of stored blocks: how many links of the corpus hold a pair, and whether no pair with
    the same id of B has more. A block gives a pair one row, so that frequent pairs are no hot keys."""
    counts = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    of_b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", of_b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def summaries(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair of ids no other pair with its id of B
    exceeds in the corpus), count_sum (of the links' counts) and groups_sha256 of each row.

    The digest is that of a group list like a1,a2|b1;a3|b2,b3, and '' without tokens: for null and empty
    texts, and for those that either side cannot write byte for byte. Rows that are repeated count each;
    ids may be null or shared; other columns are ignored. An empty table gives an empty one. A document's
    ids are held at once, some 100 bytes a token in a task.
    """
    held = stored(blocks(docs, path_a, path_b, id_col, text_col, block_bytes), "aligned")
    known = stored(link_counts(held), "links")
    wanted = held.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(known, "pair")
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(right["pair"].to_numpy(), kind="stable")
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        for blob in left["rows"]:
            table = unpacked(blob)
            pair, times = (table[c].combine_chunks() for c in ("pair", "times"))
            pair, times, first = pair.values.to_numpy(), times.values.to_numpy().astype(np.int64), pair.offsets.to_numpy()

            def sums(x: np.ndarray, times: np.ndarray = times, pair: np.ndarray = pair, first: np.ndarray = first) -> pa.Array:
                upto = np.append(0, np.cumsum(times * x[pair]))
                return pa.array(upto[first[1:]] - upto[first[:-1]], pa.int64())

            links = sums(np.ones(len(count), np.int64))
            out.append(pa.table([table["id"].cast(kind), table["n_a"], table["n_b"], table["n_groups"], links, sums(best), sums(count), table["groups_sha256"]], names=names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], kind if n == "id" else pa.string() if n == "groups_sha256" else pa.int64()) for n in names})

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return held.select("block", "rows").groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
