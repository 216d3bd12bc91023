"""Byte-level BPE over a distinct-word table.

Texts are cut into words once, in blocks of a few MB: a block keeps the list of its distinct words and,
for each document, the positions of its words in that list. The lists go to the table, by buckets of
words, where each distinct word is encoded once; they come back as ids, which the blocks join by
position. Decoding joins ids to the piece table, an Arrow column as long as the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .base import packed, small_batches, stored, tidy, unpacked

#: UTF-8 bytes of text in a block.
BLOCK_BYTES = 24 << 20
#: Texts of lower code points are split by a pattern made from the library's own classes; others by the library.
COMMON = 0x250
#: Buckets of words in the distinct-word table; a task holds one bucket's distinct words at a time.
BUCKETS = 1024
ENCODE_WORDS = 2000
#: Words of a block that are joined with their ids at once.
JOIN_WORDS = 200_000
#: Numbers that are packed to bits at once; a multiple of 8, so that slices end with a byte.
SLICE = 1 << 16


def byte_characters() -> dict[str, int]:
    """The printable characters by which a byte-level vocabulary writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


@lru_cache(maxsize=4)
def load(path: str) -> "Codec":
    codec = Codec(path)
    tidy()  # what reading the file took
    return codec


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(text)
        self._refuse(said)
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        del said, text
        found = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        self.pieces = self._pieces()
        self.piece_column = pa.array(self.pieces, pa.large_binary())
        self.decimal_column = pa.array([b"%d," % i for i in range(len(self.pieces))], pa.large_binary())
        self.kind = np.uint16 if len(self.pieces) <= 1 << 16 else np.int32
        self.uncommon = re.compile(f"[^\\x00-{chr(COMMON - 1)}]")
        self.split = self._split()

    @staticmethod
    def _refuse(said: dict) -> None:
        """Settings of a tokenizer file that are not followed here are an error."""
        model, cut = said["model"], said.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [] if model.get("type", "BPE") == "BPE" else ["model"]
        odd += [] if cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) else ["pre_tokenizer"]
        odd += ["normalizer"] if said.get("normalizer") else []
        odd += [f"added token {t['content']}" for t in said.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
        if odd:
            raise ValueError(f"only plain byte-level BPE is supported, not this file's {', '.join(odd)}")

    def _split(self) -> re.Pattern:
        """The split of byte-level BPE: contractions, then runs of letters, digits or symbols with a space before, then white space."""
        classes: dict[str, str] = {"letter": "", "digit": "", "symbol": "", "white": ""}
        for c in map(chr, range(COMMON)):
            alike = next((k for k, example in (("letter", "a"), ("digit", "1"), ("symbol", "!")) if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(example + c)) == 1), "white")
            classes[alike] += re.escape(c)
        runs = "".join(f"| ?[{classes[k]}]+" for k in ("letter", "digit", "symbol"))
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d{runs}|[{classes['white']}]+(?![^{classes['white']}])|[{classes['white']}]+")

    def _pieces(self) -> list[bytes]:
        """The bytes of each id; the vocabulary writes bytes as printable characters."""
        byte = byte_characters()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values(), default=-1) + 1)
        for piece, i in vocab.items():
            out[i] = piece.encode() if piece in self.special else bytes(byte[c] for c in piece)
        return out

    def words(self, text: str) -> list[str]:
        """The text cut into what BPE encodes apart; special tokens are words of their own."""
        out: list[str] = []
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
            if part in self.special:
                out.append(part)
            elif self.uncommon.search(part):
                out.extend(part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
            else:
                out.extend(self.split.findall(part))
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), ENCODE_WORDS):  # the library's own results are large
            out += [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words[lo : lo + ENCODE_WORDS], add_special_tokens=False)]
        return out

    def decode(self, ids: list[int]) -> str:
        """Joins ids to their pieces."""
        return joined(self.piece_column, np.asarray(ids, dtype=np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def joined(column: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The values of a column of bytes at ids, one after another, cut where ends say."""
    taken = column.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(ids) + 1]
    cut = np.append(0, offsets[ends]).tolist() if len(ends) else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _bucket(words: list[str]) -> np.ndarray:
    """The bucket of each word, by a digest that is the same everywhere."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words), np.int32, len(words))


def _strings(values: list[bytes]) -> bytes:
    """Byte strings, compressed: their lengths, then their bytes."""
    raw = len(values).to_bytes(4, "little") + _planes(np.array([len(v) for v in values], dtype=np.int64)) + b"".join(values)
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _from_strings(blob: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes."""
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    return _from_planes(raw[4 : 4 + 4 * n]), raw[4 + 4 * n :]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the high bytes of small ones compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _by_length(x: np.ndarray) -> bytes:
    """Numbers from 0 below 2**31 as their lengths in bits, a byte each, then the bits under the leading one, packed by length:
    small numbers take few bits, and a compressor sees the lengths by themselves. Bits are a number each only for a slice."""
    length = np.empty(len(x), dtype=np.uint8)
    for lo in range(0, len(x), SLICE):
        length[lo : lo + SLICE] = np.frexp(x[lo : lo + SLICE].astype(np.float64))[1]
    parts = [len(x).to_bytes(8, "little"), length.tobytes()]
    for n in range(2, int(length.max(initial=0)) + 1):
        some, shift = x[length == n].astype(np.uint32), np.arange(n - 2, -1, -1, dtype=np.uint32)
        parts += [np.packbits((some[lo : lo + SLICE, None] >> shift).astype(np.uint8) & 1).tobytes() for lo in range(0, len(some), SLICE)]
    return b"".join(parts)


def _from_by_length(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    length = np.frombuffer(blob, np.uint8, size, 8)
    out, at = (length > 0).astype(np.int32), 8 + size
    for n in range(2, int(length.max(initial=0)) + 1):
        which, weight = np.flatnonzero(length == n), 1 << np.arange(n - 2, -1, -1)
        for lo in range(0, len(which), SLICE):
            some = which[lo : lo + SLICE]
            many = (len(some) * (n - 1) + 7) // 8
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, many, at), count=len(some) * (n - 1)).reshape(len(some), n - 1)
            out[some] = (1 << (n - 1)) + bits @ weight
            at += many
    return out


def blocks(rows: DataFrame, path: str, block_bytes: int) -> DataFrame:
    """(block, rows, words) of (id, text), to be stored: a block's documents as positions in its list of distinct words,
    packed; and that list, an array of (bucket, words), by buckets, packed. A word that is met for the first time
    is written as 0, others by their rank of frequency."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, number = load(path), TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        counts: list[int] = []
        found: dict[str, int] = {}
        parts: list[array] = []
        size = 0

        def close() -> pa.RecordBatch:
            at = np.concatenate([np.frombuffer(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
            words = list(found)
            bucket = _bucket(words)
            order = np.argsort(bucket, kind="stable")
            count = np.bincount(at, minlength=len(words))
            often = np.argsort(-count, kind="stable")[: int((count > 1).sum())]  # frequent words get small numbers, from 1
            rank = np.zeros(len(words), dtype=np.int32)
            rank[often] = np.arange(1, len(often) + 1)
            new = np.append(True, at[1:] > np.maximum.accumulate(at)[:-1]) if len(at) else np.zeros(0, bool)  # words are numbered as they are met
            table = pa.table({"id": pa.concat_arrays(ids), "n": pa.array(counts, pa.int32())})
            one = {"rows": packed(table, 3), "at": _by_length(np.where(new, 0, rank[at])), "often": _planes(often), "bucket": _planes(bucket)}
            blob = packed(pa.table({k: pa.array([v], pa.large_binary()) for k, v in one.items()}), 6)
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            lists = [_strings([words[i].encode() for i in order[a:b].tolist()]) for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]
            held = pa.StructArray.from_arrays([pa.array(bucket[order][edges], pa.int32()), pa.array(lists, pa.binary())], names=["bucket", "words"])
            cells = [pa.array([task << 24 | number], pa.int64()), pa.array([blob], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)]
            return pa.RecordBatch.from_arrays(cells, names=["block", "rows", "words"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                ids.append(some.column(0))
                for text in some.column(1).to_pylist():
                    words = codec.words(text or "")
                    counts.append(len(words))
                    parts.append(array("i", [found.setdefault(w, len(found)) for w in words]))
                    size += len(text or "")
                if size >= block_bytes:
                    yield close()
                    ids, counts, found, parts, size, number = [], [], {}, [], 0, number + 1
                    tidy()
        if ids:
            yield close()
        del ids, counts, found, parts
        tidy()

    return rows.mapInArrow(cut, "block long, rows binary, words array<struct<bucket:int,words:binary>>")


def encoded_words(held: DataFrame, path: str) -> DataFrame:
    """(block, bucket, ids): the distinct-word table. The words of a bucket meet in one task, one list after another;
    each distinct one is encoded when it is first met, and every block's list goes back as ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last, known = load(path), None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                lengths, data = _from_strings(blob.as_py())
                at = np.append(0, np.cumsum(lengths)).tolist()
                words = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
                new = [w for w in words if w not in known]
                known.update(zip(new, codec.encode_words([w.decode() for w in new]), strict=True))
                out.append(_strings([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])
        tidy()

    lists = held.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.words")
    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, "block long, bucket int, ids binary")


Finish = Callable[[Codec, np.ndarray, np.ndarray], list[pa.Array]]


def code(docs: DataFrame, path: str, finish: Finish, fields: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col and the columns of fields (name, Spark type) for each row: finish(codec, ids, ends) makes them for some rows
    at a time, whose ids stand one after another, those of a row up to its end.

    Null and empty texts have no ids. Repeated rows are kept; ids may be null or shared; other columns are
    left out. An empty table gives an empty one. Words are cut once and stored; nothing depends on reading
    the rows again. A text is held whole by its task, some 100 bytes a word.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    kind = to_arrow_type(id_type)
    schema = StructType([StructField("id", id_type), *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields)).fields])
    held = stored(blocks(rows, path, block_bytes), "words")

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        codec, out = load(path), []
        order = np.argsort(right["bucket"].to_numpy(), kind="stable").tolist()
        lists = right["ids"].combine_chunks()
        told = [_from_strings(lists[i].as_py()) for i in order]
        size = np.concatenate([n for n, _ in told]) // np.dtype(codec.kind).itemsize if told else np.zeros(0, np.int64)
        flat = np.frombuffer(b"".join([x for _, x in told]), codec.kind)
        begin = np.cumsum(size) - size
        for blob in left["rows"]:
            one = unpacked(blob)
            table = unpacked(one["rows"].combine_chunks()[0])
            at = _from_by_length(one["at"][0].as_py())
            often, bucket = (_from_planes(one[c][0].as_py()) for c in ("often", "bucket"))
            if len(bucket) != len(size):
                raise RuntimeError(f"{len(bucket)} words were sent and {len(size)} came back")
            place = np.empty(len(bucket), dtype=np.int32)  # of a word in the list by buckets
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
            new = at == 0
            at = np.append(often, 0).astype(np.int32)[at - 1]
            at[new] = np.arange(int(new.sum()))
            at = place[at]
            upto = np.append(0, np.cumsum(table["n"].to_numpy()))
            lo = 0
            while lo < table.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + JOIN_WORDS, side="right")) - 1)
                words = at[upto[lo] : upto[hi]]
                many = size[words]
                last = np.cumsum(many)
                ids = flat[np.repeat(begin[words] - (last - many), many) + np.arange(last[-1] if len(last) else 0)]
                ends = np.append(0, last)[upto[lo + 1 : hi + 1] - upto[lo]]
                columns = finish(codec, ids, ends)
                out.append(pa.table([table["id"].slice(lo, hi - lo).cast(kind), *columns], names=schema.names))
                lo = hi
        tidy()
        return pa.concat_tables(out) if out else pa.table([pa.array([], to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)

    words = encoded_words(held, path).withColumnRenamed("block", "of")
    return held.select("block", "rows").groupBy("block").cogroup(words.groupBy("of")).applyInArrow(join_back, schema).withColumnRenamed("id", id_col)


def _lists(codec: Codec, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) of each row, as the tokenizers library encodes the whole text without
    added special tokens, truncation or padding; a special token's own text becomes its id.

    For null, empty and repeated rows see code(). The file must be one of plain byte-level BPE: settings
    that are not followed here are an error.
    """
    return code(docs, path, _lists, [("ids", "array<int>")], id_col, text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of each row of ids, by a join of ids to pieces; bytes that are no UTF-8 become U+FFFD.

    Null or empty ids give an empty text, as do ids outside the vocabulary. id_col need not be unique.
    """

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        known = len(codec.pieces)
        for batch in batches:
            rows = [[i for i in ids or () if i is not None and 0 <= i < known] for ids in batch.column(1).to_pylist()]
            found = joined(codec.piece_column, np.array([i for ids in rows for i in ids], dtype=np.int64), np.cumsum([len(ids) for ids in rows]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in found], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(text, StructType([rows.schema["id"], *StructType.fromDDL("text string").fields])).withColumnRenamed("id", id_col)


def _digests(codec: Codec, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    texts = [x.decode("utf-8", "replace").encode() for x in joined(codec.piece_column, ids, ends)]
    return [pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([sha(x[:-1]) for x in joined(codec.decimal_column, ids, ends)]), pa.array([sha(x) for x in texts])]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text decoded from them).

    A row without ids has none of them and the digests of the empty string. For other odd rows see code().
    """
    return code(docs, path, _digests, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], id_col, text_col, block_bytes)
