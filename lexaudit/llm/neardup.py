"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's sketch is the k smallest hashes of its word shingles. In the common order of hashes,
two sets that share most of their values share runs of neighbours; each run of RUN neighbouring
retained values is a key of an inverted list. Documents that share a list are candidates. Their
union sketch (the k smallest values of both) estimates the Jaccard similarity; pairs that it does
not rule out are compared on their full shingle sets.

First each document is compared with one hub, a member of most of its lists. What hubs have linked is
one group from then on: lists that lie in one group are done with, and in all others only documents of
different groups are compared. So a large group of near copies costs about a row for each, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Words, discard, mix, packed_blocks, signed, small_batches, stored, text_blocks, tidy, unpacked, word_chunks
from .graph import components

#: Values retained.
K = 64
#: With at most a fifth of the union unshared, a union of six or more values holds a shared run of three.
RUN = 3
#: Pairs that share fewer lists are no candidates: alike by 0.8, they do so with probability 2e-9.
LEAST_LISTS = 2
#: Smaller sets may share one list alone; a union of ten or more shares two at least.
SMALL_SET = 10
#: Pairs whose union sketch shares a smaller part are not compared in full: at 0.8, with probability 2e-13.
ESTIMATE = 0.37
#: Longer lists are not written out as pairs.
LONG_LIST = 32
#: Documents of a hub, of a long list or of a component that are compared in one task at once.
PART = 4096
BLOCK_BYTES = 4 << 20
#: Kinds of tasks that compare full sets: pairs of a hub, or all of a chain of long lists.
STAR, CHAIN = 0, 1


class Shingles:
    """The distinct shingles of a chunk's documents: sorted hashes, document i's in values[bounds[i]:bounds[i+1]]."""

    def __init__(self, words: Words, length: int):
        n = len(words.count)
        starts = np.maximum(words.count - length + 1, 0)
        ordinal = np.arange(len(words.hash))
        doc = np.repeat(np.arange(n), words.count)
        full = ordinal - words.first[:-1][doc] < starts[doc]
        at = np.flatnonzero(full)
        hashes, docs = (words.windows(at, length) if len(at) else np.zeros(0, np.uint64)), doc[at]
        short = np.flatnonzero((words.count > 0) & (words.count < length))
        if len(short):
            whole = words.spans(words.first[:-1][short], words.first[1:][short])
            hashes, docs = np.append(hashes, mix(whole + np.uint64(1))), np.append(docs, short)
        order = np.lexsort((hashes, docs))
        hashes, docs = hashes[order], docs[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        self.values, self.doc = hashes[new], docs[new]
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))
        self.count = np.diff(self.bounds)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that are equal for equal sets, as two sums over the set."""
        return tuple(np.append(x, np.uint64(0))[:0] if not len(self.count) else _sums(x, self.bounds) for x in (mix(self.values), mix(self.values ^ np.uint64(0x5851F42D4C957F2D))))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def run_keys(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set) of each set's runs of RUN neighbours among its k smallest values.

    Sets of 4 and 5 are the only ones that may differ and be alike by 0.8 without sharing a run: they
    share a key made of all four values, or of four of the five. Smaller sets are alike only if equal.
    """
    if len(bounds) > 1 and int(np.diff(bounds).max()) > k:
        at, bounds = _ranges(bounds[:-1], np.minimum(np.diff(bounds), k))
        values = values[at]
    count = np.diff(bounds)
    sets = np.repeat(np.arange(len(count)), count)
    rank = np.arange(len(values)) - bounds[:-1][sets]
    start = np.flatnonzero((rank + RUN <= count[sets]) & (count > RUN)[sets])
    keys = values[start]
    for step in range(1, RUN):
        keys = mix(keys) ^ values[start + step]
    keys, owner = mix(keys), sets[start]
    spread = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    for size in (4, 5):
        which = np.flatnonzero(count == size)
        if len(which):
            inside = spread[bounds[:-1][which][:, None] + np.arange(size)]
            total = inside.sum(axis=1, dtype=np.uint64)
            extra = total[:, None] if size == 4 else total[:, None] - inside
            keys, owner = np.append(keys, mix(extra).ravel()), np.append(owner, np.repeat(which, extra.shape[1]))
    return keys, owner


def links_within(ids: np.ndarray, values: np.ndarray, bounds: np.ndarray, percent: int, k: int = K, sketches: bool = False, mark: np.ndarray | None = None, full: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets alike by percent (100 * shared >= percent * union), as a spanning forest.

    Sets of one mark, and those that an earlier link has joined, are not compared; all other candidates
    are. sketches: the sets are only sketches, and what their union sketch does not rule out is linked, nor
    the sizes of the full sets, if they are given.
    """
    n = len(ids)
    keys, owner = run_keys(values, bounds, k)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[first], owner[first]
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    more = size[group] > 1
    group, owner = group[more], owner[more]
    if not len(group):
        return []
    _, group = np.unique(group, return_inverse=True)
    list_bounds = np.searchsorted(group, np.arange(group[-1] + 2))
    by_set = np.lexsort((group, owner))
    lists_of, set_bounds = group[by_set], np.searchsorted(owner[by_set], np.arange(n + 1))
    local = np.unique(values, return_inverse=True)[1].astype(np.int32)
    count = np.diff(bounds)
    full = count if full is None and not sketches else full
    head = np.minimum(count, k)
    here = np.zeros(int(local.max()) + 1, dtype=bool)
    # the smallest member's place of each joined group
    root = np.arange(n)
    if mark is not None:
        _, first, of = np.unique(mark, return_index=True, return_inverse=True)
        root = first[of]
    out = []
    for x in np.argsort(-np.diff(set_bounds), kind="stable"):
        mine = lists_of[set_bounds[x] : set_bounds[x + 1]]
        if not len(mine):
            break
        near = np.unique(np.concatenate([owner[list_bounds[g] : list_bounds[g + 1]] for g in mine]))
        near = near[root[near] != root[x]]
        if full is not None:
            near = near[100 * np.minimum(full[near], full[x]) >= percent * np.maximum(full[near], full[x])]
        if not len(near):
            continue
        own = local[bounds[x] : bounds[x + 1]]
        here[own] = True
        # union sketch: the k smallest values of both sets; local numbers keep the order of hashes
        at, ends = _ranges(bounds[near], head[near])
        held = local[at]
        shared = here[held]
        edge = np.minimum(own[head[x] - 1], np.maximum.reduceat(held, ends[:-1]))
        under = held <= np.repeat(edge, head[near])
        both = np.add.reduceat((shared & under).astype(np.int64), ends[:-1])
        mine_under = np.searchsorted(own, edge, side="right")
        union = np.minimum(mine_under + np.add.reduceat(under.astype(np.int64), ends[:-1]) - both, k)
        near = near[both >= ESTIMATE * np.minimum(union, k)]
        if len(near) and not sketches:
            at, ends = _ranges(bounds[near], count[near])
            both = np.add.reduceat(here[local[at]].astype(np.int64), ends[:-1])
            near = near[100 * both >= percent * (count[x] + count[near] - both)]
        for y in near:
            if root[y] != root[x]:
                out.append((int(ids[x]), int(ids[y])))
                lo, hi = sorted((root[x], root[y]))
                root[root == hi] = lo
        here[own] = False
    return out


def star_links(ids: np.ndarray, hubs: np.ndarray, values: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of sets, each asked for by a hub (whose own set is among them), those alike with their hub by percent."""
    out = []
    order = np.argsort(hubs, kind="stable")
    edges = np.flatnonzero(np.append(True, hubs[order][1:] != hubs[order][:-1])) if len(order) else []
    for members in np.split(order, edges[1:]) if len(order) else ():
        hub = hubs[members[0]]
        own = members[ids[members] == hub]
        others = members[ids[members] != hub]
        if not len(own) or not len(others):
            continue
        centre = values[bounds[own[0]] : bounds[own[0] + 1]]
        at, ends = _ranges(bounds[others], bounds[others + 1] - bounds[others])
        held = values[at]
        place = np.minimum(np.searchsorted(centre, held), len(centre) - 1)
        both = np.add.reduceat((centre[place] == held).astype(np.int64), ends[:-1])
        alike = 100 * both >= percent * (len(centre) + np.diff(ends) - both)
        out += [(int(hub), int(i)) for i in ids[others[alike]]]
    return out


def union_sketch(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """The shared part of the k smallest values of both sets, from their sketches: an estimate of their similarity."""
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    edge = np.flatnonzero(np.append(True, ~twice))[:k]  # where the k smallest values begin
    return float(np.count_nonzero(twice[edge[edge < len(twice)]])) / max(len(edge), 1)


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start[i] .. start[i]+length[i]-1 of all i in a row, and where each i's begin and end."""
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=ends[1:])
    return np.arange(ends[-1]) + np.repeat(start - ends[:-1], length), ends


def groups(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = K, part: int = PART) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable over links), kept.

    A-Z are lower-cased; a text of fewer words than a shingle is one shingle; one without words is
    empty and linked with nothing. Documents are linked if 100 * shared >= percent * union of their
    distinct shingles (hashed to 64 bits). kept is true for the row whose id is its component's, so
    it is always true of empty texts. Rows that share an id count as one document with several
    texts. A row with a null id is linked with nothing, has a null component and is kept. An empty
    table gives an empty one; other columns are ignored. percent must be 80 or more.

    Equal sets are settled by a count; one of each kind goes on. Candidates are verified by pairs, dealt
    to the hub's or the smaller one's task; only what long lists join by their sketches is compared
    as a whole, the largest group's members once with each part of the others, in tasks of bounded size.
    """
    if percent < 80:
        raise ValueError("runs of neighbours are only sure to be shared from 80 percent on")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in text_blocks(batches, 1, BLOCK_BYTES):
            ids = held["id"].combine_chunks()
            for w in word_chunks(held["text"], fold=True):
                s = Shingles(w, shingle)
                one, two = s.marks()
                upper = (s.values >> np.uint64(32)).astype(np.uint32)
                sketch = [upper[a : min(a + k, b)].tobytes() for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(w.lo, w.hi - w.lo), pa.array(np.full(w.hi - w.lo, block)), pa.array(s.count.astype(np.int64)), pa.array(signed(one)), pa.array(signed(two)), pa.array(sketch, pa.binary())], names=["id", "block", "n", "m1", "m2", "sketch"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has_id = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            for w in word_chunks(batch.column(1), fold=True):
                s = Shingles(w, shingle)
                found, owner = run_keys(s.values, s.bounds, k)
                use = has_id[w.lo + owner]
                found, owner = found[use], owner[use]
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(ids[w.lo + owner]), pa.array(signed(s.marks()[0])[owner])], names=["key", "id", "m1"])

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        """The full set of each asked document, once for each task that it is asked for."""
        out: list[list] = [[] for _ in range(7)]
        if right.num_rows:
            if not left.num_rows:
                raise RuntimeError("a block has changed between two readings of its table")
            held = unpacked(left["rows"][0])
            asked: dict[int, list] = {}
            for i, *where in zip(*(right[c].to_pylist() for c in ("id", "kind", "task", "lo", "hi", "mark")), strict=True):
                asked.setdefault(i, []).append(where)
            ids = held["id"].to_pylist()
            for w in word_chunks(held["text"], fold=True):
                s = Shingles(w, shingle)
                for i in range(w.hi - w.lo):
                    for where in asked.get(ids[w.lo + i], ()) if s.count[i] else ():
                        for column, x in zip(out, (*where, ids[w.lo + i], s.values[s.bounds[i] : s.bounds[i + 1]].tobytes()), strict=True):
                            column.append(x)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("kind", "task", "lo", "hi", "mark", "id", "shingles"), out, kinds, strict=True)})

    def unpack(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        found = [np.frombuffer(x.as_buffer(), kind) for x in column]
        return np.concatenate(found).astype(np.uint64), np.append(0, np.cumsum([len(x) for x in found]))

    def edges(pairs: list[tuple[int, int]]) -> pa.Table:
        tidy()
        return pa.table({"a": pa.array([x[0] for x in pairs], pa.int64()), "b": pa.array([x[1] for x in pairs], pa.int64())})

    def compare(held: pa.Table) -> pa.Table:
        """Links between full sets: of hubs with those that ask for them, or of all those of different groups."""
        values, bounds = unpack(held["shingles"], np.uint64)
        ids, mark = held["id"].to_numpy(), held["mark"].to_numpy()
        return edges(star_links(ids, mark, values, bounds, percent) if held["kind"][0].as_py() == STAR else links_within(ids, values, bounds, percent, k, mark=mark))

    def likely_within(held: pa.Table) -> pa.Table:
        """Groups that the sketches of a list's members (upper halves of hashes) do not keep apart."""
        values, bounds = unpack(held["sketch"], np.uint32)
        mark = held["mark"].to_numpy()
        return edges([(int(mark[x]), int(mark[y])) for x, y in links_within(np.arange(len(mark)), values, bounds, percent, k, True, mark, held["size"].to_numpy())])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [union_sketch(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), k) >= ESTIMATE for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], names=["a", "b"])

    def sketched(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that neither their sizes nor their union sketch rule out."""
        both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("p")), "a")
        both = both.join(sketches.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("q")), "b")
        both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.select("a", "b", "p", "q").mapInArrow(estimate, "a long, b long")

    def shared_task(size: Column, whole: Column, several: int) -> Column:
        """Small groups share tasks, of about as many documents each."""
        return F.when(size <= part // 8, F.lit(-1) - F.pmod(F.xxhash64(whole), F.lit(several))).otherwise(whole)

    def asked_by_stars(pairs: DataFrame) -> DataFrame:
        """(id, kind, task, lo, hi, mark): both of each pair to a task of a, which is one of several if it has many partners."""
        sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        several = max(1, pairs.count() // (part // 4))
        task, parts = shared_task(F.col("n"), F.col("a"), several).cast("long"), F.ceil(F.col("n") / part).cast("int")
        told = lambda i, at: (i.alias("id"), F.lit(STAR).alias("kind"), task.alias("task"), at.cast("int").alias("lo"), F.lit(0).alias("hi"), F.col("a").alias("mark"))
        members = pairs.join(sizes, "a").select(*told(F.col("b"), F.pmod(F.xxhash64("b"), parts)))
        return members.unionByName(sizes.withColumn("at", F.explode(F.sequence(F.lit(0), parts - 1))).select(*told(F.col("a"), F.col("at"))))

    def parted(members: DataFrame, sizes: DataFrame, on: str) -> DataFrame:
        """(on, n, lo, hi, id, mark) of members (on, id, mark): in one part, or in parts of two kinds. Those of the main
        group (sizes has on, n, main, others) meet each part of the others; only the others meet each other."""
        sized = members.join(sizes, on).withColumn("mains", F.ceil((F.col("n") - F.col("others")) / part).cast("int")).withColumn("parts", F.ceil(F.col("others") / part).cast("int"))
        few, is_main = F.col("n") <= part, F.col("mark") == F.col("main")
        own = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
        place = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
        all_ = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        to_others = F.transform(all_("parts"), lambda j: place(F.lit(-1) - own("mains"), j))
        to_all = F.concat(F.transform(all_("parts"), lambda j: place(F.least(own("parts"), j), F.greatest(own("parts"), j))), F.transform(all_("mains"), lambda i: place(F.lit(-1) - i, own("parts"))))
        places = F.when(few, F.array(place(F.lit(0), F.lit(0)))).when(is_main, to_others).otherwise(to_all)
        return sized.withColumn("at", F.explode(places)).select(on, "n", "at.lo", "at.hi", "id", "mark")

    def verified(wanted: DataFrame) -> DataFrame:
        """Links among the full sets of what is asked for."""
        placed = firsts.select("id", "block").join(wanted, "id")
        whole = packed_blocks(rows, 1, BLOCK_BYTES).groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(sets, "kind int, task long, lo int, hi int, mark long, id long, shingles binary")
        return whole.groupBy("kind", "task", "lo", "hi").applyInArrow(compare, "a long, b long")

    texts = stored(rows.mapInArrow(profile, "id long, block long, n long, m1 long, m2 long, sketch binary"), "profile")
    kinds = stored(texts.where("id is not null and n > 0").groupBy("m1", "m2", "n").agg(F.min("id").alias("first")), "kinds")
    found = rows.mapInArrow(keys, "key long, id long, m1 long")
    shared = found.groupBy("key").agg(F.min("m1").alias("a"), F.max("m1").alias("b")).where("a <> b").select("key")
    postings = found.select("key", "id").join(shared, "key", "left_semi").join(kinds.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    postings = stored(postings.select("key", "id"), "postings")

    firsts = texts.join(kinds.select(F.col("first").alias("id"), "m1", "m2", "n"), ["id", "m1", "m2", "n"], "left_semi")
    sketches = stored(firsts.select("id", F.col("n").alias("size"), "sketch").join(postings.select("id").distinct(), "id", "left_semi"), "sketches")

    # each document and the smallest id of the lists that it shares most often
    hubs = postings.groupBy("key").agg(F.min("id").alias("a"))
    stars = postings.join(hubs, "key").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("lists", (-F.col("a")).alias("least"))).alias("a")).select("a", "b")
    stars = stored(sketched(stars), "stars")
    joined = stored(verified(asked_by_stars(stars)), "hubs")
    grouped = components(joined, "groups")

    # what is left of the lists: documents of different groups
    group = F.coalesce("component", "id")
    members = postings.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("key", "id", group.alias("mark"))
    several = members.groupBy("key").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("key")
    members = stored(members.join(several, "key", "left_semi"), "members")
    lengths = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("mark", "id").alias("main"))
    listed = members.join(lengths.where(F.col("n") <= LONG_LIST), "key").select("key", "id", "mark")
    pairs = listed.alias("x").join(listed.alias("y"), "key").where("x.id < y.id and x.mark <> y.mark").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("lists"))
    long = members.join(lengths.where(F.col("n") > LONG_LIST), "key").select("key", "id", "mark", "main")
    # members of long lists may share some of those besides; small sets may share one list only
    exempt = long.select(F.col("id").alias("a")).unionByName(kinds.where(F.col("n") < SMALL_SET).select(F.col("first").alias("a")))
    exempt = exempt.distinct().withColumn("exempt", F.lit(True))
    pairs = pairs.join(exempt, "a", "left").where((F.col("lists") >= LEAST_LISTS) | F.col("exempt")).select("a", "b")
    pairs = stored(sketched(pairs), "pairs")

    counted = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("main").alias("main"), F.sum((F.col("mark") != F.col("main")).cast("long")).alias("others"))
    in_parts = parted(long.drop("main"), counted, "key").join(sketches, "id").select("key", "lo", "hi", "id", "mark", "size", "sketch")
    chained = components(in_parts.groupBy("key", "lo", "hi").applyInArrow(likely_within, "a long, b long"), "candidates")
    candidates = long.select("id", "mark").distinct().join(chained.select(F.col("node").alias("mark"), "component"), "mark")
    candidates = stored(candidates, "candidates")
    by_group = candidates.groupBy("component", "mark").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_group.groupBy("component").agg(F.sum("n").alias("n"), F.max_by("mark", F.struct("n", "mark")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    task = shared_task(F.col("n"), F.col("component"), max(1, candidates.count() // (part // 4))).cast("long")
    dealt = parted(candidates, sizes, "component").select("id", F.lit(CHAIN).alias("kind"), task.alias("task"), "lo", "hi", "mark")
    links = stored(verified(asked_by_stars(pairs).unionByName(dealt)), "verified").unionByName(joined)

    named = texts.drop("sketch").join(kinds, ["m1", "m2", "n"], "left")
    several = named.where("first is not null").groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b")
    several = named.join(several.select("id", "a"), "id").select("a", F.col("first").alias("b"))
    every = components(links.unionByName(several), "links")
    discard(postings, sketches, stars, joined, grouped, members, pairs, chained, candidates)
    result = named.join(every.select(F.col("node").alias("first"), "component"), "first", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("component"), F.col("first"), F.col("id")))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
