"""Mixing sources to target weights: budgets flow down a domain-language-source tree.

A node's budget is dealt to its children by their weights; a child that cannot use its share (its
supply times the allowed epochs) leaves the rest to its siblings, and only what a whole subtree
cannot use goes on to the subtree's own siblings. Each leaf then takes the longest run of its
documents, in the order of a seeded digest, whose tokens fit its budget, epoch after epoch: that run
ends at one digest, so the choice is a comparison with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD_PATTERN, discard, quoted, stored

#: The tree's leaves are read by the driver; more of them than this is an error, not a cut.
MOST_LEAVES = 100_000
BINS = 4096

Path = tuple[str, ...]


def share_out(budget: int, room: dict[str, int], weight: dict[str, float]) -> dict[str, int]:
    """Deals budget by weight among names that can take room[name] at most; whole tokens, ties by name."""
    got = {k: 0 for k in room}
    budget = min(budget, sum(v for k, v in room.items() if weight.get(k, 0) > 0))
    live = sorted(k for k in room if weight.get(k, 0) > 0 and room[k] > 0)
    while live:
        total = sum(weight[k] for k in live)
        full = [k for k in live if room[k] <= budget * weight[k] / total]
        if not full:
            for k in live:
                got[k] = int(budget * weight[k] / total)
            for k in live[: budget - sum(got[k] for k in live)]:
                got[k] += 1
            break
        for k in full:
            got[k] = room[k]
        budget -= sum(room[k] for k in full)
        live = [k for k in live if k not in full]
    return got


def budgets(supply: dict[Path, int], budget: int, weight: Callable[[Path], float], epochs: int = 1) -> dict[Path, int]:
    """The budget of each leaf; supply has a leaf's tokens by its path, weight(path) any node's share among its siblings."""
    room: dict[Path, int] = defaultdict(int)
    children: dict[Path, set[Path]] = defaultdict(set)
    for leaf, tokens in supply.items():
        for depth in range(len(leaf) + 1):
            if all(weight(leaf[:d]) > 0 for d in range(1, len(leaf) + 1)):
                room[leaf[:depth]] += tokens * epochs
            if depth:
                children[leaf[: depth - 1]].add(leaf[:depth])
    got: dict[Path, int] = {(): min(budget, room[()])}
    waiting: list[Path] = [()]
    while waiting:
        node = waiting.pop()
        kids = {k[-1]: k for k in children.get(node, ())}
        dealt = share_out(got[node], {n: room[k] for n, k in kids.items()}, {n: weight(k) for n, k in kids.items()})
        for n, k in kids.items():
            got[k] = dealt[n]
            waiting.append(k)
    return {leaf: got.get(leaf, 0) for leaf in supply}


def tokens_of(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def _keyed(docs: DataFrame, domain: Column, id_col: str, *also: Column) -> DataFrame:
    """(key, leaf) of each row and what else is asked of it; no other column of docs stays, so that no name can clash."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    leaf = F.struct(name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"))
    return docs.select(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), digest).alias("key"), leaf.alias("leaf"), *also)


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("key")))


Plan = list[tuple[Path, int, str]]


def plan_mix(docs: DataFrame, domain: Column, weight: Callable[[Path], float], fraction: float, seed: int = 1, epochs: int = 1, id_col: str = "doc_id") -> tuple[Plan, dict[Path, tuple[int, int]]]:
    """How far each leaf is read, as (leaf, epoch, last order digest), and each leaf's (supply, budget).

    A leaf is cut by its order digests into bins; its budget is compared with prefix sums of the bins'
    tokens, and only the one bin in which it ends is put in order.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, domain, id_col, tokens_of(F.col("text")).alias("tokens"))
    rows = stored(rows.groupBy("key", "leaf").agg(F.sum("tokens").alias("tokens")), "mix")
    sums = rows.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    supply = {tuple(r.leaf): r.tokens for r in sums}
    got = budgets(supply, int(fraction * sum(supply.values())), weight, epochs)
    limits = [(k, e, min(got[k] - e * supply[k], supply[k])) for k in supply for e in range(epochs) if got[k] > e * supply[k]]
    told = {k: (supply[k], got[k]) for k in supply}
    if not limits:
        discard(rows)
        return [], told
    frame = spark.createDataFrame(limits, "leaf struct<domain:string,lang:string,source:string>, epoch int, budget long")
    bin_ = (F.conv(F.substring("order", 1, 6), 16, 10).cast("long") * BINS / (1 << 24)).cast("int")
    dealt = rows.join(F.broadcast(frame), "leaf").withColumn("order", _order(seed, F.col("epoch"))).withColumn("bin", bin_)
    in_leaf = Window.partitionBy("leaf", "epoch").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = dealt.groupBy("leaf", "epoch", "budget", "bin").agg(F.sum("tokens").alias("tokens"), F.max("order").alias("last")).withColumn("upto", F.sum("tokens").over(in_leaf))
    whole = bins.where(F.col("upto") <= F.col("budget")).select("leaf", "epoch", "last")
    ends = bins.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("tokens") <= F.col("budget"))).select("leaf", "epoch", "bin", (F.col("upto") - F.col("tokens")).alias("start"))
    in_bin = Window.partitionBy("leaf", "epoch", "bin").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    cut = dealt.join(ends, ["leaf", "epoch", "bin"]).withColumn("end", F.col("start") + F.sum("tokens").over(in_bin)).where(F.col("end") <= F.col("budget")).select("leaf", "epoch", F.col("order").alias("last"))
    last = whole.unionByName(cut).groupBy("leaf", "epoch").agg(F.max("last").alias("last")).collect()
    discard(rows)
    return [(tuple(r.leaf), r.epoch, r.last) for r in last], told


def select_mix(docs: DataFrame, domain: Column, plan: Plan, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(doc, leaf, epoch) of the rows of docs that the plan chooses: one for each epoch that a row is in.

    docs has id_col, text, lang, source; doc is a struct of all its columns, whatever their names. A null domain, language or source is a
    leaf named '?'. A leaf's order is by md5 of seed, epoch, id and the text's digest. A document is
    taken if its tokens end within the leaf's budget; the first that does not ends the leaf. Equal
    rows (same id, text and leaf) are taken or left together: their tokens count for each. An empty
    table chooses nothing. The plan has a row for each leaf and epoch, so nothing is shuffled.
    """
    frame = docs.sparkSession.createDataFrame(plan, "leaf struct<domain:string,lang:string,source:string>, epoch int, last string")
    rows = _keyed(docs, domain, id_col, F.struct(*quoted(*docs.columns)).alias("doc")).join(F.broadcast(frame), "leaf")
    return rows.where(_order(seed, F.col("epoch")) <= F.col("last")).select("doc", "leaf", "epoch")
