"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, stored


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the smallest node reachable.

    Large-star and small-star steps by turns: each node's neighbours are linked to the smallest of
    them, until nothing changes. Each round is written to the shared folder; a node of very many
    edges only ever costs one row per edge. Edges with a null end, and from a node to itself, don't
    count; no edges give no rows. The result is a stored table; finished rounds are deleted.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("lo"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("hi"))
        last, links = links, stored(small.select(F.col("lo").alias("a"), F.col("hi").alias("b")).where("a <> b").distinct(), label)
        discard(last)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = stored(links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), label)
    discard(links)
    return found
